"""Baseline JPEG decoding in numpy: any component count, sampling, quantisers, Huffman tables and restart intervals.

Entropy-coded symbols are read by look-ups of 16 bits; dequantisation and the inverse transform are matrix products over
all blocks at once. Frames without Huffman tables, as many motion-JPEG writers leave them out, use the standard's
typical ones. Progressive, arithmetic-coded, lossless and 12-bit frames, and any damage, raise ValueError.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

# The typical Huffman tables of the JPEG standard, annex K.3: codes of each length 1 to 16, and the first
# symbols in code order. The rest of an AC table follows by run and size (`_typical_ac`).
DC_LUMA_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_CHROMA_COUNTS = (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)
AC_LUMA_COUNTS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
AC_LUMA_FIRST = bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")
AC_CHROMA_COUNTS = (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)
AC_CHROMA_FIRST = bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1")


def _typical_ac(first: bytes) -> bytes:
    """The first symbols, then all others of runs 0 to 15 and sizes 1 to 10 in order."""
    return first + bytes(r << 4 | s for r in range(16) for s in range(1, 11) if (r << 4 | s) not in first)


def _zigzag() -> np.ndarray:
    """Row-major position of each coefficient in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
_X = np.arange(8)
DCT = np.cos((2 * _X[None, :] + 1) * _X[:, None] * np.pi / 16) * np.where(_X == 0, np.sqrt(1 / 8), 0.5)[:, None]


def lookup(counts: tuple[int, ...] | bytes, symbols: bytes) -> list[int]:
    """For each 16 bits ahead: length << 8 | symbol of the code that they begin with, or 0."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if at >= len(symbols) or code >> length:
                raise ValueError("a Huffman table has more codes than fit")
            table[code << 16 - length : (code + 1) << 16 - length] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table.tolist()


_TYPICAL: dict[int, list[int]] = {}


def typical_tables() -> dict[int, list[int]]:
    """Tables by class << 4 | number, made once a process."""
    if not _TYPICAL:
        _TYPICAL.update({
            0x00: lookup(DC_LUMA_COUNTS, bytes(range(12))),
            0x01: lookup(DC_CHROMA_COUNTS, bytes(range(12))),
            0x10: lookup(AC_LUMA_COUNTS, _typical_ac(AC_LUMA_FIRST)),
            0x11: lookup(AC_CHROMA_COUNTS, _typical_ac(AC_CHROMA_FIRST)),
        })
    return _TYPICAL


@dataclass
class Component:
    across: int
    down: int
    quantiser: int
    width: int = 0  # blocks that hold samples
    height: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded bytes from `at`, unstuffed, cut at restart markers, and where the next marker stands."""
    out, begin = [], at
    for found in re.compile(rb"\xff+([^\x00\xff])", re.S).finditer(data, at):
        out.append(data[begin : found.start()].replace(b"\xff\0", b"\xff"))
        begin = found.end()
        if not 0xD0 <= found[1][0] <= 0xD7:
            return out, found.start()
    raise ValueError("a scan has no end")


def _read_blocks(raw: bytes, order: list[tuple], carried: list[int]) -> None:
    """Fill blocks in order from one restart interval; order: (64 coefficients, carried DC's number, DC and AC tables)."""
    wide = np.frombuffer(raw + b"\xff" * 8, np.uint8).astype(np.int64)
    n = len(raw)
    words = ((wide[: n + 4] << 32) | (wide[1 : n + 5] << 24) | (wide[2 : n + 6] << 16) | (wide[3 : n + 7] << 8) | wide[4:]).tolist()
    p, end = 0, n * 8
    for block, which, dc, ac in order:
        k = 0
        while k < 64:
            if p >= end:
                raise ValueError("a scan ends inside a block")
            entry = (ac if k else dc)[words[p >> 3] >> 24 - (p & 7) & 0xFFFF]
            p += entry >> 8
            size = entry & 15
            if not entry or p + size > end:
                raise ValueError("a scan has bits that are no code")
            bits = words[p >> 3] >> 40 - (p & 7) - size & (1 << size) - 1
            p += size
            value = bits if not size or bits >> size - 1 else bits - (1 << size) + 1
            if not k:
                carried[which] += value
                block[0] = carried[which]
            else:
                run = entry >> 4 & 15
                if not size and run != 15:
                    break  # the rest of the block is 0
                k += run
                if size:
                    if k > 63:
                        raise ValueError("a run passes the end of its block")
                    block[k] = value
            k += 1


def decode(data: bytes) -> np.ndarray:
    """Samples of a baseline JPEG, uint8 (height, width, components), subsampled components repeated; no colour change."""
    try:
        return _decode(data)
    except (struct.error, IndexError, KeyError) as error:
        raise ValueError(f"a frame is damaged: {error!r}") from error


def _decode(data: bytes) -> np.ndarray:
    if data[:2] != b"\xff\xd8":
        raise ValueError("a frame does not begin as a JPEG")
    quantisers: dict[int, np.ndarray] = {}
    tables, parts, height, width, restart, at = dict(typical_tables()), {}, 0, 0, 0, 2
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        lead, marker = struct.unpack_from(">BB", data, at)
        if lead != 0xFF:
            raise ValueError("a marker is missing")
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if len(body) != size - 2:
            raise ValueError("a frame is cut short")
        if marker == 0xDB:
            while body:
                long = body[0] >> 4
                values = np.frombuffer(body, ">u2" if long else np.uint8, 64, 1)
                quantisers[body[0] & 15], body = values.astype(np.int64), body[129 if long else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = lookup(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width or not n or parts:
                raise ValueError("a frame is not of 8 bits, is empty, or has two headers")
            for k in range(n):
                name, sampling, quantiser = body[6 + 3 * k : 9 + 3 * k]
                parts[name] = Component(sampling >> 4, sampling & 15, quantiser)
            if any(not 1 <= s <= 4 for c in parts.values() for s in (c.across, c.down)):
                raise ValueError("a component's sampling is not 1 to 4")
            across, down = max(c.across for c in parts.values()), max(c.down for c in parts.values())
            columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
            # A block takes two bits at least, so a short file cannot ask for much memory.
            if columns * rows * sum(c.across * c.down for c in parts.values()) * 2 > len(data) * 8:
                raise ValueError("a frame is too short for its size")
            for c in parts.values():
                c.width, c.height = -(-(-(-width * c.across // across)) // 8), -(-(-(-height * c.down // down)) // 8)
                c.blocks = np.zeros((rows * c.down, columns * c.across, 64), np.int64)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("a frame is not baseline JPEG")
        elif marker == 0xDA:
            scanned = []
            for k in range(body[0]):
                name, chosen = body[1 + 2 * k], body[2 + 2 * k]
                scanned.append((parts[name], tables[chosen >> 4], tables[0x10 | chosen & 15]))
            if len(scanned) == 1:  # blocks of one component, without the padding to whole units
                c, dc, ac = scanned[0]
                units = [[(c.blocks, y, x, 0, dc, ac)] for y in range(c.height) for x in range(c.width)]
            else:
                units = [
                    [(c.blocks, r * c.down + y, q * c.across + x, k, dc, ac) for k, (c, dc, ac) in enumerate(scanned) for y in range(c.down) for x in range(c.across)]
                    for r in range(rows)
                    for q in range(columns)
                ]
            pieces, at = _segments(data, at)
            each = restart or len(units)
            if len(pieces) < -(-len(units) // each):
                raise ValueError("a restart interval is missing")
            for k, raw in enumerate(pieces[: -(-len(units) // each)]):
                mine = [(blocks, y, x, which, dc, ac, [0] * 64) for unit in units[k * each : (k + 1) * each] for blocks, y, x, which, dc, ac in unit]
                _read_blocks(raw, [(m[6], m[3], m[4], m[5]) for m in mine], [0] * len(scanned))
                for blocks, y, x, _, _, _, values in mine:
                    blocks[y, x] = values
    if not parts:
        raise ValueError("a frame has no header")
    planes = []
    for c in parts.values():
        values = np.empty(c.blocks.shape)
        values[:, :, ZIGZAG] = c.blocks * quantisers[c.quantiser]
        pixels = np.matmul(np.matmul(DCT.T, values.reshape(*c.blocks.shape[:2], 8, 8)), DCT)
        plane = np.clip(np.floor(pixels + 128.5), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(c.blocks.shape[0] * 8, -1)
        ys, xs = np.arange(height) * c.down // down, np.arange(width) * c.across // across
        planes.append(plane[ys[:, None], xs])
    return np.stack(planes, axis=2)


def histogram(picture: np.ndarray) -> np.ndarray:
    """Shares of 16 brightness bins; the first component is the brightness, as in grey and in luma-chroma frames."""
    return np.bincount(picture[:, :, 0].reshape(-1) >> 4, minlength=16) / (picture.shape[0] * picture.shape[1])

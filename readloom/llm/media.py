"""AVI motion-JPEG media columns (operator 6).

Bytes are kept losslessly as quantised DCT coefficients, the unit that a baseline JPEG stores: 64 bytes make an
8x8 block. All quantisers are 1 and the Huffman tables give every coefficient ten bits in all (a code of 10 - s
bits before s magnitude bits), so that both coding and decoding are numpy table look-ups while each frame stays
a baseline grey JPEG. Frames of 64x64 samples go into a RIFF AVI with an idx1 index; the payload's length is in
an INFO chunk. Reading parses the index, decodes the frames, inverts the DCT in exact integer arithmetic and
detects shots where the histogram difference of neighbouring frames exceeds an adaptive threshold. Any other baseline
motion-JPEG AVI is read too, frame by frame (jpeg.py), of any size, colour and tables: by its idx1 index, or by
its chunks where it has none, and further RIFF AVIX parts by theirs.

Defined results: a null or empty text is a payload of 64 zero bytes. Equal bytes give equal files and features. In
`media_clips` a null file has no rows, and a file that is damaged, not an AVI or not baseline motion-JPEG has one row whose clip
fields are null and whose `error` says why. An empty index entry repeats the frame before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.jpeg import DCT, ZIGZAG, decode, histogram
from readloom.llm.shared import slices, text_buffers

SIDE, BLOCKS, BITS = 64, 64, 10
FRAME = BLOCKS * 64
MICROSECONDS = 40_000
#: A cut needs a histogram difference over FLOOR and over mean + SPREAD * deviation of up to WINDOW differences before it.
FLOOR, SPREAD, WINDOW = 0.2, 3.0, 8


#: Whole numbers in doubles: products and sums stay below 2^53, so any order of summation gives the same result.
_DCT_INT = np.round(DCT * 1024)


def huffman(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, length), from symbol -> length."""
    out, code, length = {}, 0, 0
    for symbol, bits in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        code <<= bits - length
        length = bits
        out[symbol] = (code, bits)
        code += 1
    return out


def _code(value: int, codes: dict[int, tuple[int, int]]) -> int:
    size = abs(value).bit_length()
    return codes[size][0] << size | (value if value > 0 else value + (1 << size) - 1 if value else 0)


_DC_SIZES = {s: BITS - s for s in range(9)}
_AC_SIZES = {s: BITS - s for s in range(1, 9)}
_AC_VALUE = np.array([b - 128 if b < 128 else b - 127 for b in range(256)])  # never 0, so no run of zeros is coded
_AC_CODE = np.array([_code(int(v), huffman(_AC_SIZES)) for v in _AC_VALUE], np.uint64)
_DC_CODE = np.array([_code(d, huffman(_DC_SIZES)) for d in range(-255, 256)], np.uint64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, sizes: dict[int, int]) -> bytes:
    order = sorted(sizes, key=lambda s: (sizes[s], s))
    return _segment(0xC4, bytes([kind, *(sum(n == k for n in sizes.values()) for k in range(1, 17)), *order]))


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0] + [1] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0]))
    + _table(0x00, _DC_SIZES)
    + _table(0x10, _AC_SIZES)
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def _pack(codes: np.ndarray) -> np.ndarray:
    """Ten-bit codes, four to five bytes."""
    quads = codes.reshape(-1, 4)
    words = quads[:, 0] << np.uint64(30) | quads[:, 1] << np.uint64(20) | quads[:, 2] << np.uint64(10) | quads[:, 3]
    return words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1)


def _unpack(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, 3:] = data.reshape(-1, 5)
    words = wide.view(">u8").astype(np.uint64).reshape(-1, 1)
    return (words >> np.array([30, 20, 10, 0], np.uint64) & np.uint64(1023)).astype(np.int64).reshape(-1)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes) -> bytes:
    """An AVI whose frames hold the payload; the last frame is filled with zero bytes."""
    frames = max(1, -(-len(payload) // FRAME))
    blocks = np.frombuffer(payload + bytes(frames * FRAME - len(payload)), np.uint8).reshape(frames, BLOCKS, 64)
    codes = _AC_CODE[blocks]
    codes[:, :, 0] = _DC_CODE[np.diff(blocks[:, :, 0].astype(np.int64) - 128, axis=1, prepend=0) + 255]
    packed = _pack(codes.reshape(-1)).tobytes()
    width = BLOCKS * 64 * BITS // 8
    pictures = [_chunk(b"00dc", _HEAD + packed[i : i + width].replace(b"\xff", b"\xff\0") + b"\xff\xd9") for i in range(0, len(packed), width)]
    largest = max(map(len, pictures))
    avih = struct.pack("<14I", MICROSECONDS, largest * 25, 0, 0x10, frames, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, MICROSECONDS, 1_000_000, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    index, at = [], 4
    for p in pictures:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, struct.unpack_from("<I", p, 4)[0]))
        at += len(p)
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"movi" + b"".join(pictures)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk is longer than its list")
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


class Avi:
    """Parsed container: payload length, microseconds a frame, and the (start, end) of each frame of its video stream."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        self.data, self.frames, self.length, self.step = data, [], None, 0
        self.streams, self.video, movi, index = 0, None, None, []
        end = 8 + struct.unpack_from("<I", data, 4)[0]
        for name, a, b in _walk(data, 12, end):
            if name == b"LIST" and data[a : a + 4] == b"movi":
                movi = a, b
            elif name == b"LIST":
                self._header(a + 4, b)
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, k) for k in range(a, b - 15, 16)]
        if self.video is None or movi is None:
            raise ValueError("no motion-JPEG stream")
        self.step = self.step or MICROSECONDS
        if index:
            self._indexed(index, movi[0])
        else:
            self._chunks(movi[0] + 4, movi[1])
        at = end + end % 2
        while data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] == b"AVIX":
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            for name, a, b in _walk(data, at + 12, end):
                if name == b"LIST" and data[a : a + 4] == b"movi":
                    self._chunks(a + 4, b)
            at = end + end % 2

    def _header(self, a: int, b: int) -> None:
        data, pending = self.data, None
        for name, c, d in _walk(data, a, b):
            if name == b"avih":
                self.step = struct.unpack_from("<I", data, c)[0]
            elif name == b"LIST" and data[c : c + 4] == b"strl":
                self._header(c + 4, d)
                self.streams += 1
            elif name == b"strh" and data[c : c + 4] == b"vids" and self.video is None:
                pending = data[c + 4 : c + 8]
                scale, rate = struct.unpack_from("<II", data, c + 20)
                self.step = self.step or (scale * 1_000_000 // rate if rate else 0)
            elif name == b"strf" and pending is not None:
                if not {pending.upper(), data[c + 16 : c + 20].upper()} & {b"MJPG", b"AVI1", b"JPEG"}:
                    raise ValueError("the video stream is not motion-JPEG")
                self.video = {b"%02dd%c" % (self.streams, kind) for kind in b"cb"}
            elif name == b"ICMT" and data[c : c + 8] == b"payload=" and data[c + 8 : d].rstrip(b"\0").isdigit():
                self.length = int(data[c + 8 : d].rstrip(b"\0"))

    def _indexed(self, index: list[tuple[bytes, int, int, int]], movi: int) -> None:
        """Frames of idx1; its offsets count from the list's name or, in some files, from the file's start."""
        own = [(kind, offset, size) for kind, _, offset, size in index if kind in self.video]
        if own and self.data[movi + own[0][1] : movi + own[0][1] + 4] != own[0][0]:
            movi = 0
        for kind, offset, size in own:
            start = movi + offset + 8
            if self.data[start - 8 : start - 4] != kind or start + size > len(self.data):
                raise ValueError("the index does not point at a frame")
            self.frames.append((start, start + size))

    def _chunks(self, a: int, b: int) -> None:
        for name, c, d in _walk(self.data, a, b):
            if name in self.video:
                self.frames.append((c, d))
            elif name == b"LIST" and self.data[c : c + 4] == b"rec ":
                self._chunks(c + 4, d)


def _is_own(frame: bytes) -> bool:
    """Whether a frame has the ten-bit tables and so can be read by look-ups of whole codes."""
    return frame.startswith(_HEAD) and frame.endswith(b"\xff\xd9")


def _scan_of(frame: bytes) -> bytes:
    """Unstuffed entropy-coded bytes of a frame with the ten-bit tables."""
    return frame[len(_HEAD) : -2].replace(b"\xff\0", b"\xff")


_AC_BYTE = np.zeros(1024, np.uint8)
_AC_BYTE[_AC_CODE.astype(np.int64)] = np.arange(256)
_DC_DIFF = np.zeros(1024, np.int64)
_DC_DIFF[_DC_CODE.astype(np.int64)] = np.arange(-255, 256)


def decode_frames(scans: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of joined frames: the stored bytes (frames, 64, 64) and the grey pictures' 16-bin histograms (frames, 16)."""
    codes = _unpack(np.frombuffer(scans, np.uint8)).reshape(-1, BLOCKS, 64)
    kept = _AC_BYTE[codes]
    kept[:, :, 0] = np.cumsum(_DC_DIFF[codes[:, :, 0]], axis=1) + 128
    values = np.empty(kept.shape)
    values[:, :, ZIGZAG] = _AC_VALUE[kept]
    values[:, :, 0] = kept[:, :, 0].astype(np.int64) - 128
    values = values.reshape(-1, 8, 8)
    pixels = np.matmul(np.matmul(_DCT_INT.T, values), _DCT_INT)
    bins = np.clip(np.floor(pixels / 2**20 + 0.5) + 128, 0, 255).astype(np.int64).reshape(len(kept), -1) >> 4
    bins += np.arange(len(kept))[:, None] * 16
    return kept, np.bincount(bins.reshape(-1), minlength=len(kept) * 16).reshape(-1, 16)


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges of shots, ends exclusive."""
    shares = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1e-9)
    differences = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    cuts = []
    for i, d in enumerate(differences):
        seen = differences[max(0, i - WINDOW) : i]
        if d > FLOOR and (not len(seen) or d > seen.mean() + SPREAD * seen.std()):
            cuts.append(i + 1)
    bounds = [0, *cuts, len(histograms)]
    return list(zip(bounds, bounds[1:], strict=False))


def _histograms(avi: Avi) -> np.ndarray:
    """Brightness histograms of any baseline frames."""
    out: list[np.ndarray] = []
    for a, b in avi.frames:
        if a < b:
            out.append(histogram(decode(avi.data[a:b])))
        elif out:
            out.append(out[-1])
        else:
            raise ValueError("the first frame is empty")
    return np.array(out).reshape(-1, 16)


def read_avi(data: bytes) -> tuple[bytes | None, list[tuple[int, int, float, float]]]:
    """The payload of a file that encode_avi wrote (else None) and the clips: first frame, end frame, start and end in seconds.

    Raises ValueError for anything but a whole baseline motion-JPEG AVI."""
    try:
        avi = Avi(data)
    except struct.error as error:
        raise ValueError(f"a header is cut short: {error}") from error
    if avi.length is not None and all(_is_own(data[a:b]) for a, b in avi.frames):
        scans = [_scan_of(data[a:b]) for a, b in avi.frames]
        if any(len(x) != BLOCKS * 64 * BITS // 8 for x in scans):
            raise ValueError("a scan is not as long as its blocks")
        kept, histograms = decode_frames(b"".join(scans))
        payload = kept.tobytes()[: avi.length]
    else:
        payload, histograms = None, _histograms(avi)
    clips = [(a, b, a * avi.step / 1e6, b * avi.step / 1e6) for a, b in shots(histograms) if a < b]
    return payload, clips


def payload_of(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 if raw else 64)


def encode_media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs with a binary column: each text's bytes as an AVI file."""

    @F.pandas_udf("binary")
    def encode(texts):
        return texts.map(lambda x: encode_avi(payload_of((x or "").encode())))

    return docs.withColumn(out, encode(F.col(text)))


def media_clips(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each shot: df's other columns, clip, first_frame, end_frame, start_s, end_s, error (null in a good file).

    Columns of df that are named like one of these keep their values in a struct column `input`."""
    names = ("first_frame", "end_frame", "start_s", "end_s", "error")

    @F.pandas_udf("array<struct<first_frame: int, end_frame: int, start_s: double, end_s: double, error: string>>")
    def clips(files):
        def rows(x):
            if x is None:
                return []
            try:
                return [dict(zip(names, (*c, None), strict=True)) for c in read_avi(bytes(x))[1]]
            except ValueError as error:
                return [dict.fromkeys(names) | {"error": str(error)}]

        return files.map(rows)

    taken = {"clip", "input", *names}
    clash = [c for c in df.columns if c != media and c.lower() in taken]
    kept = [F.col(f"`{c}`") for c in df.columns if c != media and c not in clash]
    if clash:
        kept.append(F.struct(*(F.col(f"`{c}`") for c in clash)).alias("input"))
    found = df.select(F.struct(*kept).alias("_rest") if kept else F.lit(None).alias("_rest"), F.posexplode(clips(F.col(f"`{media}`"))).alias("clip", "_clip"))
    return found.select(*(["_rest.*"] if kept else []), F.when(F.col("_clip.error").isNull(), F.col("clip")).alias("clip"), "_clip.*")


def media_digest(docs: DataFrame) -> DataFrame:
    """Store each text as an AVI, read the stored bytes back and describe both."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            rows = []
            for lo, hi in slices(offsets, 1 << 20):
                files = [encode_avi(payload_of(data[offsets[i] : offsets[i + 1]].tobytes())) for i in range(lo, hi)]
                opened = [Avi(f) for f in files]
                scans = [_scan_of(f[a:b]) for f, avi in zip(files, opened, strict=True) for a, b in avi.frames]
                kept, histograms = decode_frames(b"".join(scans))
                at = 0
                for i, (f, avi) in enumerate(zip(files, opened, strict=True), lo):
                    n = len(avi.frames)
                    payload = kept[at : at + n].tobytes()[: avi.length]
                    clips = shots(histograms[at : at + n])
                    feature = f"frames={n};clips=" + ",".join(f"{a * avi.step / 1e6:.2f}-{b * avi.step / 1e6:.2f}" for a, b in clips)
                    rows.append((int(offsets[i + 1] - offsets[i]), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), sha256(f).hexdigest(), feature))
                    at += n
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""BGZF files: blocks from any byte, and the decompressed stream from any block.

A position is a block's offset in the file and a place in its decompressed bytes; the end of a file is (its size, 0).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from readloom.errors import LoomError

MAGIC, MOST = b"\x1f\x8b\x08\x04", 1 << 16


def block_size(head: bytes) -> int:
    """Bytes of the block that begins with head (18 bytes or more), or 0 if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 6 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def inflated(block: bytes, path: str) -> bytes:
    try:
        made = zlib.decompress(block[12 + struct.unpack_from("<H", block, 10)[0] : -8], -15)
    except (zlib.error, struct.error) as e:
        raise LoomError("input_corrupt", "a BGZF block can't be decompressed", path) from e
    if len(block) < 26 or struct.unpack("<II", block[-8:]) != (zlib.crc32(made), len(made)):
        raise LoomError("input_corrupt", "a BGZF block fails its checksum", path)
    return made


def blocks(path: str, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """Offset and decompressed bytes of each block from the one at start on."""
    with open(path, "rb") as file:
        file.seek(start)
        held, at = b"", 0
        while True:
            if len(held) - at < MOST:
                held, at = held[at:] + file.read(64 * MOST), 0
            if at == len(held):
                return
            size = block_size(held[at : at + MOST])
            if not size:
                raise LoomError("input_corrupt", "a BGZF block has a bad header", path)
            if size > len(held) - at:
                raise LoomError("input_corrupt", "the file ends inside a block", path)
            yield start, inflated(held[at : at + size], path)
            at, start = at + size, start + size


def next_block(path: str, start: int) -> int:
    """Offset of the first block at or behind a byte, or the file's size.

    What looks like a block has to decompress and to be followed by another or by the end. Stored data may still hold such bytes;
    whoever splits a file has to compare with the block that the split before ended at."""
    with open(path, "rb") as file:
        size = file.seek(0, 2)
        base, held = start, b""
        while base < size:
            file.seek(base)
            held = file.read(4 * MOST)
            at = held.find(MAGIC)
            while 0 <= at < len(held) - (2 * MOST if base + len(held) < size else 0):
                length = block_size(held[at : at + MOST])
                after = at + length
                if length and after <= len(held) and (base + after == size or block_size(held[after : after + MOST])):
                    try:
                        inflated(held[at:after], path)
                        return base + at
                    except LoomError:
                        pass
                at = held.find(MAGIC, at + 1)
            if base + len(held) >= size:
                return size
            base += len(held) - 2 * MOST
        return size


class Stream:
    """Decompressed bytes from a block on, read forward, with the position of each."""

    def __init__(self, path: str, start: int = 0):
        self.path, self.source = path, blocks(path, start)
        self.data, self.at, self.dropped = b"", 0, 0
        self.starts: list[tuple[int, int]] = []  # where a block's bytes begin in the stream, and its offset in the file

    def need(self, n: int) -> bool:
        """Whether n bytes follow."""
        if len(self.data) - self.at < n:
            self.drop()
            parts, held = [self.data], len(self.data)
            for offset, made in self.source:
                if made:
                    self.starts.append((self.dropped + held, offset))
                    parts.append(made)
                    held += len(made)
                    if held >= n:
                        break
            self.data = b"".join(parts)
        return len(self.data) - self.at >= n

    def drop(self) -> None:
        """Forget what has been read."""
        self.dropped += self.at
        self.data, self.at = self.data[self.at :], 0
        while len(self.starts) > 1 and self.starts[1][0] <= self.dropped:
            self.starts.pop(0)

    def take(self, n: int) -> bytes:
        if n < 0 or not self.need(n):
            raise LoomError("input_corrupt", "the file ends inside a record", self.path)
        self.at += n
        return self.data[self.at - n : self.at]

    def position(self, size: int) -> tuple[int, int]:
        """Of the next byte; (size, 0) at the end."""
        if not self.need(1):
            return size, 0
        here = self.dropped + self.at
        begin, offset = next((b, o) for b, o in reversed(self.starts) if b <= here)
        return offset, here - begin

"""BED3 to BED12 files and FASTA checks. Both are small beside the reads and depend on line order, so the driver parses them."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from readloom.errors import LoomError

TARGET_SCHEMA = "source_index bigint, line_number bigint, ref_id int, contig string, contig_length bigint, start bigint, stop bigint, name string, extra_fields array<string>"


@dataclass
class Bed:
    """Rows by TARGET_SCHEMA, the file's digest and size, and how many lines ended in CRLF."""

    rows: list[tuple]
    sha256: str
    size: int
    crlf_lines: int = 0
    skipped: list[int] = field(default_factory=list)


def _place(text: str, line: int) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text, re.ASCII) or int(text) >= 2**63:
        raise LoomError("target_format", f"line {line} has a bad coordinate")
    return int(text)


def parse_bed(data: bytes, contigs: list[tuple[str, int]]) -> Bed:
    """Intervals in file order; contigs: (name, length) in header order. Empty intervals are kept."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise LoomError("target_format", "the targets are not UTF-8") from e
    known = {name: (i, length) for i, (name, length) in enumerate(contigs)}
    bed, width = Bed([], hashlib.sha256(data).hexdigest(), len(data)), None
    for number, line in enumerate(text.split("\n"), 1):
        if line.endswith("\r"):
            line = line[:-1]
            bed.crlf_lines += 1
        line = line.rstrip(" \t")
        left = line.lstrip()
        if not left or left.startswith("#") or left.split()[0] in ("track", "browser"):
            bed.skipped.append(number)
            continue
        if "\t" in line and "" in line.split("\t"):
            raise LoomError("target_format", f"line {number} has an empty field")
        fields = line.split()
        if not 3 <= len(fields) <= 12 or (width is not None and len(fields) != width):
            raise LoomError("target_format", f"line {number} has {len(fields)} fields")
        width = len(fields)
        start, stop = _place(fields[1], number), _place(fields[2], number)
        if fields[0] not in known:
            raise LoomError("target_contig", f"line {number} names an unknown contig", fields[0])
        ref, length = known[fields[0]]
        if start > stop or stop > length:
            raise LoomError("target_format", f"line {number} lies outside its contig or ends before it begins")
        bed.rows.append((len(bed.rows), number, ref, fields[0], length, start, stop, fields[3] if width > 3 else None, fields[4:]))
    return bed


def read_bed(spark: SparkSession, path: str, contigs: list[tuple[str, int]]) -> tuple[DataFrame, Bed]:
    try:
        with open(path, "rb") as file:
            bed = parse_bed(file.read(), contigs)
    except OSError as e:
        raise LoomError("input_not_found", "the targets can't be opened", path) from e
    return spark.createDataFrame(bed.rows, TARGET_SCHEMA), bed


def fasta_contigs(path: str) -> dict[str, tuple[int, str]]:
    """Length and MD5 (printable bases, upper case) of every contig, from one pass over the lines."""
    found: dict[str, list] = {}
    name = None
    with open(path, "rb") as file:
        for line in file:
            if line.startswith(b">"):
                name = (line[1:].split() or [b""])[0].decode()
                if not name or name in found:
                    raise LoomError("reference_mismatch", "the reference repeats a contig or has one without a name")
                found[name] = [0, hashlib.md5(usedforsecurity=False)]
            elif name is None and line.strip():
                raise LoomError("reference_mismatch", "the reference does not begin with a contig")
            elif name is not None:
                bases = bytes(b for b in line if 33 <= b <= 126).upper()
                found[name][0] += len(bases)
                found[name][1].update(bases)
    return {n: (length, digest.hexdigest()) for n, (length, digest) in found.items()}


def check_reference(contigs: list[tuple[str, int]], md5: dict[str, str], reference: dict[str, tuple[int, str]]) -> None:
    """Every contig must be in the reference with its length and, where the header gives one, its MD5."""
    for name, length in contigs:
        if name not in reference:
            raise LoomError("reference_mismatch", "a contig is not in the reference", name)
        if reference[name][0] != length or md5.get(name, reference[name][1]) != reference[name][1]:
            raise LoomError("reference_mismatch", "a contig differs from the reference", name)

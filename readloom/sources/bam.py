"""BAM files as DataFrames, split inside files and decoded by columns.

read_bam() cuts each file into byte ranges. A range owns the records that begin in blocks that begin in it. A first pass finds in every
range a block and a record to begin with, walks the records' lengths to the first record of the next range, and counts them. Where a
range does not begin at the record that the one before ended at (compressed data may look like anything), it is walked again from there, until
all agree; so the ranges join to the records of one walk from the file's start. The second pass decodes, with rec_index (from 1, on
through the files in the order of their names) from the counts before. Files must be in a folder that executors reach.

A record's fixed fields, names, operations, bases, qualities and tags are gathered from the decompressed buffer as arrays; columns that are not
asked for are not touched. spark.read.format("bam").schema(...) reads a file a task with the columns of that schema.
Bad bytes end the read with an error of category input_corrupt.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from readloom.errors import LoomError
from readloom.functions.sam import DERIVED_SCHEMA, READ_SCHEMA
from readloom.functions.storage import written
from readloom.sources.bgzf import Stream, next_block

_BASES = "=ACMGRSVTWYHKDBN"
_FIXED = struct.Struct("<iiBBHHHiiii")
_HEAD = np.dtype([("size", "<i4"), ("ref_id", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate_ref_id", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
_PAIRS = np.array([[ord(_BASES[b >> 4]), ord(_BASES[b & 15])] for b in range(256)], np.uint8)
MAX_RECORD, MAX_AUX, BATCH_BYTES, SPLIT_BYTES = 256 << 20, 65_536, 4 << 20, 32 << 20
_SIZES = np.zeros(256, np.int64)
for _kind, _size in {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}.items():
    _SIZES[ord(_kind)] = _size
_TAGS = {"nm": b"NM", "md": b"MD", "rg": b"RG", "xn": b"XN"}


def sniff(path: str) -> str:
    """'bam' for BGZF with BAM inside; CRAM has no decoder here."""
    try:
        with open(path, "rb") as file:
            head = file.read(4)
    except OSError as e:
        raise LoomError("input_not_found", "the input can't be opened", path) from e
    if head == b"CRAM":
        raise LoomError("input_format", "CRAM has to be converted to BAM or Parquet first", path)
    if head[:2] != b"\x1f\x8b" or Stream(path).take(4) != b"BAM\1":
        raise LoomError("input_format", "neither BAM nor CRAM", path)
    return "bam"


class Header:
    """Text, contigs (name, length) in order, read-group ids with their declarations, and an identity."""

    def __init__(self, stream: Stream):
        if stream.take(4) != b"BAM\1":
            raise LoomError("input_format", "not a BAM file", stream.path)
        raw = stream.take(struct.unpack("<i", stream.take(4))[0])
        self.text = raw.rstrip(b"\0").decode("utf-8", "replace")
        self.contigs: list[tuple[str, int]] = []
        for _ in range(struct.unpack("<i", stream.take(4))[0]):
            name = stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode()
            self.contigs.append((name, struct.unpack("<I", stream.take(4))[0]))
        self.md5: dict[str, str] = {}
        self.read_groups: list[str] = []
        self._check()
        digest = hashlib.sha256(b"readloom-header\0" + struct.pack("<Q", len(raw)) + raw)
        for name, length in self.contigs:
            digest.update(struct.pack("<Q", len(name)) + name.encode() + struct.pack("<Q", length))
        self.identity = digest.hexdigest()

    def _check(self) -> None:
        listed, heads = [], 0
        for line in self.text.splitlines():
            if not line.startswith("@"):
                raise LoomError("input_format", "a header line does not begin with @")
            kind, *fields = line.split("\t")
            if kind == "@CO":
                continue
            tags: dict[str, str] = {}
            for f in fields:
                key, _, value = f.partition(":")
                if key in tags:
                    raise LoomError("input_format", f"a header line repeats {key}")
                tags[key] = value
            heads += kind == "@HD"
            if kind == "@SQ":
                if not tags.get("LN", "").isdigit():
                    raise LoomError("input_format", "a contig has a bad length")
                listed.append((tags.get("SN", ""), int(tags["LN"])))
                if "M5" in tags:
                    self.md5[tags["SN"]] = tags["M5"].lower()
            elif kind == "@RG":
                self.read_groups.append(tags.get("ID", ""))
        names = [n for n, _ in self.contigs]
        if heads > 1 or len(set(names)) < len(names):
            raise LoomError("input_format", "the header repeats @HD or a contig")
        if listed and listed != self.contigs:
            raise LoomError("input_format", "the header's text and binary contigs differ")


def read_header(path: str) -> Header:
    """Of a file, or of the first file of a folder."""
    first = files_of(path)[0]
    sniff(first)
    return Header(Stream(first))


def files_of(path: str) -> list[str]:
    """The BAM files of a folder by name, or the file itself."""
    found = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".bam")) if os.path.isdir(path) else [path]
    if not found:
        raise LoomError("input_not_found", "the folder has no BAM file", path)
    return found


# Splits


def _plausible(data: np.ndarray, n_refs: int) -> np.ndarray:
    """Offsets that may begin a record: lengths that fit each other, places on known contigs, a name that ends in its zero byte."""
    n = len(data) - 35
    if n <= 0:
        return np.zeros(0, np.int64)
    wide = np.lib.stride_tricks.sliding_window_view(data, 4)
    number = lambda at: wide[at : at + n].copy().view("<i4")[:, 0]
    size, ref, pos, l_seq, mate, mate_pos = (number(at).astype(np.int64) for at in (0, 4, 8, 20, 24, 28))
    l_name, n_ops = data[12 : 12 + n].astype(np.int64), data[16 : 16 + n].astype(np.int64) + 256 * data[17 : 17 + n].astype(np.int64)
    fits = (size >= 32) & (size <= MAX_RECORD) & (ref >= -1) & (ref < n_refs) & (pos >= -1) & (l_name >= 1) & (l_seq >= 0) & (mate >= -1) & (mate < n_refs) & (mate_pos >= -1)
    found = np.flatnonzero(fits & (32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq <= size))
    end = found + 35 + l_name[found]
    inside = end < len(data)
    return found[inside & (data[np.minimum(end, len(data) - 1)] == 0)]


def first_record(path: str, start: int, n_refs: int, chain: int = 8) -> tuple[int, int] | None:
    """A guess of where the first record at or behind a byte begins: a head behind which more plausible heads follow."""
    size = os.path.getsize(path)
    block = next_block(path, start)
    if block >= size:
        return size, 0
    stream = Stream(path, block)
    if not stream.need(1):
        return size, 0
    stream.need(1 << 19)
    data = np.frombuffer(stream.data, np.uint8)
    heads = _plausible(data, n_refs)
    known = set(heads.tolist())
    for at in heads.tolist():
        seen, here = 0, at
        while seen < chain and here in known:
            here += 4 + struct.unpack_from("<i", stream.data, here)[0]
            seen += 1
        # Up to the end of what has been looked at, if fewer follow.
        if seen == chain or (seen and here > len(data) - 36 and (here <= len(data) or len(data) >= 1 << 19)):
            stream.at = at
            return stream.position(size)
    return None


def walk(path: str, start: tuple[int, int], stop: int) -> tuple[tuple[int, int], int]:
    """The first record behind `start` that begins in a block at or behind `stop`, and the number of records before it."""
    size = os.path.getsize(path)
    if start[0] >= min(stop, size):
        return start, 0
    stream, count = Stream(path, start[0]), 0
    stream.take(start[1])
    while True:
        place = stream.position(size)
        if place[0] >= min(stop, size):
            return place, count
        # All records that begin in this block.
        end = next((b for b, _ in stream.starts if b > stream.dropped + stream.at), stream.dropped + len(stream.data)) - stream.dropped
        while stream.at < end:
            dropped = stream.dropped
            length = struct.unpack("<i", stream.take(4))[0]
            _check_length(length, path)
            stream.take(length)
            end -= stream.dropped - dropped
            count += 1


def _check_length(length: int, path: str) -> None:
    if not 32 <= length <= MAX_RECORD:
        raise LoomError("input_corrupt" if length < 32 else "resource_limit", "a record has a bad length", path)


_PLAN = "file_no int, path string, split_no int, stop long, n_refs int, s_block long, s_in long, e_block long, e_in long, records long"


def plan_splits(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each byte range of each file: where its first record and the first one behind it begin, and how many it owns. Stored."""
    ranges, contigs = [], None
    for number, file in enumerate(files_of(path)):  # headers and sizes alone
        sniff(file)
        stream, size = Stream(file), os.path.getsize(file)
        header = Header(stream)
        if contigs is not None and header.contigs != contigs:
            raise LoomError("input_format", "the files of the folder have different contigs", file)
        contigs = header.contigs
        first = stream.position(size)
        step = max(1, split_bytes)
        ranges += [(number, file, k, min(lo + step, size), len(contigs), *(first if k == 0 else (None, None)), None, None, lo) for k, lo in enumerate(range(0, size, step))]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                sure = r["split_no"] == 0 or r["e_block"] == -1
                start = end = None
                try:
                    start = (r["s_block"], r["s_in"]) if r["s_block"] is not None else first_record(r["path"], r["records"], r["n_refs"])
                    if start is not None:
                        end, r["records"] = walk(r["path"], start, r["stop"])
                except LoomError:  # of a start that is not certain
                    if sure:
                        raise
                    start = end = None
                (r["s_block"], r["s_in"]), (r["e_block"], r["e_in"]) = start or (None, None), end or (None, None)
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    given = spark.createDataFrame(ranges, _PLAN)
    keep = lambda df: spark.read.schema(_PLAN).parquet(written(df, "bam-splits"))
    alone = lambda df, n: df.coalesce(1).repartition(n)  # noqa: E731  a range a task
    plan = keep(alone(given, len(ranges)).mapInArrow(found, _PLAN))
    along = Window.partitionBy("file_no").orderBy("split_no")
    while True:
        seams = plan.withColumns({"p_block": F.lag("e_block").over(along), "p_in": F.lag("e_in").over(along)})
        agree = (F.col("split_no") == 0) | (F.col("s_block").eqNullSafe(F.col("p_block")) & F.col("s_in").eqNullSafe(F.col("p_in")) & F.col("s_block").isNotNull())
        # Behind ranges that all agree a start is certain (e_block -1), else it is tried.
        before = F.coalesce(F.sum(F.when(F.col("agree"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seams = seams.withColumn("agree", agree).withColumn("certain", before == 0)
        wrong = seams.where(~F.col("agree") & F.col("p_block").isNotNull())
        n = wrong.count()
        if not n:
            return plan
        names = [c.split()[0] for c in _PLAN.split(", ")]
        again = wrong.withColumns({"s_block": F.col("p_block"), "s_in": F.col("p_in"), "e_block": F.when(F.col("certain"), -1).otherwise(-2).cast("long")}).select(*names)
        others = seams.where(F.col("agree") | F.col("p_block").isNull()).select(*names)
        plan = keep(others.union(alone(again, n).mapInArrow(found, _PLAN)))


def _schema(columns: list[str] | None = None) -> StructType:
    every = StructType.fromDDL(f"{READ_SCHEMA}, {DERIVED_SCHEMA}")
    return StructType([every[c] for c in columns or StructType.fromDDL(READ_SCHEMA).names])


def read_bam(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of a file or folder, a task for each split, with the columns asked for (all of READ_SCHEMA, if none are named)."""
    wanted = _schema(columns)
    plan = plan_splits(spark, path, split_bytes)
    files = plan.groupBy("file_no").agg(F.sum("records").alias("n"))
    # A row for each file, then rows of one file.
    bases = files.select("file_no", F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("records").over(Window.partitionBy("file_no").orderBy("split_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = plan.withColumn("index", before).join(bases, "file_no").where("records > 0").select("path", "stop", "s_block", "s_in", "records", (F.col("index") + F.col("base") + 1).alias("index"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from decoded(r["path"], wanted, (r["s_block"], r["s_in"]), r["records"], r["index"])

    return numbered.coalesce(1).repartition(max(1, plan.count())).mapInArrow(read, wanted)


# Decoding


def offsets_of(data: bytes, limit: int) -> tuple[list[int], int]:
    """Where the whole records of a buffer begin, `limit` at most, and where the rest begins."""
    found, at, n = [], 0, len(data)
    unpack = struct.Struct("<i").unpack_from
    while len(found) < limit and at + 4 <= n:
        length = unpack(data, at)[0]
        if not 32 <= length <= MAX_RECORD:
            _check_length(length, "")
        if at + 4 + length > n:
            break
        found.append(at)
        at += 4 + length
    return found, at


def decoded(path: str, schema: StructType, start: tuple[int, int] | None = None, records: int | None = None, index: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches of the schema's columns of so many records from a position on; of all records, if none is given."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    stream = Stream(path, start[0] if start else 0)
    if start:
        stream.take(start[1])
    else:
        Header(stream)
    left = records if records is not None else 1 << 62
    while left:
        enough, wanted = stream.need(BATCH_BYTES), BATCH_BYTES
        stream.drop()
        found, end = offsets_of(stream.data, left)
        while not found and enough:  # one record is larger than the batch
            wanted *= 2
            enough = stream.need(wanted)
            found, end = offsets_of(stream.data, left)
        if not found:
            if stream.data or records is not None:
                raise LoomError("input_corrupt", "the file ends inside a record", path)
            return
        yield _columns(np.frombuffer(stream.data, np.uint8)[:end], np.array(found, np.int64), arrow, index, path)
        stream.at = end
        left, index = left - len(found), index + len(found)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of all bytes of ranges, one after the other."""
    total = int(length.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)


def _text(data: np.ndarray, start: np.ndarray, length: np.ndarray, kind: pa.DataType, there: np.ndarray | None = None) -> pa.Array:
    """Byte ranges as an array of text or bytes; bytes beyond ASCII are replaced in text."""
    raw = data[_ranges(start, length)]
    if pa.types.is_string(kind) and (raw >= 128).any():
        ends = np.cumsum(length)
        return pa.array([bytes(raw[e - n : e]).decode("ascii", "replace") if there is None or t else None for e, n, t in zip(ends, length, there if there is not None else ends, strict=True)], kind)
    offsets = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    mask = None if there is None or there.all() else pa.py_buffer(np.packbits(there, bitorder="little"))
    return pa.Array.from_buffers(kind, len(length), [mask, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _columns(data: np.ndarray, at: np.ndarray, schema: pa.Schema, index: int, path: str) -> pa.RecordBatch:
    head = data[at[:, None] + np.arange(36)].reshape(-1).view(_HEAD)
    l_seq, n_ops, l_name = head["l_seq"].astype(np.int64), head["n_ops"].astype(np.int64), head["l_name"].astype(np.int64)
    ops_at = at + 36 + l_name
    seq_at = ops_at + 4 * n_ops
    qual_at, stop = seq_at + (l_seq + 1) // 2, at + 4 + head["size"]
    if (l_seq < 0).any() or (qual_at + l_seq > stop).any():
        raise LoomError("input_corrupt", "a record is shorter than its parts", path)
    tags = _tags(data, qual_at + l_seq, stop) if {*_TAGS} & {*schema.names} else {}
    made = []
    for field in schema:
        name = field.name
        if name == "rec_index":
            column = pa.array(np.arange(index, index + len(at)))
        elif name == "seq_length":
            column = pa.array(l_seq)
        elif name in head.dtype.names:
            column = pa.array(head[name].astype(np.int64)).cast(field.type)
        elif name == "qname":
            column = _text(data, at + 36, np.maximum(l_name - 1, 0), pa.string())
        elif name == "cigar":
            packed = data[_ranges(ops_at, 4 * n_ops)].view("<u4")
            parts = pa.StructArray.from_arrays([pa.array((packed >> 4).astype(np.int32)), pa.array((packed & 15).astype(np.int32))], fields=list(field.type.value_type))
            column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_ops)).astype(np.int32)), parts).cast(field.type)
        elif name == "seq":
            length = (l_seq + 1) // 2
            letters = _PAIRS[data[_ranges(seq_at, length)]].reshape(-1)
            column = _text(letters, 2 * (np.cumsum(length) - length), l_seq, pa.string())
        elif name == "qual":
            column = _text(data, qual_at, l_seq, pa.binary())
        else:
            column = tags[name] if name in tags else pa.nulls(len(at), field.type)
        made.append(column.cast(field.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _tags(data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> dict[str, pa.Array]:
    """NM, MD, RG and XN of all records, whose tags are read side by side: each step takes every record's next one."""

    def corrupt(test: np.ndarray, what: str = "the auxiliary fields are malformed", category: str = "input_corrupt") -> None:
        if test.any():
            raise LoomError(category, what)

    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    zeros, high = np.flatnonzero(data == 0), np.append(0, np.cumsum(data >= 128))
    n, at = len(at), at.copy()
    begin, length, kinds = {t: np.full(n, -1) for t in _TAGS}, {t: np.zeros(n, np.int64) for t in _TAGS}, {t: np.zeros(n, np.uint8) for t in _TAGS}
    for step in range(MAX_AUX + 1):
        rows = np.flatnonzero(at < stop)
        if not len(rows):
            break
        if step == MAX_AUX:
            raise LoomError("input_corrupt", "a record has too many auxiliary fields")
        here = at[rows]
        corrupt(here + 3 > stop[rows])
        first, second, kind = data[here], data[here + 1], data[here + 2]
        corrupt((first >= 128) | (second >= 128))
        value, size = here + 3, _SIZES[kind].copy()
        text, listed = (kind == ord("Z")) | (kind == ord("H")), kind == ord("B")
        corrupt((size == 0) & ~text & ~listed)
        if text.any():
            k = np.searchsorted(zeros, value[text])
            corrupt(k >= len(zeros))
            end = zeros[k]
            corrupt(end >= stop[rows][text])
            corrupt(high[end] > high[value[text]])
            size[text] = end - value[text] + 1
        if listed.any():
            corrupt(value[listed] + 5 > stop[rows][listed])
            inner = _SIZES[data[value[listed]]]
            corrupt(inner == 0)
            size[listed] = 5 + inner * padded[value[listed][:, None] + np.arange(1, 5)].reshape(-1).view("<u4").astype(np.int64)
        corrupt(value + size > stop[rows])
        corrupt((first == ord("C")) & (second == ord("G")), "a long CIGAR is stored in CG", "unsupported_record")
        for name, tag in _TAGS.items():
            hit = (first == tag[0]) & (second == tag[1])
            if hit.any():
                of = rows[hit]
                corrupt(begin[name][of] >= 0, f"tag {tag.decode()} is repeated")
                begin[name][of], length[name][of], kinds[name][of] = value[hit], size[hit], kind[hit]
        at[rows] = value + size
    out = {}
    for name, tag in _TAGS.items():
        there = begin[name] >= 0
        if name in ("md", "rg"):
            corrupt(there & ~np.isin(kinds[name], (ord("Z"), ord("H"))), f"tag {tag.decode()} is of a wrong kind")
            out[name] = _text(data, np.maximum(begin[name], 0), np.where(there, length[name] - 1, 0), pa.string(), there)
            continue
        corrupt(there & ~np.isin(kinds[name], [ord(c) for c in "cCsSiI"]), f"tag {tag.decode()} is of a wrong kind")
        raw = padded[np.maximum(begin[name], 0)[:, None] + np.arange(4)]
        value = np.zeros(n, np.int64)
        for kind, dtype in {"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4"}.items():
            of = kinds[name] == ord(kind)
            value[of] = np.ascontiguousarray(raw[of][:, : np.dtype(dtype).itemsize]).reshape(-1).view(dtype)
        if name == "nm":
            corrupt(there & (value < 0), "tag NM is negative")
            out[name] = pa.array(value, mask=~there)
        else:
            out[name] = pa.array(value == 1, mask=~there)
    return out


def records(path: str, columns: list[str]) -> Iterator[dict]:
    """A file's records as dictionaries, for small files and tests."""
    for batch in decoded(path, _schema(columns)):
        yield from batch.to_pylist()


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.fields = path, schema

    def partitions(self) -> list[InputPartition]:
        found = files_of(self.path)
        for f in found:
            sniff(f)
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from decoded(partition.value, self.fields)


class BamSource(DataSource):
    """Option: path. The schema given by .schema(...) says which columns are decoded; rec_index starts at 1 in each file."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


def write_bam(path: str, contigs: list[tuple[str, int]], reads: list[dict], header: str | None = None, block: int = 60_000) -> None:
    """Write a small BAM, for tests and examples. reads: dictionaries by READ_SCHEMA's names; absent values have defaults."""
    text = header if header is not None else "".join(["@HD\tVN:1.6\n", *(f"@SQ\tSN:{n}\tLN:{length}\n" for n, length in contigs)])
    body = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    for n, length in contigs:
        body += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<I", length)
    for r in reads:
        name, seq, ops = r["qname"].encode() + b"\0", r.get("seq") or "", r.get("cigar") or []
        codes = [_BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        aux = b""
        if r.get("nm") is not None:
            aux += b"NMi" + struct.pack("<i", r["nm"])
        for tag, key in ((b"MDZ", "md"), (b"RGZ", "rg")):
            aux += tag + r[key].encode() + b"\0" if r.get(key) else b""
        aux += b"XNC\1" if r.get("xn") else b""
        fixed = _FIXED.pack(r["ref_id"], r["pos"], len(name), r.get("mapq", 60), 0, len(ops), r["flag"], len(seq), r.get("mate_ref_id", -1), r.get("mate_pos", -1), r.get("tlen", 0))
        rec = fixed + name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + (r.get("qual") or bytes([30] * len(seq))) + aux
        body += struct.pack("<i", len(rec)) + rec
    with open(path, "wb") as out:
        for part in [*(body[i : i + block] for i in range(0, len(body), block)), b""]:
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = packer.compress(part) + packer.flush()
            out.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\6\0BC\2\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part)))

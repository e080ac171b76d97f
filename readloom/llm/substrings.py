"""Substring dedup by De Bruijn compaction (operator 7).

Windows are 20 words. Each window's anchor is its least 10-word k-mer, so equal windows have equal anchors, and
neighbouring windows mostly share one: the words under all windows of one anchor are a segment, the edge of the graph.
0. Documents with the same words as an earlier one are repeats as a whole and go no further.
1. A scan keeps, for each document, its segments, its number of words and the digest of all its words.
2. Segments whose anchor occurs twice go on, from one shuffle; windows on other anchors are unique. An anchor that a
   batch of documents holds many times sends one row there and deals the others, so a very common passage costs no single task.
3. An anchor with one segment at all its occurrences is an edge as a whole. Where segments differ (at the ends of a
   repeated passage), the windows on the anchor are edges of their own.
4. An edge with one successor at all its occurrences, as frequent as the edge itself, continues a nonbranching path.
   Joins of edges with their successors compact such paths; all edges of a path occur together.
5. Heads of paths are joined with their occurrences. The first source coordinate stays; at every other one the
   whole span is removed. Edges are identified by two independent 64-bit hashes, of k-mer and segment or of the window.

Defined results: a null text has no words. Documents of under 20 words lose nothing. Documents without an id come before
all others. Rows that share an id are ordered by their text's hash; rows alike in both are one document. Words are bytes
between white space, unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.shared import bounded, slices, stored, text_buffers, thinned
from readloom.llm.words import Words, power_tables, mix, windows

WINDOW, ANCHOR = 20, 10
_BY = WINDOW - ANCHOR + 1


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("h"), "text")


def window_anchors(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows inside one text: index of the first word, index of the anchor's first word, anchor hash."""
    kmers, at, numbers = windows(hashes, counts, ANCHOR, salt=8)
    inside = np.maximum(numbers - _BY + 1, 0)
    if not inside.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin = np.cumsum(numbers) - numbers
    first = np.arange(int(inside.sum())) + np.repeat(begin - (np.cumsum(inside) - inside), inside)
    least = np.lib.stride_tricks.sliding_window_view(kmers, _BY)[first].argmin(axis=1) + first
    return at[first], at[least], kmers[least]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(batch.column("text"))
    for lo, hi in slices(offsets, 1 << 19):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _profile(rows: DataFrame) -> DataFrame:
    """doc_id, d, h, n_words, all_sha256, and arrays over the document's segments: anchor, words' hash, place, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _texts(batch):
                words = Words(data, offsets, lower=False)
                start, anchor, hashes = window_anchors(words.hash, words.counts)
                at, size, segment = _segments(words, start, anchor)
                first = np.cumsum(words.counts) - words.counts
                cut = np.searchsorted(start[at], np.append(first, words.counts.sum())).astype(np.int32)
                position = (start[at] - np.repeat(first, np.diff(cut))).astype(np.int32)
                raw = [b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split()) for i in range(hi - lo)]
                part, listed = batch.slice(lo, hi - lo), lambda values: pa.ListArray.from_arrays(pa.array(cut), pa.array(values))  # noqa: B023
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("d"), part.column("h"), pa.array(words.counts), pa.array([sha256(x).hexdigest() for x in raw], pa.string()), listed(hashes[at].view(np.int64)), listed(segment.view(np.int64)), listed(position), listed(size.astype(np.int32))],
                    ["doc_id", "d", "h", "n_words", "all_sha256", "anchors", "segments", "positions", "sizes"],
                )

    return rows.mapInArrow(run, "doc_id long, d long, h long, n_words long, all_sha256 string, anchors array<long>, segments array<long>, positions array<int>, sizes array<int>")


def _segments(words: Words, start: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: index of the first window, number of windows, hash of the words under them."""
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    up, down = power_tables(len(words.hash) + 1)
    sums = np.zeros(len(words.hash) + 1, np.uint64)
    np.cumsum(mix(words.hash ^ np.uint64(0x2545F4914F6CDD1D)) * up[: len(words.hash)], out=sums[1:])
    low, high = start[first], start[first] + size + WINDOW - 1
    return first, size, mix((sums[high] - sums[low]) * down[low] + size.astype(np.uint64))


_SEGMENT = "anchor long, segment long, next long, d long, h long, pos int, size int"


def _segment_rows(profile: DataFrame) -> DataFrame:
    """Segments; next: the following segment's anchor, 0 at a text's end; again: whether the batch holds the anchor twice; salt.

    The first of a batch's rows of one anchor has salt 0 and stands for the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("anchors", "segments", "positions", "sizes")]
            anchor, segment, position, size = (x.flatten().to_numpy() for x in lists)
            number = np.diff(lists[0].offsets.to_numpy())
            following = np.zeros(len(anchor), np.int64)
            following[:-1] = anchor[1:]
            following[np.cumsum(number)[number > 0] - 1] = 0
            _, first, inverse, times = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            place = np.arange(len(anchor))
            salt = np.where(first[inverse] == place, 0, 1 + place % 1023).astype(np.int32)
            d, h = (np.repeat(batch.column(c).to_numpy(), number) for c in ("d", "h"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, segment, following, d, h, position, size, times[inverse] > 1, salt)], ["anchor", "segment", "next", "d", "h", "pos", "size", "again", "salt"])

    return profile.select("d", "h", "anchors", "segments", "positions", "sizes").mapInArrow(run, f"{_SEGMENT}, again boolean, salt int")


def _repeated_segments(rows: DataFrame) -> DataFrame:
    """Segments whose anchor occurs twice, from one shuffle and sort; a run of one anchor is streamed, not gathered."""
    names = ["anchor", "segment", "next", "d", "h", "pos", "size", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, if its anchor may still be alone
        last = None  # the last anchor, if a row of it has been kept
        for batch in batches:
            if held is not None:
                batch, held = pa.concat_batches([held, batch]), None
            if not len(batch):
                continue
            anchor = batch.column("anchor").to_numpy()
            keep = batch.column("again").to_numpy(zero_copy_only=False).copy()
            same = anchor[1:] == anchor[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None:
                keep |= anchor == last
            if keep[-1]:
                last = anchor[-1]
            else:
                last, held = None, batch.slice(len(batch) - 1)
            yield batch.filter(pa.array(keep)).select(names[:-1])

    return rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").select(*names).mapInArrow(run, _SEGMENT)


_UNIT = "edge long, proof long, next long, d long, h long, pos int, size int"


def _windows_of(joined: DataFrame) -> DataFrame:
    """Windows of the listed runs (pos, size) of each text, as edges without successor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds, hs, listed = batch.column("d").to_numpy(), batch.column("h").to_numpy(), batch.column("runs")
            for lo, hi, data, offsets in _texts(batch):
                words = Words(data, offsets, lower=False)
                edge, at, numbers = windows(words.hash, words.counts, WINDOW, salt=20)
                proof, _, _ = windows(words.hash, words.counts, WINDOW, salt=21)
                first = np.cumsum(words.counts) - words.counts
                wanted = np.zeros(int(words.counts.sum()) + 1, np.int64)
                for i in range(lo, hi):
                    runs = listed[i].values
                    begin = first[i - lo] + runs.field("pos").to_numpy()
                    np.add.at(wanted, begin, 1)
                    np.add.at(wanted, begin + runs.field("size").to_numpy(), -1)
                keep = (np.cumsum(wanted) > 0)[at] if len(at) else np.zeros(0, bool)
                text = np.repeat(np.arange(hi - lo), numbers)[keep]
                n = len(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(edge.view(np.int64)[keep]), pa.array(proof.view(np.int64)[keep]), pa.array(np.zeros(n, np.int64)), pa.array(ds[lo + text]), pa.array(hs[lo + text]), pa.array((at[keep] - first[text]).astype(np.int32)), pa.array(np.ones(n, np.int32))],
                    ["edge", "proof", "next", "d", "h", "pos", "size"],
                )

    return joined.select("d", "h", "text", "runs").mapInArrow(run, _UNIT)


def _near(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows joined with what is wanted of them by d and h; a bitmap keeps other texts out of the shuffle."""
    return thinned(rows, wanted.select("h"), "h").join(wanted, ["d", "h"])


def repeated_spans(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """d, h and the word ranges (start, end exclusive) that some earlier place holds too, with that source's place."""
    segments = stored(_repeated_segments(_segment_rows(profile.where("NOT whole AND size(anchors) > 0"))), "substring-segments")
    mixed = segments.groupBy("anchor").agg(F.min("segment").alias("low"), F.max("segment").alias("high")).where("low <> high").select("anchor")
    mixed = bounded(stored(mixed, "substring-mixed"))
    runs = segments.join(mixed, "anchor", "left_semi").groupBy("d", "h").agg(F.collect_list(F.struct("pos", "size")).alias("runs"))
    whole = segments.join(mixed, "anchor", "left_anti").select(F.col("anchor").alias("edge"), F.col("segment").alias("proof"), "next", "d", "h", "pos", "size")
    edges = stored(whole.union(_windows_of(_near(rows, stored(runs, "substring-runs")))), "substring-edges")

    place = F.struct("d", "h", "pos")
    graph = edges.groupBy("edge", "proof").agg(F.count("*").alias("n"), F.min(place).alias("source"), F.min("size").alias("size"), F.min("next").alias("next"), F.max("next").alias("next_high")).where("n > 1")
    graph = stored(graph, "substring-graph")
    # A successor that follows every occurrence and is as frequent as the edge itself continues its path.
    step = graph.where("next = next_high AND next <> 0").select(F.col("next").alias("edge"), F.col("n").alias("before_n"), F.col("source").alias("before"), F.col("size").alias("before_size"))
    follows = (F.col("n") == F.col("before_n")) & (F.col("before.d") == F.col("source.d")) & (F.col("before.h") == F.col("source.h")) & (F.col("before.pos") + F.col("before_size") == F.col("source.pos"))
    linked = graph.join(step, "edge", "left").withColumn("inner", F.coalesce(follows, F.lit(False)))
    linked = linked.groupBy("edge", "proof", "source", "size").agg(F.max("inner").alias("inner"))
    along = Window.partitionBy("source.d", "source.h").orderBy("source.pos", "edge")
    path = linked.withColumn("path", F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(along))
    lengths = path.groupBy("source.d", "source.h", "path").agg(F.sum("size").alias("windows"), F.min_by(F.struct("edge", "proof", "source"), "source.pos").alias("head"))
    heads = lengths.select("head.edge", "head.proof", "head.source", "windows")
    spans = edges.select("edge", "proof", "d", "h", "pos").join(heads, ["edge", "proof"]).where(F.struct("d", "h", "pos") != F.col("source"))
    return spans.select("d", "h", F.col("pos").alias("start"), (F.col("pos") + F.col("windows") + WINDOW - 1).cast("int").alias("end"))


def _cut(joined: DataFrame) -> DataFrame:
    """d, h, n_removed, kept_sha256 and kept (the words left, joined by one space) of rows with spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            removed, texts, size, since = [], [], 0, 0
            for i in range(len(batch)):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                gone = np.zeros(len(words) + 1, np.int64)
                ranges = batch.column("spans")[i].values
                np.add.at(gone, ranges.field("start").to_numpy(), 1)
                np.add.at(gone, ranges.field("end").to_numpy(), -1)
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
                size += len(texts[-1])
                if size > 4_000_000 or i + 1 == len(batch):
                    part = batch.slice(since, i + 1 - since)
                    yield pa.RecordBatch.from_arrays([part.column("d"), part.column("h"), pa.array(removed, pa.int64()), pa.array([sha256(t).hexdigest() for t in texts]), pa.array([t.decode() for t in texts], pa.string())], ["d", "h", "n_removed", "kept_sha256", "kept"])
                    removed, texts, size, since = [], [], 0, i + 1

    return joined.select("d", "h", "text", "spans").mapInArrow(run, "d long, h long, n_removed long, kept_sha256 string, kept string")


def _shortened(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' profile, and the rows that lose some of their words (not all)."""
    rows = _keyed(docs)
    profile = stored(_profile(rows), "substring-profile")
    # Of documents with the same words only the first goes on; thousands of copies cost one small sum each.
    first = profile.where(f"n_words >= {WINDOW}").groupBy("all_sha256").agg(F.min(F.struct("d", "h")).alias("first"), F.count("*").alias("n")).where("n > 1").select("all_sha256", "first")
    copies = profile.select("d", "h", "all_sha256").join(first, "all_sha256").where(F.struct("d", "h") != F.col("first")).select("d", "h", F.lit(True).alias("whole")).distinct()
    profile = profile.join(stored(copies, "substring-copies"), ["d", "h"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    by_row = repeated_spans(rows, profile).groupBy("d", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return profile, _cut(_near(rows, stored(by_row, "substring-spans")))


def substring_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    profile, cut = _shortened(docs)
    cut = cut.select("d", "h", "n_removed", "kept_sha256").distinct()
    out = profile.select("doc_id", "d", "h", "n_words", "all_sha256", "whole").join(cut, ["d", "h"], "left")
    removed = F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("whole"), F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "all_sha256"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated spans cut out of `text`; a text that loses words has the others joined by one space.

    Other columns pass unchanged, whatever their names. A null text stays null; rows without an id come before all others.
    """
    profile, cut = _shortened(docs)
    gone = profile.where("whole").select("d", "h", F.lit("").alias("kept"))
    cut = cut.where("n_removed > 0").select("d", "h", "kept").union(gone).distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    d, h = F.coalesce(F.col("whole.doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64(F.coalesce(F.col("whole.text").cast("string"), F.lit("")))
    joined = whole.withColumns({"d": d, "h": h}).join(cut, ["d", "h"], "left")
    return joined.select(*(F.coalesce("kept", "whole.text").alias(c) if c == "text" else F.col(f"whole.`{c}`") for c in docs.columns))

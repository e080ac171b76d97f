"""Sharding by sampled splitters (operator 4), DataFrame operations only.

Records are ordered by a key, then by id, then by their number in a written table, so what a third of all rows share is still divisible. A
sample drawn in proportion to size gives quantile boundaries; rows are put into these ranges by binary search
over the boundaries, the ranges are measured exactly, and ranges over twice the target are subdivided by
boundaries from a finer sample of their own rows and measured again. Running sums inside ranges plus the exact offsets of ranges
give every record its byte position in the whole order, from which its shard follows: shard sizes differ by less
than one record. Texts are never shuffled, only key, id and size.

Law `bytes`: sizes near equal. Defined results: a null text has size 16 and the key of the empty text; an empty
table gives no rows; rows alike in key and id are told apart by position, in any order, which changes no size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.shared import stored

#: Sampled keys for each range: a range then holds its target within about 1/sqrt of this.
SAMPLES_PER_RANGE = 64
OVERFULL = 2.0
#: Times that overfull ranges are subdivided and measured again.
SUBDIVISIONS = 4


#: What orders records: rows alike in key and tie are told apart by their number in the written table.
ORDER = ("key", "tie", "row")


def _find(boundaries: list[tuple[int, int, int]]):
    """Number of boundaries at or below a record's (key, tie, row), by binary search within one expression."""
    if not boundaries:
        return F.lit(0)
    table = F.array(*(F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(ORDER, b, strict=True))) for b in boundaries))
    steps = F.array(*(F.lit(0) for _ in range(len(boundaries).bit_length())))
    here = F.struct(*ORDER)

    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        low = F.element_at(table, F.least(middle + 1, F.lit(len(boundaries)))) <= here
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & low, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~low, middle).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(boundaries)).alias("hi"))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def _quantiles(sample: list, count: int) -> list[tuple[int, int, int]]:
    """Boundaries that cut a sorted sample into `count` equal parts."""
    cuts = {sample[len(sample) * i // count] for i in range(1, count)} if len(sample) >= count else set(sample)
    return sorted(cuts)


def assign(records: DataFrame, shards: int, ranges: int | None = None) -> DataFrame:
    """records (key long, tie long, row long, size long, any others) plus shard and slot; row differs between records.

    ranges: how many ranges to sort in; by default ten for each shard. The boundaries (24 bytes each) are
    literals of the plan, so their number is bounded by `ranges` plus the subdivisions of overfull ranges.
    """
    ranges = ranges or 10 * shards
    total = records.agg(F.sum("size").alias("s")).first()["s"] or 0
    if not total:
        return records.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    target = total / ranges

    def drawn(df: DataFrame, parts: float, salt: int) -> list[tuple[int, int, int]]:
        # A row is drawn with a probability in proportion to its size; one row stands for at most one sample.
        u = (F.xxhash64(*ORDER, F.lit(salt)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)).cast("double")
        return sorted(tuple(r[c] for c in ORDER) for r in df.where(u < F.col("size") * (parts * SAMPLES_PER_RANGE / total)).select(*ORDER).collect())

    boundaries = _quantiles(drawn(records, ranges, 1), ranges)
    for turn in range(2, 2 + SUBDIVISIONS):
        placed = records.withColumn("_range", _find(boundaries))
        measured = {r["_range"]: r["s"] for r in placed.groupBy("_range").agg(F.sum("size").alias("s")).collect()}
        overfull = {k: s for k, s in measured.items() if s > OVERFULL * target}
        if not overfull:
            break
        sample = drawn(placed.where(F.col("_range").isin(sorted(overfull))), 4.0 * ranges, turn)
        edges, more = [None, *boundaries, None], set(boundaries)
        for k, s in overfull.items():
            low, high = edges[k], edges[k + 1]
            more.update(_quantiles([x for x in sample if (low is None or x >= low) and (high is None or x < high)], int(s / target) + 1))
        if len(more) == len(boundaries):  # single records larger than a range
            break
        boundaries = sorted(more)
    placed = records.withColumn("_range", _find(boundaries))
    sums = {r["_range"]: r["s"] for r in placed.groupBy("_range").agg(F.sum("size").alias("s")).collect()}
    before, running = {}, 0
    for k in sorted(sums):
        before[k] = running
        running += sums[k]
    base = F.array(*(F.lit(before.get(k, 0)).cast("long") for k in range(len(boundaries) + 1)))
    order = Window.partitionBy("_range").orderBy(*ORDER)
    position = F.element_at(base, F.col("_range") + 1) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    numbered = placed.withColumn("_position", position).withColumn("_row", F.row_number().over(order))
    # The middle of a record decides, so that neither end of a shard is always rounded the same way.
    middle = (F.col("_position") * 2 + F.col("size")).cast("decimal(38,0)") * shards
    numbered = numbered.withColumn("shard", F.least(F.floor(middle / F.lit(2 * total).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int"))
    pieces = numbered.groupBy("shard", "_range").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    # At most shards + ranges rows: each range meets few shards, and each shard a run of ranges.
    offset = F.sum("n").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = {(r["_range"], r["shard"]): r["o"] for r in pieces.select("shard", "_range", (offset - F.col("first")).alias("o")).collect()}
    listed = F.create_map(*(F.lit(x) for (a, b), o in starts.items() for x in (a * shards + b, o)))
    slot = (F.element_at(listed, F.col("_range") * shards + F.col("shard")) + F.col("_row")).cast("long")
    return numbered.withColumn("slot", slot).drop("_range", "_position", "_row")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document; equal texts are neighbours."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    records = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("tie"),
        F.monotonically_increasing_id().alias("row"),  # fixed once the records are written
    )
    out = assign(stored(records, "shard-records"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

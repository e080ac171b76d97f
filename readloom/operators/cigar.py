"""CIGAR arrays to covered blocks, depth events and bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import sam

#: CIGARs with more operations are walked by rows and a window instead of inside one array.
LONG_CIGAR = 1000
_COVERS, _CONSUMES_REF, _CONSUMES_QUERY = (0, 7, 8), (0, 2, 3, 7, 8), (0, 1, 4, 7, 8)


def _walk(cigar: Column, pos: Column) -> Column:
    """Covered half-open blocks of one alignment."""
    start = F.struct(pos.cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("blocks"))

    def step(s, o):
        block = F.struct(s["at"].alias("start"), (s["at"] + o["len"]).alias("stop"))
        covers = o["op"].isin(*_COVERS) & (o["len"] > 0)
        return F.struct(F.when(o["op"].isin(*_CONSUMES_REF), s["at"] + o["len"]).otherwise(s["at"]).alias("at"), F.when(covers, F.array_append(s["blocks"], block)).otherwise(s["blocks"]).alias("blocks"))

    return F.aggregate(cigar, start, step, lambda s: s["blocks"])


def _walk_ops(cigar: Column, pos: Column) -> Column:
    """at, query_at and len of the operations of one alignment that cover bases."""
    start = F.struct(pos.cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("query_at"), F.array().cast("array<struct<at: bigint, query_at: bigint, len: int>>").alias("ops"))

    def step(s, o):
        moved = lambda c, ops: F.when(o["op"].isin(*ops), s[c] + o["len"]).otherwise(s[c]).alias(c)
        covers = o["op"].isin(*_COVERS) & (o["len"] > 0)
        here = F.struct(s["at"].alias("at"), s["query_at"].alias("query_at"), o["len"].alias("len"))
        return F.struct(moved("at", _CONSUMES_REF), moved("query_at", _CONSUMES_QUERY), F.when(covers, F.array_append(s["ops"], here)).otherwise(s["ops"]).alias("ops"))

    return F.aggregate(cigar, start, step, lambda s: s["ops"])


def _rows(reads: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each operation with its reference and query offsets (at, query_at); rows of a read share `_id`."""
    numbered = reads.withColumn("_id", F.monotonically_increasing_id()).select("_id", "pos", *keep, F.posexplode("cigar").alias("_k", "_o"))
    before = Window.partitionBy("_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    used = lambda ops: F.coalesce(F.sum(F.when(F.col("_o.op").isin(*ops), F.col("_o.len")).otherwise(0)).over(before), F.lit(0))
    return numbered.select("_id", *keep, F.col("_o.len").alias("len"), F.col("_o.op").alias("op"), (F.col("pos") + used(_CONSUMES_REF)).cast("bigint").alias("at"), used(_CONSUMES_QUERY).cast("bigint").alias("query_at"))


def covering(reads: DataFrame) -> DataFrame:
    return reads.where(~sam.has(sam.NOT_COVERING) & (F.col("ref_id") >= 0))


def read_blocks(reads: DataFrame, long_cigars: bool = True) -> DataFrame:
    """ref_id, start, stop of the covered blocks of all the reads given.

    long_cigars: whether CIGARs of over LONG_CIGAR operations may occur; without them the second branch is left out.
    """
    kept = reads.select("ref_id", "pos", "cigar")
    short = (kept.where(F.size("cigar") <= LONG_CIGAR) if long_cigars else kept).select("ref_id", F.inline(_walk(F.col("cigar"), F.col("pos"))))
    if not long_cigars:
        return short
    far = _rows(kept.where(F.size("cigar") > LONG_CIGAR), ["ref_id"]).where(F.col("op").isin(*_COVERS) & (F.col("len") > 0))
    return short.union(far.select("ref_id", F.col("at").alias("start"), (F.col("at") + F.col("len")).alias("stop")))


def blocks(reads: DataFrame, long_cigars: bool = True) -> DataFrame:
    """ref_id, start, stop of the covered blocks of reads that cover."""
    return read_blocks(covering(reads), long_cigars)


def events(blocks: DataFrame, chunk: int) -> DataFrame:
    """ref_id, chunk, pos, delta: +1 where a block begins and -1 where it ends.

    A block that crosses bounds of chunks begins anew in each of them, so that each chunk's depth follows from its own events.
    """
    size = F.lit(chunk).cast("bigint")
    number = lambda c: F.floor(c / size).cast("bigint")
    cut = blocks.select("ref_id", "start", "stop", F.explode(F.sequence(number(F.col("start")), number(F.col("stop") - 1))).alias("chunk"))
    end = lambda pos, delta: F.struct(pos.alias("pos"), F.lit(delta).cast("bigint").alias("delta"))
    both = F.array(end(F.greatest("start", F.col("chunk") * size), 1), end(F.col("stop"), -1))
    return cut.select("ref_id", "chunk", F.inline(both)).where(F.col("pos") < (F.col("chunk") + 1) * size)


def bases(reads: DataFrame, keep: list[str], long_cigars: bool = True) -> DataFrame:
    """One row for each aligned base: keep, at (reference position), query_at (offset in the read). long_cigars: as in events()."""
    short = reads.where(F.size("cigar") <= LONG_CIGAR) if long_cigars else reads
    ops = short.select(*keep, F.inline(_walk_ops(F.col("cigar"), F.col("pos"))))
    if long_cigars:
        far = _rows(reads.where(F.size("cigar") > LONG_CIGAR), keep).where(F.col("op").isin(*_COVERS) & (F.col("len") > 0))
        ops = ops.union(far.select(*keep, "at", "query_at", "len"))
    each = ops.select(*keep, "at", "query_at", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("_i"))
    return each.select(*keep, (F.col("at") + F.col("_i")).alias("at"), (F.col("query_at") + F.col("_i")).alias("query_at"))


def spans(reads: DataFrame) -> DataFrame:
    """Sums of query, reference, aligned and accepted bases over all reads, and of CIGAR operations; seq_length stands for bases that are not there."""
    accepted = F.when(~sam.has(sam.NOT_COVERING) & (F.col("ref_id") >= 0), sam.span("M=X")).otherwise(0)
    bases = F.col("seq_length") if "seq_length" in reads.columns else sam.seq_length()
    sums = {"query_bases": sam.query_span(), "reference_bases": sam.reference_span(), "aligned_bases": sam.aligned_bases(), "unclipped_bases": bases + sam.span("H"), "accepted_bases": accepted, "operations": F.size("cigar").cast("bigint")}
    return reads.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in sums.items()))

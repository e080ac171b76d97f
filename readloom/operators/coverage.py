"""Exact depth: runs, histograms, coverage by contig, thresholds and their invariants.

Depth is a running sum of signed events. To keep one large contig from being one task, contigs are cut into chunks, and
blocks at the bounds of chunks: the running sum starts at 0 in each chunk and needs nothing from others. Runs are longest
stretches of equal depth within a chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.numbers import fixed
from readloom.operators.cigar import blocks, events

CHUNK = 1 << 20


def running_depth(made: DataFrame) -> DataFrame:
    """ref_id, chunk, pos, depth from each place with events (ref_id, chunk, pos, delta) on."""
    summed = made.groupBy("ref_id", "chunk", "pos").agg(F.sum("delta").alias("delta"))
    along = Window.partitionBy("ref_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return summed.select("ref_id", "chunk", "pos", F.sum("delta").over(along).alias("depth"))


def run_events(runs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """ref_id, chunk, pos, delta of runs of equal depth, as events() makes them of blocks."""
    size = F.lit(chunk).cast("bigint")
    number = lambda c: F.floor(c / size).cast("bigint")
    cut = runs.where("depth <> 0 AND stop > start").select("ref_id", "start", "stop", "depth", F.explode(F.sequence(number(F.col("start")), number(F.col("stop") - 1))).alias("chunk"))
    end = lambda pos, delta: F.struct(pos.alias("pos"), delta.alias("delta"))
    both = F.array(end(F.greatest("start", F.col("chunk") * size), F.col("depth")), end(F.col("stop"), -F.col("depth")))
    return cut.select("ref_id", "chunk", F.inline(both)).where(F.col("pos") < (F.col("chunk") + 1) * size)


def spine(refs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """ref_id, chunk, pos, delta: an event of 0 where each chunk of each contig begins; an empty contig has none."""
    size = F.lit(chunk).cast("bigint")
    chunks = refs.where("length > 0").select("ref_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / size).cast("bigint"))).alias("chunk"))
    return chunks.select("ref_id", "chunk", (F.col("chunk") * size).alias("pos"), F.lit(0).cast("bigint").alias("delta"))


def depth_runs(reads: DataFrame, refs: DataFrame, chunk: int = CHUNK, long_cigars: bool = True) -> DataFrame:
    """ref_id, start, stop, depth over all of every contig, including depth 0; an empty contig has no run."""
    size = F.lit(chunk).cast("bigint")
    contigs = refs.select("ref_id", "length").where("length > 0")
    deep = running_depth(events(blocks(reads, long_cigars), chunk).union(spine(refs, chunk)))
    along = Window.partitionBy("ref_id", "chunk").orderBy("pos")
    first = deep.withColumn("same", F.lag("depth").over(along).eqNullSafe(F.col("depth"))).where("NOT same")
    ended = first.withColumn("after", F.lead("pos").over(along)).join(contigs, "ref_id").where("pos < length")
    stop = F.least(F.col("length"), F.coalesce("after", (F.col("chunk") + 1) * size))
    return ended.select("ref_id", F.col("pos").alias("start"), stop.alias("stop"), "depth")


def depth_histogram(runs: DataFrame) -> DataFrame:
    """depth, bases; depth 0 is always there."""
    zero = runs.sparkSession.createDataFrame([(0, 0)], "depth bigint, bases bigint")
    sized = runs.select("depth", (F.col("stop") - F.col("start")).alias("bases"))
    return sized.union(zero).groupBy("depth").agg(F.sum("bases").alias("bases"))


def coverage_by_contig(runs: DataFrame, refs: DataFrame) -> DataFrame:
    """ref_id, name, length, accepted_bases, covered, uncovered, mean_depth (six decimals) of every contig."""
    bases = F.col("stop") - F.col("start")
    sums = runs.groupBy("ref_id").agg(F.sum(F.col("depth") * bases).alias("accepted_bases"), F.sum(F.when(F.col("depth") > 0, bases).otherwise(0)).alias("covered"), F.sum(F.when(F.col("depth") == 0, bases).otherwise(0)).alias("uncovered"))
    every = refs.select("ref_id", "name", "length").join(sums, "ref_id", "left").na.fill(0)
    return every.withColumn("mean_depth", fixed(F.col("accepted_bases"), F.col("length")))


def thresholds(histogram: DataFrame, depths: list[int]) -> DataFrame:
    """threshold, bases, percent of territory with at least that depth; depths are sorted, each once."""
    levels = F.array(*(F.lit(d).cast("bigint") for d in sorted(set(depths))))
    # The histogram has a row for each depth, so its product with a handful of thresholds stays small.
    each = histogram.select("*", F.explode(levels).alias("threshold"))
    sums = each.groupBy("threshold").agg(F.sum(F.when(F.col("depth") >= F.col("threshold"), F.col("bases")).otherwise(0)).alias("bases"), F.sum("bases").alias("territory"))
    return sums.select("threshold", "bases", fixed(F.col("bases"), F.col("territory"), 100).alias("percent"))


def invariants(runs: DataFrame, refs: DataFrame, accepted_bases: DataFrame) -> DataFrame:
    """One row: territory, run bases, depth sum, accepted bases, and whether they agree. accepted_bases: one row, one column."""
    bases = F.col("stop") - F.col("start")
    a = runs.agg(F.coalesce(F.sum(bases), F.lit(0)).alias("run_bases"), F.coalesce(F.sum(F.col("depth") * bases), F.lit(0)).alias("depth_sum"), F.coalesce(F.min("depth"), F.lit(0)).alias("least_depth"))
    b = refs.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("territory"))
    c = accepted_bases.select(F.col(accepted_bases.columns[0]).alias("accepted_bases"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    row = one(a).join(one(b), "_one").join(one(c), "_one").drop("_one")
    return row.withColumn("holds", (F.col("run_bases") == F.col("territory")) & (F.col("depth_sum") == F.col("accepted_bases")) & (F.col("least_depth") >= 0))

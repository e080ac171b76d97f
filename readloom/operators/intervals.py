"""Interval normalisation and overlap joins.

Overlap joins cut long intervals into bins, so that both sides meet by equality of contig and bin; a pair is kept in
the bin where its overlap begins, hence once. Nothing is broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN, CHUNK = 1 << 14, 1 << 20


def expand(intervals: DataFrame, refs: DataFrame, flank: int) -> DataFrame:
    """Non-empty intervals widened by flank within their contig, with flags of clipped ends."""
    lengths = refs.select("ref_id", F.col("length").alias("_length"))
    wide = intervals.where("stop > start").join(lengths, "ref_id")
    out = wide.withColumns({"_start": F.col("start") - flank, "_stop": F.col("stop") + flank})
    return out.select("source_index", "ref_id", F.greatest("_start", F.lit(0)).cast("bigint").alias("start"), F.least("_stop", "_length").alias("stop"), (F.col("_start") < 0).alias("clipped_left"), (F.col("_stop") > F.col("_length")).alias("clipped_right"))


def _prefix(marked: DataFrame, column: str, name: str) -> DataFrame:
    """marked with the maximum of `column` over all earlier chunks of the contig; a window runs over one row for each chunk."""
    earlier = Window.partitionBy("ref_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    by_chunk = marked.groupBy("ref_id", "_chunk").agg(F.max(column).alias("_most"))
    return marked.join(by_chunk.select("ref_id", "_chunk", F.max("_most").over(earlier).alias(name)), ["ref_id", "_chunk"])


def islands(intervals: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """intervals with _reach, the farthest stop of those before it in its contig, and _island, where its merged interval begins.

    Intervals are dealt by the chunk in which they start, so that a contig with all intervals is many tasks; what earlier chunks reach
    and the last beginning there are carried over from one row for each chunk.
    """
    order = Window.partitionBy("ref_id", "_chunk").orderBy("start", "stop", "source_index")
    placed = _prefix(intervals.withColumn("_chunk", F.floor(F.col("start") / F.lit(chunk)).cast("bigint")), "stop", "_before")
    # greatest() passes over nulls.
    reached = placed.withColumn("_reach", F.greatest("_before", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))).drop("_before")
    begun = reached.withColumn("_begins", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.col("start")))
    begun = _prefix(begun, "_begins", "_last")
    here = F.max("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("_island", F.coalesce(here, "_last")).drop("_last", "_begins", "_chunk")


def merge(intervals: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """ref_id, start, stop, sources of the union; touching intervals merge.

    `sources` is an array of a merged interval's source indices, made only if it is asked for; sources() has them as rows.
    """
    merged = islands(intervals, chunk).groupBy("ref_id", F.col("_island").alias("start")).agg(F.max("stop").alias("stop"), F.sort_array(F.collect_list("source_index")).alias("sources"))
    return merged.select("ref_id", "start", "stop", "sources")


def sources(intervals: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """source_index, ref_id, start: the merged interval of each interval, as rows; an interval of many sources is no single value."""
    return islands(intervals, chunk).select("source_index", "ref_id", F.col("_island").alias("start"))


def merge_report(intervals: DataFrame, refs: DataFrame, flank: int) -> DataFrame:
    """One row: inputs, empty inputs, clips, overlapping and adjacent merges, reordered inputs, merged intervals, territory."""
    wide = expand(intervals, refs, flank)
    steps = islands(wide)
    counted = steps.agg(
        F.count_if("clipped_left").alias("left_clips"),
        F.count_if("clipped_right").alias("right_clips"),
        F.count_if(F.col("start") < F.col("_reach")).alias("overlap_merges"),
        F.count_if(F.col("start") == F.col("_reach")).alias("adjacent_merges"),
    )
    merged = merge(wide).agg(F.count("*").alias("merged"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("territory"))
    inputs = intervals.agg(F.count("*").alias("inputs"), F.count_if(F.col("stop") == F.col("start")).alias("empty_inputs"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(inputs).join(one(counted), "_one").join(one(merged), "_one").drop("_one")


def reordered(intervals: DataFrame) -> DataFrame:
    """One row: how many intervals stand elsewhere after sorting by contig and place.

    An interval keeps its place if as many come before it in one order as in the other. Rows before are counted by contig
    first, so that windows run along one contig and over one row for each contig.
    """
    given = intervals.select("source_index", "ref_id", "start", "stop")
    before = Window.orderBy("ref_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = given.groupBy("ref_id").agg(F.count("*").alias("n")).select("ref_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("ref_id").orderBy("start", "stop", "source_index")
    ranked = given.withColumn("rank", F.row_number().over(order)).join(sizes, "ref_id")
    # Source indices are 0, 1, ... in the file, so an interval's own index is its place there.
    return ranked.agg(F.count_if(F.col("base") + F.col("rank") - 1 != F.col("source_index")).alias("moved"))


def overlaps(runs: DataFrame, intervals: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Pairs of runs and intervals that share bases: the runs' depth, the intervals' columns, low and high of the overlap."""
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("stop") - 1) / bin_size)))
    left = runs.where("stop > start").select("ref_id", F.col("start").alias("_rs"), F.col("stop").alias("_re"), "depth", bins().alias("_bin"))
    right = intervals.where("stop > start").withColumn("_bin", bins())
    met = left.join(right, ["ref_id", "_bin"]).where("_rs < stop AND _re > start")
    met = met.withColumns({"low": F.greatest("_rs", "start"), "high": F.least("_re", "stop")})
    return met.where(F.floor(F.col("low") / bin_size) == F.col("_bin")).drop("_bin", "_rs", "_re")


def uncontained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Intervals of inner that no interval of outer contains. Both meet by contig and the bin in which an inner one starts."""
    o = outer.select(F.col("ref_id").alias("_ref"), F.col("start").alias("_s"), F.col("stop").alias("_e"), F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("stop") / BIN))).alias("_bin"))
    met = (F.col("ref_id") == F.col("_ref")) & (F.floor(F.col("start") / BIN) == F.col("_bin")) & (F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("stop"))
    return inner.join(o, met, "left_anti")

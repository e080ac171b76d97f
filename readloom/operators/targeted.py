"""Coverage of targets: union histogram, on/near/off partition, each target, dropout, enrichment, D20, uniformity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.numbers import fixed
from readloom.operators.cigar import events
from readloom.operators.coverage import CHUNK, run_events, spine
from readloom.operators.intervals import expand, merge, overlaps

NEAR = 250


def available(value: Column, reasons: list[tuple[Column, str]]) -> Column:
    """struct(status, value, reason): the first reason that holds makes the value unavailable; never a bare null or 0."""
    reason = F.coalesce(*(F.when(c, F.lit(r)) for c, r in reasons))
    return F.struct(F.when(reason.isNull(), "available").otherwise("unavailable").alias("status"), F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def union_of(targets: DataFrame, refs: DataFrame, flank: int = 0) -> DataFrame:
    return merge(expand(targets, refs, flank))


def target_histogram(runs: DataFrame, merged: DataFrame) -> DataFrame:
    """depth, bases over the union of targets; depth 0 is always there."""
    zero = runs.sparkSession.createDataFrame([(0, 0)], "depth bigint, bases bigint")
    met = overlaps(runs, merged.select("ref_id", "start", "stop")).select("depth", (F.col("high") - F.col("low")).alias("bases"))
    return met.union(zero).groupBy("depth").agg(F.sum("bases").alias("bases"))


def territory(made: DataFrame, refs: DataFrame, targets: DataFrame, near: int = NEAR, chunk: int = CHUNK) -> DataFrame:
    """label (on, near, off), depth, bases over all contigs, by one sweep. made: the depth's events, of reads or of runs, cut at `chunk`.

    The ends of targets, plain and widened by `near`, are events like the ends of blocks. All are summed by place, and one running sum in
    each chunk gives the depth and how many targets cover a stretch, so that no targets are merged and nothing is joined. What leaves the
    sweep is a row for each label and depth.
    """
    # Stretches are clipped at the contig's end below, so widened targets need no lengths here.
    around = lambda flank: targets.where("stop > start").select("ref_id", F.greatest(F.col("start") - flank, F.lit(0)).cast("bigint").alias("start"), (F.col("stop") + flank).cast("bigint").alias("stop"))
    plain, wide = events(around(0), chunk), events(around(near), chunk)
    zero = F.lit(0).cast("bigint")
    kinds = ("depth", "inner", "outer")
    marked = [df.select("ref_id", "chunk", "pos", *((F.col("delta") if kind == k else zero).alias(k) for k in kinds)) for kind, df in zip(kinds, (made.union(spine(refs, chunk)), plain, wide), strict=True)]
    places = marked[0].union(marked[1]).union(marked[2]).groupBy("ref_id", "chunk", "pos").agg(*(F.sum(k).alias(k) for k in kinds))
    along = Window.partitionBy("ref_id", "chunk").orderBy("pos")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    swept = places.select("ref_id", "chunk", "pos", F.lead("pos").over(along).alias("after"), *(F.sum(k).over(so_far).alias(k) for k in kinds))
    lengths = refs.select("ref_id", "length")
    # A stretch ends at the next event, its chunk's end or its contig's end; events beyond a contig have no stretch.
    sized = swept.join(lengths, "ref_id").select(*kinds, (F.least("length", F.coalesce("after", (F.col("chunk") + 1) * F.lit(chunk).cast("bigint"))) - F.col("pos")).alias("bases")).where("bases > 0")
    label = F.when(F.col("inner") > 0, "on").when(F.col("outer") > 0, "near").otherwise("off")
    return sized.groupBy(label.alias("label"), "depth").agg(F.sum("bases").alias("bases"))


def territory_of_runs(runs: DataFrame, refs: DataFrame, targets: DataFrame, near: int = NEAR) -> DataFrame:
    """territory() of depth that is there as runs."""
    return territory(run_events(runs), refs, targets, near)


def sums(swept: DataFrame) -> DataFrame:
    """One row of a territory() table: on, near and off bases, all accepted ones, the three territories, and d20 of the targets.

    The window for d20 runs over a row for each label and depth; where d20 isn't asked for, it is not computed.
    """
    on = F.when(F.col("label") == "on", F.col("bases")).otherwise(0)
    # Rows of equal depth count together, so the least depth that reaches a fifth is one that targets have.
    ranked = swept.select("*", F.sum(on).over(Window.orderBy("depth")).alias("up_to"), F.sum(on).over(Window.partitionBy()).alias("all"))
    total = lambda value, *labels: F.coalesce(F.sum(F.when(F.col("label").isin(*labels), value)), F.lit(0))
    deep, wide = F.col("depth") * F.col("bases"), F.col("bases")
    return ranked.agg(
        total(deep, "on").alias("on_bases"), total(deep, "near").alias("near_bases"), total(deep, "off").alias("off_bases"), total(deep, "on", "near", "off").alias("accepted_bases"),
        total(wide, "on").alias("target_territory"), total(wide, "near").alias("near_territory"), total(wide, "on", "near", "off").alias("genome_territory"),
        F.min(F.when((F.col("all") > 0) & (F.col("up_to") * 5 >= F.col("all")), F.col("depth"))).alias("d20"),
    )


def swept_histogram(swept: DataFrame) -> DataFrame:
    """depth, bases over the union of targets, of a territory() table; depth 0 is always there."""
    zero = swept.sparkSession.createDataFrame([(0, 0)], "depth bigint, bases bigint")
    return swept.where("label = 'on'").select("depth", "bases").union(zero).groupBy("depth").agg(F.sum("bases").alias("bases"))


def partition(runs: DataFrame, refs: DataFrame, targets: DataFrame, near: int = NEAR) -> DataFrame:
    """One row: on, near and off bases, and the territories of targets, their surroundings and all contigs."""
    return sums(territory_of_runs(runs, refs, targets, near)).drop("d20")


def each_target(runs: DataFrame, targets: DataFrame, depths: list[int]) -> DataFrame:
    """Depth sum, covered and uncovered bases, mean depth and bases at each threshold, of every target by itself."""
    met = overlaps(runs, targets.select("source_index", "ref_id", "start", "stop"))
    bases = F.col("high") - F.col("low")
    sums = met.groupBy("source_index").agg(
        F.sum(F.col("depth") * bases).alias("depth_sum"),
        F.sum(F.when(F.col("depth") > 0, bases).otherwise(0)).alias("covered"),
        *(F.sum(F.when(F.col("depth") >= d, bases).otherwise(0)).alias(f"at_least_{d}") for d in sorted(set(depths))),
    )
    every = targets.select("source_index", "ref_id", "start", "stop").join(sums, "source_index", "left").na.fill(0)
    length = F.col("stop") - F.col("start")
    return every.withColumns({"length": length, "uncovered": length - F.col("covered"), "mean_depth": available(fixed(F.col("depth_sum"), length), [(length == 0, "zero_length_target")]), "covered_percent": available(fixed(F.col("covered"), length, 100), [(length == 0, "zero_length_target")])})


def zero_runs(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """source_index, start, stop of the longest stretches without coverage inside each target."""
    met = overlaps(runs.where("depth = 0"), targets.select("source_index", "ref_id", "start", "stop")).select("source_index", "low", "high")
    order = Window.partitionBy("source_index").orderBy("low")
    marked = met.withColumn("_new", F.when(F.lag("high").over(order) == F.col("low"), 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("source_index", "_run").agg(F.min("low").alias("start"), F.max("high").alias("stop")).drop("_run")


def dropout(each: DataFrame) -> DataFrame:
    """One row: how many non-empty targets have uncovered bases."""
    return each.agg(F.count_if((F.col("length") > 0) & (F.col("uncovered") > 0)).alias("dropout_targets"))


def d20(histogram: DataFrame) -> DataFrame:
    """One row: the least depth whose cumulative bases reach ceil(N / 5); null without territory.

    The window runs over one row for each depth, not over bases.
    """
    along = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.select("depth", F.sum("bases").over(along).alias("up_to"), F.sum("bases").over(Window.partitionBy()).alias("all"))
    return ranked.agg(F.min(F.when((F.col("all") > 0) & (F.col("up_to") * 5 >= F.col("all")), F.col("depth"))).alias("d20"))


def enrichment(row: DataFrame) -> DataFrame:
    """Target enrichment of a partition() row: (on / accepted) / (target / genome)."""
    wide = "decimal(38,0)"
    value = fixed(F.col("on_bases").cast("decimal(18,0)") * F.col("genome_territory").cast("decimal(18,0)"), F.col("accepted_bases").cast("decimal(18,0)") * F.col("target_territory").cast("decimal(18,0)").cast(wide))
    reasons = [(F.col("target_territory") == 0, "target_territory_is_zero"), (F.col("accepted_bases") == 0, "no_accepted_aligned_bases"), (F.col("genome_territory") == 0, "genome_territory_is_zero")]
    return row.select(available(value, reasons).alias("enrichment")).select("enrichment.*")


def uniformity(row: DataFrame, d20_row: DataFrame) -> DataFrame:
    """Fold-80 penalty: mean target depth over D20."""
    both = row.drop("d20").withColumn("_one", F.lit(1)).join(d20_row.withColumn("_one", F.lit(1)), "_one")
    return uniformity_of(both)


def uniformity_of(row: DataFrame) -> DataFrame:
    """Fold-80 penalty of a sums() row."""
    value = fixed(F.col("on_bases"), F.col("target_territory") * F.col("d20"))
    reasons = [(F.col("target_territory") == 0, "target_territory_is_zero"), (F.coalesce(F.col("d20"), F.lit(0)) == 0, "target_depth_20th_percentile_is_zero")]
    return row.select(available(value, reasons).alias("penalty")).select("penalty.*")

"""The alignment queries over the view of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import sam
from readloom.functions.numbers import fixed
from readloom.operators import alignment_metrics as am
from readloom.operators import cigar, counters, coverage, intervals, overlap, targeted, validation
from readloom.operators import summary_stats as ss
from readloom.sources import view

DEPTHS = [1, 5, 10, 20, 30]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The view's CIGARs have five operations, so the branch for long ones is left out.
    return coverage.depth_runs(view.reads(spark, sf_dir), view.refs(spark, sf_dir), long_cigars=False)


def _territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = view.refs(spark, sf_dir)
    made = cigar.events(cigar.blocks(view.reads(spark, sf_dir), long_cigars=False), coverage.CHUNK)
    return targeted.territory(made, refs, view.targets(spark, sf_dir))


def _longs(df: DataFrame) -> DataFrame:
    """Counts as bigint and text as it is, so that types equal the SQL's."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


def flagstat(spark, sf_dir):
    return counters.flag_counters(view.reads(spark, sf_dir))


def idxstats(spark, sf_dir):
    return counters.contig_counts(view.reads(spark, sf_dir), view.refs(spark, sf_dir))


def record_classes(spark, sf_dir):
    return counters.record_classes(view.reads(spark, sf_dir))


def read_group_state(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    # rg0 and rg1 are declared once, rg2 more than once, the others never.
    groups = nation.where("n_nationkey % 3 < 2 OR n_nationkey > 0").select(F.when(F.col("n_nationkey") < 2, F.concat(F.lit("rg"), F.col("n_nationkey"))).otherwise("rg2").alias("id"))
    return counters.read_group_states(view.reads(spark, sf_dir), groups)


def depth_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


def depth_histogram(spark, sf_dir):
    return coverage.depth_histogram(_runs(spark, sf_dir))


def per_reference_coverage(spark, sf_dir):
    return coverage.coverage_by_contig(_runs(spark, sf_dir), view.refs(spark, sf_dir))


def coverage_thresholds(spark, sf_dir):
    return coverage.thresholds(depth_histogram(spark, sf_dir), DEPTHS)


def coverage_invariants(spark, sf_dir):
    accepted = cigar.spans(view.reads(spark, sf_dir)).select("accepted_bases")
    return coverage.invariants(_runs(spark, sf_dir), view.refs(spark, sf_dir), accepted)


def target_merge(spark, sf_dir):
    return targeted.union_of(view.targets(spark, sf_dir), view.refs(spark, sf_dir)).select("ref_id", "start", "stop")


def selected_merge(spark, sf_dir):
    return targeted.union_of(view.targets(spark, sf_dir), view.refs(spark, sf_dir), targeted.NEAR).select("ref_id", "start", "stop")


def merge_provenance(spark, sf_dir):
    merged = targeted.union_of(view.targets(spark, sf_dir), view.refs(spark, sf_dir), targeted.NEAR)
    return merged.select("ref_id", "start", F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"))


def merge_report(spark, sf_dir):
    return intervals.merge_report(view.targets(spark, sf_dir), view.refs(spark, sf_dir), targeted.NEAR)


def target_depth_histogram(spark, sf_dir):
    return targeted.swept_histogram(_territory(spark, sf_dir))


def target_partition(spark, sf_dir):
    return targeted.sums(_territory(spark, sf_dir)).drop("d20")


def per_target_coverage(spark, sf_dir):
    each = targeted.each_target(_runs(spark, sf_dir), view.targets(spark, sf_dir), [1, 10])
    return each.select("source_index", "length", "depth_sum", "covered", "uncovered", "at_least_1", "at_least_10", F.col("mean_depth.value").alias("mean_depth"), F.col("mean_depth.reason").alias("mean_reason"), F.col("covered_percent.value").alias("covered_percent"))


def zero_runs(spark, sf_dir):
    return targeted.zero_runs(_runs(spark, sf_dir), view.targets(spark, sf_dir))


def dropout(spark, sf_dir):
    return targeted.dropout(targeted.each_target(_runs(spark, sf_dir), view.targets(spark, sf_dir), [1]))


def target_enrichment(spark, sf_dir):
    return targeted.enrichment(target_partition(spark, sf_dir))


def target_d20(spark, sf_dir):
    return targeted.sums(_territory(spark, sf_dir)).select("d20")


def uniformity_penalty(spark, sf_dir):
    row = targeted.sums(_territory(spark, sf_dir))
    return targeted.uniformity_of(row)


def samtools_sn(spark, sf_dir):
    # The view's qualities are a formula of the offset, summed without rows for bases.
    quality = F.expr("aggregate(sequence(0, CAST(seq_len AS INT) - 1), CAST(0 AS BIGINT), (a, i) -> a + (h + 7 * i) % 42)")
    return ss.summary_numbers(view.reads(spark, sf_dir), F.when(F.col("seq_len") > 0, quality).otherwise(0))


def samtools_is(spark, sf_dir):
    return ss.insert_table(ss.insert_counts(view.reads(spark, sf_dir)))


def insert_orientation(spark, sf_dir):
    return ss.insert_totals(ss.insert_counts(view.reads(spark, sf_dir)))


def picard_insert_histogram(spark, sf_dir):
    return am.insert_histogram(am.insert_bins(view.reads(spark, sf_dir)))


def picard_insert_metrics(spark, sf_dir):
    m = am.insert_metrics(am.insert_bins(view.reads(spark, sf_dir)))
    scaled = lambda c, s: F.round(F.col(c) * s).cast("bigint")
    return m.select("orientation", "read_pairs", "mode", "least", "most", scaled("median", 2).alias("median_x2"), scaled("mad", 2).alias("mad_x2"), scaled("mean", 1000).alias("mean_x1000"), scaled("deviation", 1000).alias("deviation_x1000"))


def picard_insert_widths(spark, sf_dir):
    return am.insert_widths(am.insert_bins(view.reads(spark, sf_dir))).select("orientation", F.round(F.col("share") * 100).cast("bigint").alias("percent"), "width")


def picard_alignment_summary(spark, sf_dir):
    m = am.alignment_summary(view.reads(spark, sf_dir))
    return m.select("category", "total_reads", "pf_reads", "pf_noise_reads", "adapter_reads", "bad_cycles", "least", "most", F.round(F.col("median") * 2).cast("bigint").alias("median_x2"), F.round(F.col("mad") * 2).cast("bigint").alias("mad_x2"), F.round(F.col("mean") * 1000).cast("bigint").alias("mean_x1000"))


def adapter_reads(spark, sf_dir):
    return am.with_adapter(view.reads(spark, sf_dir)).where("adapter").groupBy("ref_id").agg(F.count("*").alias("reads"))


def no_call_cycles(spark, sf_dir):
    rows = am.category_rows(view.reads(spark, sf_dir)).where("category <> 'PAIR'")
    return am.no_calls(rows).select("category", "cycle", F.col("none").alias("no_calls"))


def bad_cycles(spark, sf_dir):
    """Cycles without a call where seven of eight reads have none at their first twelve cycles."""
    last = F.concat(F.expr("substr(seq, 1, CAST(seq_len AS INT) - 12)"), F.lit("N" * 12))
    masked = F.when(F.col("h") % 8 == 7, F.col("seq")).when(sam.has(sam.REVERSE), last).otherwise(F.concat(F.lit("N" * 12), F.expr("substr(seq, 13)")))
    return am.bad_cycles(am.category_rows(view.reads(spark, sf_dir).withColumn("seq", masked)))


def order_violations(spark, sf_dir):
    # The view's indices are far apart, so chunks are wide.
    return validation.order_violations(view.reads(spark, sf_dir).withColumnRenamed("rec", "rec_index"), chunk=1 << 47)


def crowded_loci(spark, sf_dir):
    return overlap.crowded_loci(overlap.genome_candidates(view.reads(spark, sf_dir)), cap=4, long_cigars=False)


def uncontained(spark, sf_dir):
    """Widened intervals that no merged interval of the targets contains."""
    wide = intervals.expand(view.targets(spark, sf_dir), view.refs(spark, sf_dir), 5).select("source_index", "ref_id", "start", "stop")
    return intervals.uncontained(wide, targeted.union_of(view.targets(spark, sf_dir), view.refs(spark, sf_dir)))


def reordered(spark, sf_dir):
    targets = view.targets(spark, sf_dir)
    return intervals.reordered(targets.withColumn("source_index", F.col("source_index") - 1))


def wgs_overlap(spark, sf_dir):
    kept = overlap.genome_candidates(view.reads(spark, sf_dir))
    base = F.substring(F.col("seq"), (F.col("query_at") + 1).cast("int"), F.lit(1))
    return overlap.base_partition(kept, ["h", "seq"], F.expr(view.quality()), base, long_cigars=False)


def hs_overlap(spark, sf_dir):
    return overlap.target_clip(view.reads(spark, sf_dir))


def violations(spark, sf_dir):
    broken = view.reads(spark, sf_dir).withColumn("pos", F.when(F.col("h") % 101 == 0, F.col("pos") + 30000).otherwise(F.col("pos"))).withColumn("flag", F.when(F.col("h") % 103 == 0, F.col("flag").bitwiseOR(F.lit(4096))).otherwise(F.col("flag")))
    return validation.violations(broken, view.refs(spark, sf_dir))


def broken_rules(spark, sf_dir):
    """Every rule of the checks with how many reads break it."""
    return validation.violations(view.broken_reads(spark, sf_dir), view.refs(spark, sf_dir))


def cigar_spans(spark, sf_dir):
    return cigar.spans(view.reads(spark, sf_dir))


def metric_diff(spark, sf_dir):
    by = lambda flags: idxstats(spark, sf_dir).where(flags).select(F.col("name").alias("metric"), F.col("mapped").cast("string").alias("value"))
    actual = view.reads(spark, sf_dir).where("ref_id >= 3 OR ref_id < 0").where(~sam.has(sam.UNMAPPED | sam.DUPLICATE)).groupBy("ref_id").agg(F.count("*").alias("n"))
    named = actual.join(view.refs(spark, sf_dir), "ref_id").select(F.col("name").alias("metric"), F.col("n").cast("string").alias("value"))
    return validation.metric_diff(by("ref_id < 20 AND ref_id >= 0"), named)


def typed_metric_diff(spark, sf_dir):
    """Three metrics of each contig against a second count with known differences."""
    counts = idxstats(spark, sf_dir).where("ref_id >= 0").withColumn("share", fixed(F.col("mapped"), F.col("length")))
    # Leading zeros are the same integer; -0.00 is the same decimal as 0.00.
    digits = F.when(F.col("ref_id") % 4 == 1, F.concat(F.lit("+00"), F.col("mapped").cast("string"))).otherwise(F.col("mapped").cast("string"))
    row = lambda kind, sort, value, *more: F.struct(F.concat(F.lit(f"{kind}."), F.col("name")).alias("metric"), F.lit(sort).alias("metric_type"), value, *more)
    told = lambda value, places, note: (value.alias("expected"), F.lit(places).cast("int").alias("decimals"), F.lit(note).cast("string").alias("note"))
    expected = counts.where("ref_id < 20").select(F.inline(F.array(
        row("mapped", "integer", *told(digits, None, None)), row("share", "decimal", *told(F.col("share"), 2, "two places")), row("label", "text", *told(F.col("name"), None, None)),
    )))
    again = view.reads(spark, sf_dir).where("ref_id >= 3").where(~sam.has(sam.UNMAPPED)).groupBy("ref_id").agg(F.count("*").alias("n"))
    named = again.join(view.refs(spark, sf_dir), "ref_id").withColumn("share", fixed(F.col("n") * 1000 + 3 * F.col("length"), F.col("length") * 1000))
    mapped = row("mapped", "integer", (F.col("n") - F.when(F.col("ref_id") % 3 == 0, 1).otherwise(0)).cast("string").alias("actual"))
    label = row("label", "text", F.when(F.col("ref_id") % 5 == 0, F.lower("name")).otherwise(F.col("name")).alias("actual"))
    actual = named.select("ref_id", F.inline(F.array(mapped, row("share", "decimal", F.col("share").alias("actual")), label)))
    seventh = (F.col("ref_id") == 7) & (F.col("metric_type") == "integer")
    return validation.typed_diff(expected, actual.withColumn("metric_type", F.when(seventh, "text").otherwise(F.col("metric_type"))))


NAMES = (
    "flagstat", "idxstats", "record_classes", "read_group_state", "depth_runs", "depth_histogram", "per_reference_coverage", "coverage_thresholds", "coverage_invariants", "target_merge", "selected_merge", "merge_provenance",
    "merge_report", "target_depth_histogram", "target_partition", "per_target_coverage", "zero_runs", "dropout", "target_enrichment", "target_d20", "uniformity_penalty", "samtools_sn", "samtools_is", "insert_orientation",
    "picard_insert_histogram", "picard_insert_metrics", "picard_insert_widths", "picard_alignment_summary", "adapter_reads", "no_call_cycles", "bad_cycles", "order_violations", "crowded_loci", "uncontained", "reordered", "wgs_overlap", "hs_overlap", "violations", "broken_rules", "cigar_spans", "metric_diff", "typed_metric_diff",
)


def queries() -> dict:
    made = {}
    for name in NAMES:
        query = globals()[name]
        made[name] = lambda spark, sf_dir, q=query: _longs(q(spark, sf_dir))
    return made

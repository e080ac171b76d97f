"""Fail-closed checks of reads, as one table of violations, and comparison of metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import sam
from readloom.functions.sam import has

# Fixed limits of a record's parts.
MAX_NAME, MAX_BASES, MAX_OPERATIONS = 1 << 20, 100_000_000, 1_000_000


def violations(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """rule, category and count of broken rules; empty where all reads are sound. One pass and one join by contig.

    Reads without names, mismatches or bases are not asked about them; `seq_length` stands for bases that are not there. A CIGAR's
    operations may have `times` (one at least): each stands for so many equal ones, so that a million of them need not be an array."""
    runs = "times" in reads.schema["cigar"].dataType.elementType.names
    operations = F.aggregate("cigar", F.lit(0).cast("bigint"), lambda a, o: a + o["times"]) if runs else F.size("cigar")
    bases = F.col("seq_length") if "seq_length" in reads.columns else sam.seq_length()
    lengths = refs.select(F.col("ref_id").alias("_ref"), F.col("length").alias("_length"))
    mates = refs.select(F.col("ref_id").alias("_mate"), F.col("length").alias("_mate_length"))
    r = reads.join(lengths, F.col("ref_id") == F.col("_ref"), "left").join(mates, F.col("mate_ref_id") == F.col("_mate"), "left")
    paired, mapped = has(sam.PAIRED), ~has(sam.UNMAPPED)
    no_mate_place = (F.col("mate_ref_id") == -1) & (F.col("mate_pos") == -1)
    end = F.col("pos") + sam.reference_span(runs)
    rules = {
        ("reserved_flag", "unsupported_record"): (F.col("flag") < 0) | (F.col("flag") > 0x0FFF),
        ("proper_without_pair", "input_corrupt"): has(sam.PROPER) & ~paired,
        ("read_number_without_pair", "input_corrupt"): has(sam.READ1 | sam.READ2) & ~paired,
        ("both_read_numbers", "input_corrupt"): has(sam.READ1) & has(sam.READ2),
        ("coordinate_below_sentinel", "input_corrupt"): (F.col("ref_id") < -1) | (F.col("pos") < -1),
        ("mate_below_sentinel", "input_corrupt"): (F.col("mate_ref_id") < -1) | (F.col("mate_pos") < -1),
        ("half_coordinate", "input_corrupt"): (F.col("ref_id") == -1) != (F.col("pos") == -1),
        ("mapped_without_coordinate", "input_corrupt"): mapped & (F.col("ref_id") == -1),
        ("unknown_reference", "input_corrupt"): (F.col("ref_id") >= 0) & F.col("_ref").isNull(),
        ("mate_half_coordinate", "input_corrupt"): paired & ((F.col("mate_ref_id") == -1) != (F.col("mate_pos") == -1)),
        ("mapped_mate_without_coordinate", "input_corrupt"): paired & ~has(sam.MATE_UNMAPPED) & no_mate_place,
        ("mate_unknown_reference", "input_corrupt"): paired & (F.col("mate_ref_id") >= 0) & F.col("_mate").isNull(),
        ("mate_beyond_reference", "input_corrupt"): paired & (F.col("mate_pos") >= F.col("_mate_length")),
        ("zero_length_operation", "input_corrupt"): F.array_min("cigar.len") <= 0,
        ("unknown_operation", "input_corrupt"): (F.array_min("cigar.op") < 0) | (F.array_max("cigar.op") > 8),
        ("query_span", "input_corrupt"): (F.size("cigar") > 0) & (sam.query_span(runs) != bases),
        ("mapped_without_cigar", "input_corrupt"): mapped & (F.size("cigar") <= 0),
        ("beyond_reference", "input_corrupt"): mapped & (F.col("ref_id") >= 0) & (end > F.col("_length")),
        ("negative_mismatches", "input_corrupt"): F.col("nm") < 0 if "nm" in reads.columns else F.lit(False),
        ("name_limit", "resource_limit"): F.length("qname") > MAX_NAME if "qname" in reads.columns else F.lit(False),
        ("sequence_limit", "resource_limit"): bases > MAX_BASES,
        ("operation_limit", "resource_limit"): operations > MAX_OPERATIONS,
    }
    counts = r.agg(*(F.count_if(test).alias(rule) for (rule, _), test in rules.items()))
    told = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.col(rule).alias("records")) for rule, category in rules))
    return counts.select(F.inline(told)).where("records > 0")


def order_violations(reads: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """rec_index of reads whose place is before that of the read before them, places without contig being last.

    Windows run inside chunks of rec_index; the last place of each chunk is carried to the next one that has rows.
    """
    place = F.struct(F.when(F.col("ref_id") < 0, F.lit(2**31 - 1)).otherwise(F.col("ref_id")).alias("r"), F.when(F.col("ref_id") < 0, F.lit(0)).otherwise(F.col("pos")).cast("bigint").alias("p"))
    rows = reads.select("rec_index", place.alias("place"), F.floor(F.col("rec_index") / chunk).alias("chunk"))
    along = Window.partitionBy("chunk").orderBy("rec_index")
    inner = rows.withColumn("before", F.lag("place").over(along)).where("place < before").select("rec_index")
    ends = rows.groupBy("chunk").agg(F.min_by("place", "rec_index").alias("first"), F.min("rec_index").alias("rec_index"), F.max_by("place", "rec_index").alias("last"))
    # A row for each chunk of a million reads.
    across = ends.withColumn("before", F.lag("last").over(Window.orderBy("chunk"))).where("first < before").select("rec_index")
    return inner.union(across)


def metric_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """metric, expected, actual, status (equal, different, missing, unexpected) of two tables (metric, value) of text."""
    both = expected.select("metric", F.col("value").alias("expected")).join(actual.select("metric", F.col("value").alias("actual")), "metric", "full_outer")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") == F.col("actual"), "equal").otherwise("different")
    return both.withColumn("status", status)


def scaled_decimal(text: Column, decimals: Column) -> Column:
    """A decimal text in units of 10^-decimals, rounded half away from zero, as decimal(38,0); no floating point.

    The text is digits with an optional sign and an optional point with digits; decimals are 0 to 18. Anything else fails the job,
    and so does a value that 38 digits don't hold.
    """
    good = text.rlike(r"^[-+]?[0-9]+(\.[0-9]*)?$") & decimals.between(0, 18)
    whole, fraction = F.regexp_extract(text, r"^[-+]?([0-9]+)", 1), F.regexp_extract(text, r"\.([0-9]*)$", 1)
    kept = F.rpad(F.substring(fraction, F.lit(1), decimals), decimals, "0")
    up = F.when(F.substring(fraction, decimals + 1, F.lit(1)) >= "5", 1).otherwise(0)
    size = F.concat(whole, kept).cast("decimal(38,0)") + up
    return F.when(good, F.when(text.startswith("-"), -size).otherwise(size).cast("decimal(38,0)")).otherwise(F.raise_error(F.concat(F.lit("no decimal of 0 to 18 places: "), text)).cast("decimal(38,0)"))


def scaled_integer(text: Column) -> Column:
    """A whole number's text as decimal(38,0); anything else fails the job."""
    return F.when(text.rlike("^[-+]?[0-9]+$"), text.cast("decimal(38,0)")).otherwise(F.raise_error(F.concat(F.lit("no integer: "), text)).cast("decimal(38,0)"))


def _declared(metrics: DataFrame, value: str) -> DataFrame:
    """metrics with a type that is known and a value that is there, each metric once; anything else fails the job."""
    blank = lambda c: F.coalesce(F.col(c).isin("", "-"), F.lit(True))
    bad = F.when(blank("metric") | blank(value), "a metric or its value is missing").when(~F.coalesce(F.col("metric_type").isin("integer", "decimal", "text"), F.lit(False)), F.concat(F.lit("unknown type of "), F.col("metric")))
    if "decimals" in metrics.columns:
        bad = bad.when((F.col("metric_type") == "decimal") != F.col("decimals").isNotNull(), F.concat(F.lit("places are declared for decimals alone: "), F.col("metric")))
    sound = metrics.where(F.when(bad.isNull(), True).otherwise(F.raise_error(bad).cast("boolean")))
    one = lambda c: F.max(c).alias(c)
    each = sound.groupBy("metric").agg(F.count("*").alias("_n"), *(one(c) for c in metrics.columns if c != "metric"))
    return each.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated metric "), F.col("metric"))).cast("boolean"))).drop("_n")


def typed_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """metric, metric_type, expected, actual, note, status of every metric of two tables.

    expected: metric, metric_type (integer, decimal, text), expected, decimals (places to round to, for decimals alone), note (nullable).
    actual: metric, metric_type, actual. Values are texts: integers compare as numbers, decimals after rounding both to the declared places
    half away from zero, text as it is. status: equal, value mismatch, type mismatch, missing actual metric, unexpected actual metric.
    A blank or repeated metric, an unknown type, a malformed number or places that aren't 0 to 18 fail the job. Both tables are
    dealt by metric once.
    """
    left = _declared(expected.select("metric", "metric_type", "expected", "decimals", "note"), "expected")
    checked = F.when(F.col("metric_type") == "integer", scaled_integer(F.col("expected"))).when(F.col("metric_type") == "decimal", scaled_decimal(F.col("expected"), F.col("decimals")))
    left = left.withColumn("_expected", checked)
    right = _declared(actual.select("metric", "metric_type", "actual"), "actual").withColumnRenamed("metric_type", "_type")
    both = left.join(right, "metric", "full_outer")
    seen = F.when(F.col("metric_type") == "integer", scaled_integer(F.col("actual"))).when(F.col("metric_type") == "decimal", scaled_decimal(F.col("actual"), F.col("decimals")))
    same = F.when(F.col("metric_type") == "text", F.col("expected") == F.col("actual")).otherwise(F.col("_expected") == seen)
    status = (
        F.when(F.col("_type").isNull(), "missing actual metric").when(F.col("metric_type").isNull(), "unexpected actual metric")
        .when(F.col("metric_type") != F.col("_type"), "type mismatch").when(same, "equal").otherwise("value mismatch")
    )
    return both.select("metric", F.coalesce("metric_type", "_type").alias("metric_type"), "expected", "actual", "note", status.alias("status"))

"""Flag counters, counts by contig, record classes and read-group states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import sam
from readloom.functions.sam import has

#: Columns of the flag counters, in report order.
FLAG_COLUMNS = (
    "total", "mapped", "unmapped", "duplicate", "secondary", "supplementary", "primary", "primary_mapped", "primary_duplicate", "paired", "read1", "read2",
    "proper_pair", "mate_unmapped", "singleton", "mate_mapped", "both_mapped", "mate_different_reference", "mate_different_reference_mapq5",
)


def _conditions() -> dict:
    mapped, primary = ~has(sam.UNMAPPED), ~has(sam.SECONDARY | sam.SUPPLEMENTARY)
    paired = primary & has(sam.PAIRED)
    mate_unmapped = has(sam.MATE_UNMAPPED)
    both = paired & ~mate_unmapped & mapped
    apart = both & (F.col("mate_ref_id") != F.col("ref_id"))
    values = (
        F.lit(True), mapped, ~mapped, has(sam.DUPLICATE), has(sam.SECONDARY), has(sam.SUPPLEMENTARY) & ~has(sam.SECONDARY), primary, primary & mapped, primary & has(sam.DUPLICATE), paired,
        paired & has(sam.READ1), paired & has(sam.READ2), paired & has(sam.PROPER) & mapped, paired & mate_unmapped, paired & mate_unmapped & mapped, paired & ~mate_unmapped, both, apart, apart & (F.col("mapq") >= 5),
    )
    return dict(zip(FLAG_COLUMNS, values, strict=True))


def flag_counters(reads: DataFrame) -> DataFrame:
    """One row for reads that pass and one for reads that fail quality control, also where there are none."""
    both = reads.sparkSession.createDataFrame([("pass",), ("fail",)], "qc string")
    counted = reads.groupBy(F.when(has(sam.QC_FAIL), "fail").otherwise("pass").alias("qc")).agg(*(F.count_if(c).alias(n) for n, c in _conditions().items()))
    return both.join(F.broadcast(counted), "qc", "left").na.fill(0)  # two rows at most


def contig_counts(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """ref_id, name, length, mapped, unmapped of every contig, and '*' (ref_id -1) for reads without a place."""
    counted = reads.groupBy("ref_id").agg(F.count_if(~has(sam.UNMAPPED)).alias("mapped"), F.count_if(has(sam.UNMAPPED)).alias("unmapped"))
    star = reads.sparkSession.createDataFrame([(-1, "*", 0)], sam.REF_SCHEMA)
    return refs.select("ref_id", "name", "length").union(star).join(counted, "ref_id", "left").na.fill(0, ["mapped", "unmapped"])


def record_classes(reads: DataFrame) -> DataFrame:
    return reads.groupBy(sam.record_class().alias("record_class")).agg(F.count("*").alias("records"))


def read_group_states(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """Records by state of their read group: missing, known (declared once), ambiguous (more than once) or unknown.

    groups: one row (id) for each declaration.
    """
    declared = groups.groupBy("id").agg(F.count("*").alias("times"))
    state = F.when(F.col("rg").isNull(), "missing").when(F.col("times").isNull(), "unknown").when(F.col("times") == 1, "known").otherwise("ambiguous")
    # Reads are counted by tag before the join, so only tags are joined.
    tagged = reads.groupBy("rg").agg(F.count("*").alias("n")).join(declared, F.col("rg") == F.col("id"), "left")
    return tagged.groupBy(state.alias("state")).agg(F.sum("n").alias("records"))

"""Summary numbers and the insert-size table in the style of `samtools stats` (sections SN and IS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import sam
from readloom.functions.sam import has

#: Inserts over this size count as this size.
LARGEST_INSERT = 8000


def fragment_order() -> Column:
    """first, last or other, by the pair flags."""
    one, two = has(sam.READ1), has(sam.READ2)
    return F.when(~has(sam.PAIRED), "first").when(one & ~two, "first").when(two & ~one, "last").otherwise("other")


def pair_orientation() -> Column:
    first = F.when(has(sam.READ1), 1).otherwise(-1)
    strand = F.when(has(sam.REVERSE), -1).otherwise(1)
    mate = F.when(has(sam.MATE_REVERSE), -1).otherwise(1)
    ahead = first * F.signum(F.col("mate_pos") - F.col("pos"))
    leads = first * strand > 0
    return F.when(strand * mate > 0, "other").when(ahead > 0, F.when(leads, "inward").otherwise("outward")).when(ahead < 0, F.when(leads, "outward").otherwise("inward")).otherwise("inward")


def _classes() -> dict[str, Column]:
    secondary, supplementary = has(sam.SECONDARY), has(sam.SUPPLEMENTARY) & ~has(sam.SECONDARY)
    there = ~secondary & (sam.seq_length() > 0)
    original = there & ~supplementary
    mapped = ~has(sam.UNMAPPED)
    pair = original & mapped & has(sam.PAIRED) & ~has(sam.MATE_UNMAPPED)
    return {"secondary": secondary, "supplementary": supplementary, "there": there, "original": original, "mapped": mapped, "pair": pair}


def summary_numbers(reads: DataFrame, quality_sum: Column | None = None) -> DataFrame:
    """One row of integer counters from one aggregate over one scan.

    quality_sum: the sum of a read's base qualities; by default over the bytes of `qual`.
    """
    k = _classes()
    length, order = sam.seq_length(), fragment_order()
    if quality_sum is None:
        quality_sum = F.aggregate(F.transform(F.sequence(F.lit(1), F.length("qual")), lambda i: F.conv(F.hex(F.substring("qual", i, F.lit(1))), 16, 10).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
        quality_sum = F.when(F.coalesce(F.length("qual"), F.lit(0)) > 0, quality_sum).otherwise(0)
    count = lambda c: F.count_if(c)
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    top = lambda c, x: F.coalesce(F.max(F.when(c, x)), F.lit(0))
    first, last = k["original"] & (order == "first"), k["original"] & (order == "last")
    placed = k["original"] & k["mapped"]
    both = k["there"] & k["mapped"]
    numbers = {
        "first_fragments": count(first), "last_fragments": count(last), "other_fragments": count(k["original"] & (order == "other")), "reads_mapped": count(placed), "reads_mapped_and_paired": count(k["pair"]),
        "reads_unmapped": count(k["original"] & ~k["mapped"]), "reads_properly_paired": count(k["pair"] & has(sam.PROPER)), "reads_paired": count(k["original"] & has(sam.PAIRED)), "reads_duplicated": count(k["there"] & has(sam.DUPLICATE)),
        "reads_mq0": count(placed & (F.col("mapq") == 0)), "reads_qc_failed": count(k["original"] & has(sam.QC_FAIL)), "non_primary": count(k["secondary"]), "supplementary": count(k["supplementary"]),
        "total_length": total(k["original"], length), "first_length": total(first, length), "last_length": total(last, length), "bases_mapped": total(placed, length), "bases_mapped_cigar": total(both, sam.aligned_bases()),
        "bases_duplicated": total(k["there"] & has(sam.DUPLICATE), length), "mismatches": total(both, F.coalesce("nm", F.lit(0))), "max_length": top(k["there"], sam.unclipped_length()),
        "max_first_length": top(k["there"] & (order == "first"), sam.unclipped_length()), "max_last_length": top(k["there"] & (order == "last"), sam.unclipped_length()),
        "quality_sum": total(first | last, quality_sum), "different_chromosomes": F.floor(count(k["pair"] & (F.col("mate_ref_id") != F.col("ref_id"))) / 2),
    }
    row = reads.agg(*(c.cast("bigint").alias(n) for n, c in numbers.items()))
    return row.withColumn("sequences", F.col("first_fragments") + F.col("last_fragments") + F.col("other_fragments"))


def insert_counts(reads: DataFrame) -> DataFrame:
    """size, inward, outward, other: observations by size, each cell halved downwards."""
    seen = reads.where(_classes()["pair"]).select(F.least(F.abs("tlen"), F.lit(LARGEST_INSERT)).alias("size"), pair_orientation().alias("way"), (F.col("ref_id") != F.col("mate_ref_id")).alias("apart"))
    kinds = ("inward", "outward", "other")
    cells = seen.where("NOT (size = 0 AND apart)").groupBy("size").agg(*(F.count_if(F.col("way") == w).alias(w) for w in kinds))
    return cells.select("size", *(F.floor(F.col(w) / 2).alias(w) for w in kinds))


def insert_table(counts: DataFrame, bulk: float = 0.99) -> DataFrame:
    """Dense rows 0 .. the size before which more than `bulk` of all pairs lie: size, pairs, inward, outward, other.

    The window runs over at most LARGEST_INSERT + 1 sizes.
    """
    sizes = counts.sparkSession.range(LARGEST_INSERT + 1).select(F.col("id").cast("int").alias("size"))
    dense = sizes.join(counts, "size", "left").na.fill(0).withColumn("pairs", F.col("inward") + F.col("outward") + F.col("other"))
    along = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    summed = dense.withColumns({"up_to": F.sum("pairs").over(along), "all": F.sum("pairs").over(Window.partitionBy())})
    ended = summed.withColumn("end", F.min(F.when((F.col("all") > 0) & (F.col("up_to") > F.lit(bulk) * F.col("all")), F.col("size"))).over(Window.partitionBy()))
    return ended.where("all > 0 AND size <= end").select("size", "pairs", "inward", "outward", "other")


def insert_totals(counts: DataFrame) -> DataFrame:
    """One row: pairs by orientation over all sizes."""
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("inward", "outward", "other")))

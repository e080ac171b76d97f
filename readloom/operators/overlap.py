"""Mate overlap: bases of one query name at one place, and clipping of a read's end behind its mate's start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import sam
from readloom.functions.sam import has
from readloom.errors import LoomError
from readloom.operators.cigar import bases, events, read_blocks
from readloom.operators.coverage import CHUNK, running_depth

LEAST_MAPQ, LEAST_QUALITY, LOCUS_CAP = 20, 20, 100_000


def genome_candidates(reads: DataFrame) -> DataFrame:
    """Reads whose bases the genome-wide correction looks at."""
    return reads.where(~has(sam.UNMAPPED | sam.SECONDARY | sam.QC_FAIL | sam.DUPLICATE | sam.MATE_UNMAPPED) & has(sam.PAIRED) & (F.col("mapq") >= LEAST_MAPQ))


def base_partition(reads: DataFrame, keep: list[str], quality: Column, base: Column, long_cigars: bool = True) -> DataFrame:
    """One row: retained, baseq_excluded and overlap_excluded bases.

    Of the eligible bases of one name at one place the first is retained and the others are excluded; only counts
    leave, so retained = distinct (name, contig, place). Eligible places are bits of words of 64 places: a read's bases fold into
    its words before the shuffle, which therefore grows with the reads, and any number of reads of one name are joined by "or".
    keep: columns that quality and base need besides query_at.
    """
    each = bases(reads, ["qname", "ref_id", *keep], long_cigars).withColumn("ok", (quality >= LEAST_QUALITY) & ~base.isin("N", "n", "."))
    bit = F.when(F.col("ok"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    eligible = F.when(F.col("ok"), 1).otherwise(0)
    words = each.groupBy("qname", "ref_id", F.call_function("shiftright", F.col("at"), F.lit(6)).alias("word")).agg(F.bit_or(bit).alias("places"), F.sum(eligible).alias("eligible"), F.count("*").alias("bases"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    kept = F.bit_count("places").cast("bigint")
    return words.agg(total(kept).alias("retained"), total(F.col("bases") - F.col("eligible")).alias("baseq_excluded"), total(F.col("eligible") - kept).alias("overlap_excluded"))


def crowded_runs(reads: DataFrame, cap: int = LOCUS_CAP, long_cigars: bool = True) -> DataFrame:
    """ref_id, start, stop, depth of stretches with over `cap` candidate bases at each place, from block ends alone.

    The names of the reads do not matter to the cap, so this is a depth over the candidates; no base has a row.
    """
    along = Window.partitionBy("ref_id", "chunk").orderBy("pos")
    deep = running_depth(events(read_blocks(reads, long_cigars), CHUNK))
    stop = F.coalesce(F.lead("pos").over(along), (F.col("chunk") + 1) * CHUNK)
    return deep.select("ref_id", F.col("pos").alias("start"), stop.alias("stop"), "depth").where(F.col("depth") > cap)


def crowded_loci(reads: DataFrame, cap: int = LOCUS_CAP, long_cigars: bool = True) -> DataFrame:
    """ref_id, at, bases of places with over `cap` candidate bases, which is fatal for the correction."""
    runs = crowded_runs(reads, cap, long_cigars)
    return runs.select("ref_id", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("at"), F.col("depth").alias("bases"))


def refuse_crowded(reads: DataFrame, cap: int = LOCUS_CAP) -> None:
    """Raise where the correction would have to hold over `cap` bases of one place."""
    first = crowded_runs(reads, cap).orderBy("ref_id", "start").first()
    if first:
        raise LoomError("resource_limit", f"over {cap} candidate bases at one place", f"contig {first['ref_id']}, place {first['start']}")


def clipped_behind_mate() -> Column:
    """Bases of a read from its mate's start on, as the targeted metrics clip them."""
    applies = has(sam.PAIRED) & ~has(sam.UNMAPPED | sam.MATE_UNMAPPED) & (F.col("mate_pos") >= 0) & (F.col("mate_pos") >= F.col("pos")) & ~((F.col("mate_pos") == F.col("pos")) & has(sam.READ1))
    mate = F.col("mate_pos")
    start = F.struct(F.col("pos").cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("cut"))

    def step(s, o):
        moves = o["op"].isin(0, 2, 3, 7, 8)
        last = F.when(moves, s["at"] + o["len"] - 1).otherwise(s["at"] - 1)
        part = F.when(o["op"] == 0, F.when(mate < s["at"], o["len"]).otherwise(s["at"] + o["len"] - mate)).when(o["op"].isin(1, 7, 8), o["len"]).otherwise(0)
        return F.struct(F.when(moves, s["at"] + o["len"]).otherwise(s["at"]).cast("bigint").alias("at"), (s["cut"] + F.when(mate <= last, part).otherwise(0)).cast("bigint").alias("cut"))

    return F.when(applies, F.aggregate("cigar", start, step, lambda s: s["cut"])).otherwise(0)


def target_clip(reads: DataFrame) -> DataFrame:
    """One row: clipped bases over the reads that the targeted metrics use."""
    kept = reads.where(~has(sam.SECONDARY | sam.QC_FAIL | sam.DUPLICATE) & (F.col("mapq") >= LEAST_MAPQ))
    return kept.agg(F.coalesce(F.sum(clipped_behind_mate()), F.lit(0)).cast("bigint").alias("clipped_bases"))

"""Alignment-summary and insert-size metrics in the style of Picard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.errors import LoomError
from readloom.functions import sam
from readloom.functions.sam import has

# The adapters whose 16-mers are looked for, the pieces' length, and the thresholds.
ADAPTERS = (
    "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT",
    "AGATCGGAAGAGCTCGTATGCCGTCTTCTGCTTG",
    "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT",
    "AGATCGGAAGAGCGGTTCAGCAGGAATGCCGAGACCGATCTCGTATGCCGTCTTCTGCTTG",
    "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT",
    "AGATCGGAAGAGCACACGTCTGAACTCCAGTCACNNNNNNNNATCTCGTATGCCGTCTTCTGCTTG",
)
PIECE, BAD_CYCLE_SHARE, LEAST_ORIENTATION, TRIM = 16, 0.8, 0.05, 10.0
WIDTHS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def adapter_pieces(adapters: tuple[str, ...] = ADAPTERS) -> list[str]:
    """Distinct 16-mers of the adapters and of their reverse complements, without those with over one N."""
    both = [s for a in adapters for s in (a, a.translate(_COMPLEMENT)[::-1])]
    return sorted({s[i : i + PIECE] for s in both for i in range(len(s) - PIECE + 1) if s[i : i + PIECE].count("N") <= 1})


def _oriented() -> Column:
    return F.when(~has(sam.UNMAPPED) & has(sam.REVERSE), sam.reverse_complement(F.col("seq"))).otherwise(F.upper("seq"))


def with_adapter(reads: DataFrame) -> DataFrame:
    """reads with a column adapter: whether the first 16 bases are an adapter piece with at most one difference.

    With one difference at most, one half of the piece is exact, so pieces are looked up by either half, in two broadcast tables of a
    few hundred rows, and only those found are compared base by base. Only unmapped reads and reads of mapping quality 0 are looked at.
    """
    half = PIECE // 2
    eligible = (F.coalesce(F.length("seq"), F.lit(0)) >= PIECE) & (has(sam.UNMAPPED) | (F.col("mapq") == 0))
    out = reads.withColumn("_head", F.when(eligible, F.translate(F.substring(_oriented(), 1, PIECE), ".", "N")))

    def near(p: Column) -> Column:
        differing = F.aggregate(F.sequence(F.lit(1), F.lit(PIECE)), F.lit(0), lambda a, i: a + F.when(F.substring("_head", i, F.lit(1)) == F.substring(p, i, F.lit(1)), 0).otherwise(1))
        return differing <= 1

    pieces = reads.sparkSession.createDataFrame([(p,) for p in adapter_pieces()], "piece string")
    for side, begin in (("_left", 1), ("_right", half + 1)):
        key = f"{side}_half"
        table = pieces.groupBy(F.substring("piece", begin, half).alias(key)).agg(F.collect_list("piece").alias(side))
        out = out.join(F.broadcast(table), F.substring("_head", begin, half) == F.col(key), "left").drop(key)
    found = F.exists(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("_left", "_right"))), near)
    return out.withColumn("adapter", found).drop("_head", "_left", "_right")


def category_rows(reads: DataFrame) -> DataFrame:
    """Primary reads by category: UNPAIRED, or PAIR and one of FIRST_OF_PAIR and SECOND_OF_PAIR."""
    side = F.when(has(sam.READ1), "FIRST_OF_PAIR").otherwise("SECOND_OF_PAIR")
    categories = F.when(has(sam.PAIRED), F.array(F.lit("PAIR"), side)).otherwise(F.array(F.lit("UNPAIRED")))
    kept = reads.where(~has(sam.SECONDARY | sam.SUPPLEMENTARY)).select("flag", "mapq", "seq", "xn")
    return with_adapter(kept).select("*", F.explode(categories).alias("category"))


def no_calls(rows: DataFrame) -> DataFrame:
    """category, cycle, none: reads without a call (N, n or .) at each cycle, in the order of sequencing. Only places without a call become rows."""
    bases = F.split(F.coalesce("seq", F.lit("")), "")
    places = F.filter(F.transform(bases, lambda b, i: F.when(b.isin("N", "n", "."), i)), lambda i: i.isNotNull())
    at = rows.select("category", "flag", F.length("seq").alias("n"), F.explode(places).alias("i"))
    cycle = F.when(has(sam.REVERSE), F.col("n") - F.col("i")).otherwise(F.col("i") + 1)
    return at.groupBy("category", cycle.alias("cycle")).agg(F.count("*").alias("none"))


def bad_cycles(rows: DataFrame) -> DataFrame:
    """category, bad_cycles: cycles at which at least four in five of all reads have no call; PAIR is the sum of its sides.

    No-calls are counted by cycle.
    """
    single = rows.where("category <> 'PAIR'")
    counts = no_calls(single)
    totals = single.groupBy("category").agg(F.count("*").alias("total"))
    bad = counts.join(totals, "category").where(F.col("none") / F.col("total") >= BAD_CYCLE_SHARE).groupBy("category").agg(F.count("*").alias("bad_cycles"))
    pair = bad.where("category <> 'UNPAIRED'").agg(F.sum("bad_cycles").alias("bad_cycles")).where("bad_cycles IS NOT NULL").select(F.lit("PAIR").alias("category"), "bad_cycles")
    return bad.union(pair)


def weighted_median(values: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Mean of the two middle ranks by group, from one row for each value."""
    along = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.select(*keys, value, F.sum(weight).over(along).alias("_up"), F.sum(weight).over(Window.partitionBy(*keys)).alias("_n"))
    low = F.min(F.when(F.col("_up") * 2 >= F.col("_n"), F.col(value)))
    high = F.min(F.when(F.col("_up") >= F.floor(F.col("_n") / 2) + 1, F.col(value)))
    return ranked.groupBy(*keys).agg(((low + high) / 2.0).alias(out))


def _spread(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median, mad, least, most of a histogram (keys, size, n)."""
    median = weighted_median(histogram, keys, "size", "n", "median")
    away = histogram.join(median, keys).groupBy(*keys, F.abs(F.col("size") - F.col("median")).alias("away")).agg(F.sum("n").alias("n"))
    mad = weighted_median(away, keys, "away", "n", "mad")
    ends = histogram.groupBy(*keys).agg(F.min("size").alias("least"), F.max("size").alias("most"))
    return median.join(mad, keys).join(ends, keys)


def moments(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean and sample deviation (null for one value), summed over bins in ascending order."""
    bins = histogram.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("bins"))  # one entry a size
    zero = F.lit(0.0)
    n = F.aggregate("bins", F.lit(0).cast("bigint"), lambda a, b: a + b["n"])
    mean = F.aggregate("bins", zero, lambda a, b: a + b["size"].cast("double") * b["n"]) / F.col("total")
    squares = F.aggregate("bins", zero, lambda a, b: a + F.pow(b["size"] - F.col("mean"), F.lit(2.0)) * b["n"])
    out = bins.withColumn("total", n).withColumn("mean", mean)
    return out.withColumn("deviation", F.when(F.col("total") > 1, F.sqrt(squares / (F.col("total") - 1)))).select(*keys, F.col("total").alias("n"), "mean", "deviation")


def alignment_summary(reads: DataFrame) -> DataFrame:
    """Rows by category: counts, adapter and noise reads, read-length statistics and bad cycles.

    FIRST, SECOND and PAIR are there only if some read is the first of a pair; UNPAIRED if it has reads or nothing else is there.
    """
    rows = category_rows(reads)
    # One aggregate over the reads; counts and lengths are sums of its few cells, whose exchange Spark reuses.
    noise = F.coalesce("xn", F.lit(False)).alias("noise")
    cells = rows.groupBy("category", (~has(sam.QC_FAIL)).alias("passing"), noise, "adapter", sam.seq_length().alias("size")).agg(F.count("*").alias("n"))
    total = lambda *tests: F.sum(F.when(F.expr(" AND ".join(tests)), F.col("n")).otherwise(0))
    counts = cells.groupBy("category").agg(F.sum("n").alias("total_reads"), total("passing").alias("pf_reads"), total("passing", "noise").alias("pf_noise_reads"), total("passing", "adapter").alias("adapter_reads"))
    lengths = cells.where("passing").groupBy("category", "size").agg(F.sum("n").alias("n"))
    names = ["UNPAIRED", "FIRST_OF_PAIR", "SECOND_OF_PAIR", "PAIR"]
    every = reads.sparkSession.createDataFrame([(c, i) for i, c in enumerate(names)], "category string, at int")
    out = every.join(counts, "category", "left").join(_spread(lengths, ["category"]), "category", "left").join(moments(lengths, ["category"]).drop("n"), "category", "left").join(bad_cycles(rows), "category", "left")
    out = out.na.fill(0, ["total_reads", "pf_reads", "pf_noise_reads", "adapter_reads", "bad_cycles"])
    pairs = F.max(F.when(F.col("category") == "FIRST_OF_PAIR", F.col("total_reads"))).over(Window.partitionBy()) > 0  # four rows
    shown = out.withColumn("_pairs", pairs).where(F.when(F.col("category") == "UNPAIRED", (F.col("total_reads") > 0) | ~F.col("_pairs")).otherwise(F.col("_pairs")))
    none = F.col("pf_reads") == 0
    zeros = {c: F.when(none, 0).otherwise(F.col(c)) for c in ("adapter_reads", "bad_cycles", "least", "most", "median", "mad", "mean")}
    return shown.withColumns(zeros).drop("_pairs")


def insert_orientation() -> Column:
    """FR, RF or TANDEM; null where a pair lies on two contigs, which refuse_split_pairs() refuses."""
    reverse = has(sam.REVERSE)
    plus = F.when(reverse, F.col("mate_pos") + 1).otherwise(F.col("pos") + 1)
    minus = F.when(reverse, F.col("pos") + sam.reference_span()).otherwise(F.col("pos") + 1 + F.col("tlen"))
    same = reverse == has(sam.MATE_REVERSE)
    return F.when(F.col("ref_id") != F.col("mate_ref_id"), None).when(same, "TANDEM").when(plus < minus, "FR").otherwise("RF")


def insert_bins(reads: DataFrame) -> DataFrame:
    """orientation, total, bins: an array of (size, n) by size, of the second reads of mapped pairs.

    One entry for each size that occurs, so an array is as long as the histogram. Orientations of five percent and
    fewer are dropped; 0.05 is the single-precision value, so exactly five percent is dropped. Pairs on two contigs keep a row
    with a null orientation, however few they are.
    """
    kept = reads.where(has(sam.PAIRED) & ~has(sam.UNMAPPED | sam.MATE_UNMAPPED | sam.READ1 | sam.SECONDARY | sam.SUPPLEMENTARY | sam.DUPLICATE) & (F.col("tlen") != 0))
    counts = kept.groupBy(insert_orientation().alias("orientation"), F.abs("tlen").alias("size")).agg(F.count("*").alias("n"))
    by = counts.groupBy("orientation").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("size", "n"))).alias("bins"))
    shares = by.withColumn("_all", F.sum("total").over(Window.partitionBy()))  # four rows at most
    return shares.where(F.col("orientation").isNull() | (F.col("total") >= F.col("_all") * F.lit(LEAST_ORIENTATION).cast("float").cast("double"))).drop("_all")


def refuse_split_pairs(bins: DataFrame) -> None:
    """Raise if insert_bins() has met a pair on two contigs."""
    if not bins.where("orientation IS NULL").isEmpty():
        raise LoomError("unsupported_record", "a pair lies on two contigs")


def insert_histogram(bins: DataFrame) -> DataFrame:
    """Of insert_bins(): orientation, size, n of the trimmed histogram, whose sizes are at most median + TRIM * mad."""
    limits = _trimmed(bins).select("orientation", F.size("_kept").alias("_count"))  # bins are sorted by size, so the first ones are kept
    return bins.join(limits, "orientation").select("orientation", F.posexplode("bins").alias("_at", "_bin"), "_count").where("_at < _count").select("orientation", "_bin.*")


def _at_rank(bins: Column, reached) -> Column:
    """The first value of sorted bins at which reached(count up to it) holds."""
    start = F.struct(F.lit(0).cast("bigint").alias("up"), F.lit(None).cast("double").alias("v"))

    def step(s, b):
        up = s["up"] + b["n"]
        return F.struct(up.alias("up"), F.when(s["v"].isNull() & reached(up), b["size"].cast("double")).otherwise(s["v"]).alias("v"))

    return F.aggregate(bins, start, step, lambda s: s["v"])


def _median_of(bins: Column, total: Column) -> Column:
    return (_at_rank(bins, lambda up: up * 2 >= total) + _at_rank(bins, lambda up: up >= F.floor(total / 2) + 1)) / 2


def _away(centre: Column) -> Column:
    return F.sort_array(F.transform("bins", lambda b: F.struct(F.abs(b["size"].cast("double") - centre).alias("size"), b["n"].alias("n"))))


def _trimmed(bins: DataFrame) -> DataFrame:
    """bins with median, mad and the bins kept by the trim."""
    t = bins.withColumn("median", _median_of(F.col("bins"), F.col("total"))).withColumn("_away", _away(F.col("median")))
    t = t.withColumn("mad", _median_of(F.col("_away"), F.col("total")))
    limit = F.floor(F.col("median") + TRIM * F.col("mad"))
    return t.withColumn("_kept", F.filter("bins", lambda b: b["size"] <= limit))


def insert_metrics(bins: DataFrame) -> DataFrame:
    """Of insert_bins(): orientation, read_pairs, median, mode, mad, least, most; mean and deviation of the trimmed histogram."""
    t = _trimmed(bins)
    t = t.withColumn("_n", F.aggregate("_kept", F.lit(0).cast("bigint"), lambda a, b: a + b["n"]))
    # Bins are summed in ascending order.
    t = t.withColumn("mean", F.aggregate("_kept", F.lit(0.0), lambda a, b: a + b["size"].cast("double") * b["n"]) / F.col("_n"))
    squares = F.aggregate("_kept", F.lit(0.0), lambda a, b: a + F.pow(b["size"] - F.col("mean"), F.lit(2.0)) * b["n"])
    mode = F.array_max(F.transform("bins", lambda b: F.struct(b["n"].alias("n"), (-b["size"]).alias("size"))))["size"]
    return t.select(
        "orientation", F.col("total").alias("read_pairs"), (-mode).alias("mode"), "median", "mad", F.col("bins")[0]["size"].alias("least"), F.element_at("bins", -1)["size"].alias("most"),
        "mean", F.when(F.col("_n") > 1, F.sqrt(squares / (F.col("_n") - 1))).alias("deviation"),
    )


def insert_widths(bins: DataFrame) -> DataFrame:
    """Of insert_bins(): orientation, share, width, the odd width around the median's floor that holds that share of pairs."""
    t = bins.withColumn("_away", _away(F.floor(_median_of(F.col("bins"), F.col("total")))))
    shares = F.array(*map(F.lit, WIDTHS))
    width = _at_rank(F.col("_away"), lambda up: up / F.col("total") >= F.col("share"))
    return t.select("*", F.explode(shares).alias("share")).select("orientation", "share", (width * 2 + 1).cast("bigint").alias("width"))

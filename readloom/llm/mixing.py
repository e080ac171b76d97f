"""Mixing sources to target weights by Poisson replication (operator 2).

A source's mean repetition rate is its target share of the output over its size. Each document draws its count
by inverting the Poisson distribution of that rate at a hash of seed, id and text, is exploded by the count, and all
copies are shuffled globally by a hash of their own. Counts depend on the document and the seed alone, so a lost
task gives the same copies again. A source that holds a third of all rows is summed before it is shuffled, and
the shuffle's hash spreads its copies evenly.

Defined results: a null source is a source of its own; a null or empty text weighs one character; equal rows draw
equal counts; a null id is a value like others; an empty table gives no rows. Rates over MAX_RATE are drawn as sums of several independent counts,
so that exp(-rate) never underflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.shared import stored

MAX_RATE = 200.0
#: Sources up to which their table of rates is broadcast.
BROADCAST_SOURCES = 100_000


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) from the first 13 hex digits (52 bits) of an md5."""
    joined = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """The least k with CDF(k) > u, by the recurrence of the terms; past rate + 14 deviations + 30 no term counts."""
    last = F.floor(rate + 14 * F.sqrt(rate) + 30).cast("int")

    def step(s, k):
        # The state carries u and the rate, so that neither is computed again in every step.
        more = s["cdf"] <= s["u"]
        term = s["term"] * s["rate"] / k
        return F.struct(
            F.when(more, k).otherwise(s["k"]).cast("int").alias("k"), F.when(more, term).otherwise(s["term"]).alias("term"), F.when(more, s["cdf"] + term).otherwise(s["cdf"]).alias("cdf"),
            s["u"].alias("u"), s["rate"].alias("rate"),
        )

    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("term"), F.exp(-rate).alias("cdf"), u.alias("u"), rate.alias("rate"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """source, n_docs, chars and rate. weights(source, weight): target shares; without them size ** temperature.

    The output's expected size is `epochs` times the input's. One row for each source, joined by key.
    """
    sized = docs.select(F.col("source").cast("string").alias("source"), F.greatest(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)), F.lit(1)).cast("long").alias("chars"))
    by = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("chars").alias("chars"))
    if weights is None:
        by = by.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(temperature)))
    else:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        by = by.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").na.fill(0.0, ["weight"])
    by = stored(by, "mixing-sources")
    totals = by.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars")).first()
    if not totals["all_weight"]:
        return by.withColumn("rate", F.lit(0.0)).drop("weight")
    # Rounding makes the rate a value that any engine can state exactly, whatever order it summed in.
    share = F.col("weight") / F.lit(float(totals["all_weight"])) * float(totals["all_chars"]) * epochs
    return by.withColumn("rate", F.round(share / F.col("chars"), 6)).drop("weight")


def replicate(docs: DataFrame, by_source: DataFrame, seed: int = 0) -> DataFrame:
    """docs' rows by their Poisson counts: whole (a struct of docs' columns), rate, copy (from 0) and shuffle_key."""
    shared = by_source.select("source", "rate")
    if by_source.count() <= BROADCAST_SOURCES:  # else Spark joins by key, splitting what is skewed
        shared = F.broadcast(shared)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    joined = rows.join(shared, F.col("whole.source").cast("string").eqNullSafe(F.col("source")))
    pieces = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    identity = [F.coalesce(F.col("whole.doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("whole.text").cast("string"), F.lit("")))]
    one = F.when(F.col("rate") > 0, poisson(F.col("rate"), uniform(F.lit(seed), *identity))).otherwise(0)
    many = F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0), lambda a, j: a + poisson(F.col("rate") / pieces, uniform(F.lit(seed), *identity, j)))
    count = F.when(pieces > 1, many).otherwise(one)
    copies = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    key = F.md5(F.concat_ws(":", F.lit(f"shuffle-{seed}"), *identity, F.col("copy").cast("string")))
    return joined.select("whole", "rate", F.explode(copies).alias("copy")).withColumn("shuffle_key", key)


def mixed_rows(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """The mixed corpus, globally shuffled: whole (a struct of docs' columns, whatever their names), rate, copy and shuffle_key.

    Every copy goes to a partition by shuffle_key, a hash of seed, id, text and copy, and partitions are sorted by
    it, so writing the result gives one random permutation of all copies. One shuffle, without a pass to sample ranges.
    """
    return replicate(docs, rates(docs, weights, temperature, epochs), seed).repartition("shuffle_key").sortWithinPartitions("shuffle_key", "copy")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """mixed_rows with docs' columns, copy, rate and shuffle_key; a column of docs that is named like a result is replaced."""
    kept = [F.col(f"whole.`{c}`") for c in docs.columns if c.lower() not in ("copy", "rate", "shuffle_key")]
    return mixed_rows(docs, weights, temperature, epochs, seed).select(*kept, "copy", "rate", "shuffle_key")


def share_report(mixed: DataFrame) -> DataFrame:
    """source, copies and share of copies of a mixed corpus."""
    by = mixed.groupBy("source").agg(F.count("*").alias("copies"))
    return by.withColumn("share", F.col("copies") / F.sum("copies").over(Window.partitionBy()))

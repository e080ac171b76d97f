"""Connected components by alternating large-star and small-star rounds, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.shared import bounded, stored

#: Edges of a node that one task takes.
HUB = 100_000


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One round over edges (u, v). Minima are partly summed before the shuffle, and a hub's edges are dealt to several tasks."""
    if larger:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).select("u", F.least("u", "least").alias("least"), F.ceil(F.col("n") / HUB).alias("salts"))
    hubs = bounded(least.where("salts > 1").select("u", F.col("salts").alias("of")))
    salted = both.join(hubs, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("of", F.lit(1)).cast("long"))).drop("of")
    least = least.select("u", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    joined = salted.join(least, ["u", "salt"])
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct(F.col("u").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of edges (u, v); an empty table gives no rows."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    known = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == known or not mark["n"]:
            break
        known = (mark["n"], mark["h"])
        edges = stored(_star(_star(edges, True), False), "cc")
    labels = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.union(roots.join(labels.select("node"), "node", "left_anti"))

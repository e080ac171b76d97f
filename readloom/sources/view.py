"""A deterministic alignment view over the star-schema tables: one read for each line item with its supplier.

The columns are SQL expressions that Spark and DuckDB read alike, in layers; a layer may use those before it. Every
product is in BIGINT, and doubles are floored before they become integers. An application writes the reads of a folder once,
as an aligner writes a file; queries then scan only the columns they use and evaluate no layer again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.storage import written

_BIG = "CAST({} AS BIGINT)".format
LAYERS: list[dict[str, str]] = [
    {
        "nk": _BIG("s_nationkey"),
        "ok": _BIG("l_orderkey"),
        "pk": _BIG("l_partkey"),
        "sk": _BIG("l_suppkey"),
        "ln": _BIG("l_linenumber"),
        "m1": _BIG("floor(20 + l_quantity)"),
        "del_len": _BIG("floor(l_discount * 100 + 0.5)"),
        "soft_len": _BIG("floor(l_tax * 100 + 0.5)"),
    },
    {
        "h": "ok * 17 + pk * 29 + ln * 13",
        "rec": "((ok * 8 + ln) * 100000 + pk) * 10000 + sk",
        "p0": "(pk * 7919 + ok * 31 + ln * 101) % (19600 + 400 * nk)",
        "ins_len": "ln % 3",
        "m2": "30 + ln * 5",
    },
    {"nocoord": "h % 50 = 0", "unm": "h % 50 IN (0, 1)", "pr": "h % 10 < 8"},
    {"mu": "pr AND h % 40 = 2", "seq_len": "m1 + ins_len + m2 + soft_len", "ref_id": f"CASE WHEN nocoord THEN -1 ELSE {_BIG('nk')} END", "pos": "CASE WHEN nocoord THEN -1 ELSE p0 END"},
    {
        "mate_ref_id": "CASE WHEN pr AND NOT mu THEN CASE WHEN h % 11 = 7 THEN (nk + 1) % 25 ELSE nk END ELSE -1 END",
        "mate_pos": "CASE WHEN pr AND NOT mu THEN (p0 + 37 * (h % 13)) % 19000 ELSE -1 END",
        "mapq": "CASE WHEN unm THEN 0 WHEN h % 9 = 0 THEN 0 ELSE h % 61 END",
        "nm": "CASE WHEN h % 5 = 0 THEN NULL ELSE h % 4 END",
        "qname": "concat('q', CAST(nk AS VARCHAR(20)), '_', CAST(CAST(floor(p0 / 50) AS BIGINT) AS VARCHAR(20)), '_', CAST(h % 4 AS VARCHAR(20)))",
        "seq": "substr(repeat('AATGATACGGCGACCACCGAGATCTACACNCT', 8), CAST(1 + h % 32 AS INT), CAST(seq_len AS INT))",
        "xn": "h % 29 = 0",
        "rg": "CASE WHEN h % 7 = 0 THEN NULL ELSE concat('rg', CAST(h % 6 AS VARCHAR(20))) END",
    },
    {
        "flag": " + ".join(
            f"CASE WHEN {test} THEN {bit} ELSE 0 END"
            for bit, test in {
                1: "pr", 2: "pr AND NOT mu AND NOT unm AND h % 3 <> 0", 4: "unm", 8: "mu", 16: "pk % 2 = 1", 32: "pr AND sk % 3 > 0", 64: "pr AND h % 2 = 0", 128: "pr AND h % 2 = 1",
                256: "h % 31 = 3", 512: "h % 23 = 5", 1024: "h % 19 = 6", 2048: "h % 37 = 4",
            }.items()
        ),
        "tlen": "CASE WHEN mate_ref_id <> ref_id OR h % 17 = 0 THEN 0 ELSE h % 600 - 300 END",
    },
]
_KEPT = "h, rec, nk, m1, ins_len, del_len, m2, soft_len, unm, seq_len, ref_id, pos, mate_ref_id, mate_pos, mapq, nm, qname, seq, xn, rg, flag, tlen"
#: Columns of broken_reads(): for each rule of `operators.validation` some reads break it, chosen by `h`. `extra_ops` operations of length
#: `extra_len` and code `extra_op` follow a read's own ones.
BROKEN = {
    "flag": "CASE h % 1009 WHEN 1 THEN flag + 4096 WHEN 2 THEN 2 WHEN 3 THEN 64 WHEN 4 THEN 193 WHEN 8 THEN 0 WHEN 10 THEN 1 WHEN 11 THEN 1 WHEN 12 THEN 1 WHEN 13 THEN 1 WHEN 17 THEN 0 ELSE flag END",
    "ref_id": "CASE h % 1009 WHEN 7 THEN -1 WHEN 8 THEN -1 WHEN 9 THEN 99 ELSE ref_id END",
    "pos": "CASE h % 1009 WHEN 5 THEN -2 WHEN 7 THEN 100 WHEN 8 THEN -1 WHEN 18 THEN pos + 30000 ELSE pos END",
    "mate_ref_id": "CASE h % 1009 WHEN 10 THEN -1 WHEN 11 THEN -1 WHEN 12 THEN 77 WHEN 13 THEN 0 ELSE mate_ref_id END",
    "mate_pos": "CASE h % 1009 WHEN 6 THEN -2 WHEN 10 THEN 5 WHEN 11 THEN -1 WHEN 12 THEN 3 WHEN 13 THEN 20000 ELSE mate_pos END",
    "nm": "CASE WHEN h % 1009 = 19 THEN -1 ELSE nm END",
    "seq_length": "CASE WHEN h % 1009 = 16 THEN seq_len + 1 WHEN h % 10007 = 5 THEN 100000001 ELSE seq_len END",
    "qname": "CASE WHEN h % 10007 = 3 THEN repeat('q', 1048577) ELSE qname END",
    "bare": "unm OR h % 1009 = 17",
    "extra_op": "CASE WHEN h % 1009 = 15 THEN 9 ELSE 5 END",
    "extra_len": "CASE WHEN h % 1009 = 14 THEN 0 ELSE 1 END",
    "extra_ops": "CASE WHEN h % 1009 IN (14, 15) THEN 1 WHEN h % 10007 = 7 THEN 1000000 ELSE 0 END",
}
REFS_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS ref_id, n_name AS name, CAST(20000 + 400 * n_nationkey AS BIGINT) AS length FROM nation"
TARGETS_SQL = (
    "SELECT CAST(p_partkey AS BIGINT) AS source_index, CAST(p_partkey % 25 AS BIGINT) AS ref_id, CAST((p_partkey * 997) % 19000 AS BIGINT) AS start,"
    " CAST((p_partkey * 997) % 19000 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size * 10 END AS BIGINT) AS stop FROM part"
)


def reads_sql() -> str:
    """The view's reads as nested SELECTs."""
    sql = "lineitem JOIN supplier ON l_suppkey = s_suppkey"
    for i, layer in enumerate(LAYERS):
        sql = f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in layer.items())} FROM {sql}) t{i}"
    return f"SELECT {_KEPT} FROM {sql}"


_written: dict[tuple[str, str], tuple[str, object]] = {}


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's reads with a CIGAR array (zero lengths dropped, empty when unmapped), written once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        made = _layered(spark, sf_dir)
        least = spark.sparkContext.defaultParallelism
        if made.rdd.getNumPartitions() < least:  # a small table of one row group would leave all later scans one task
            made = made.repartition(least, "rec")
        _written[key] = (written(made, "reads"), made.schema)
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("l_suppkey") == F.col("s_suppkey"))
    for layer in LAYERS:
        out = out.selectExpr("*", *(f"{e} AS {c}" for c, e in layer.items()))
    parts = (("m1", 0), ("ins_len", 1), ("del_len", 2), ("m2", 0), ("soft_len", 4))
    ops = F.array(*(F.struct(F.col(c).cast("int").alias("len"), F.lit(op).alias("op")) for c, op in parts))
    out = out.withColumn("cigar", F.when(F.col("unm"), F.array().cast(ops_type())).otherwise(F.filter(ops, lambda o: o["len"] > 0)))
    casts = {c: F.col(c).cast("int") for c in ("flag", "mapq", "tlen", "ref_id", "mate_ref_id")}
    return out.withColumns(casts).select(*_KEPT.split(", "), "cigar")


def broken_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's reads with the columns of BROKEN: every rule of the checks is broken by some of them.

    Operations of a CIGAR have `times`, as some reads have a million equal ones."""
    plain = reads(spark, sf_dir).drop("seq")
    made = plain.selectExpr("h", "cigar", *(f"{e} AS {c}" for c, e in BROKEN.items()))
    extra = F.array(F.struct(F.col("extra_len").cast("int").alias("len"), F.col("extra_op").cast("int").alias("op"), F.col("extra_ops").cast("int").alias("times")))
    own = F.transform("cigar", lambda o: F.struct(o["len"].alias("len"), o["op"].alias("op"), F.lit(1).alias("times")))
    cigar = F.when(F.col("bare"), F.array().cast("array<struct<len: int, op: int, times: int>>")).otherwise(own)
    return made.withColumn("cigar", F.when(F.col("extra_ops") > 0, F.concat(cigar, extra)).otherwise(cigar))


def ops_type() -> str:
    return "array<struct<len: int, op: int>>"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select(F.col("n_nationkey").cast("int").alias("ref_id"), F.col("n_name").alias("name"), (20000 + 400 * F.col("n_nationkey")).cast("bigint").alias("length"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval over the view's contigs for each part; every third one is empty."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    start = ((F.col("p_partkey") * 997) % 19000).cast("bigint")
    length = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.col("p_size") * 10).cast("bigint")
    return part.select(F.col("p_partkey").cast("bigint").alias("source_index"), (F.col("p_partkey") % 25).cast("int").alias("ref_id"), start.alias("start"), (start + length).alias("stop"))


def quality(offset: str = "query_at") -> str:
    """Base quality at a query offset of the view, computed and not stored."""
    return f"(h + 7 * {offset}) % 42"

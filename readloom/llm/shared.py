"""What the text operators share: tables in the cluster's shared folder and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local temporary one only where that is unset (tests)."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="readloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a cut of lineage that outlives any executor.

    The files go when the application's JVM ends.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of an Arrow batch. Whole texts are some thousand bytes each, and both sides hold several batches at once.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let this session send texts to Python in batches of at most BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, without copying; a null is an empty text."""
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about `limit` bytes; a longer row is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


#: Rows up to which a table's count lets it be broadcast.
BROADCAST_ROWS = 300_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df of a few narrow columns, marked for a broadcast if it has no more than so many rows; else Spark joins it by key."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bits for each key of a bitmap that thins a scan, and buckets of 2^15 bits that it has at most (16 MB).
BITS_A_KEY, MOST_BUCKETS = 16, 4096


def thinned(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose long `key` may be among wanted's, by a broadcast bitmap; a join on the key drops what hits a bit by chance.

    The bitmap grows with wanted's rows up to MOST_BUCKETS; beyond about 100 million keys fewer rows are kept from that join's shuffle.
    """
    n = wanted.count()
    buckets = min(MOST_BUCKETS, max(1, -(-n * BITS_A_KEY // 32768)))
    at = lambda df: F.pmod(df[key], F.lit(buckets * 32768)) + 1
    marks = wanted.select(at(wanted).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    placed = rows.withColumn("_bit", F.bitmap_bit_position(at(rows))).withColumn("_bucket", F.bitmap_bucket_number(at(rows)))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = placed.join(F.broadcast(marks), "_bucket").where((byte / F.pow(F.lit(2.0), F.col("_bit") % 8)).cast("long") % 2 == 1)
    return hit.drop("_bit", "_bucket", "_bits")

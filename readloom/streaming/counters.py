"""Flag counters and contig counts over a stream of reads, kept in a table that each batch adds to.

The counters are sums, so a batch's rows are aggregated by Spark and appended under the batch's id; a batch that runs again
replaces its own rows, which keeps totals right after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.functions import sam
from readloom.operators.counters import FLAG_COLUMNS, flag_counters


def start_counting(reads: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Count a streaming DataFrame of reads into Parquet under `table`, one folder for each batch."""

    def add(batch: DataFrame, batch_id: int) -> None:
        flags = flag_counters(batch).select("qc", F.lit("").alias("part"), *FLAG_COLUMNS)
        flags.write.mode("overwrite").parquet(f"{table}/flags/batch={batch_id}")
        contigs = batch.groupBy("ref_id").agg(F.count_if(~sam.has(sam.UNMAPPED)).alias("mapped"), F.count_if(sam.has(sam.UNMAPPED)).alias("unmapped"))
        contigs.write.mode("overwrite").parquet(f"{table}/contigs/batch={batch_id}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark, table: str) -> DataFrame:
    """The flag counters of all batches so far."""
    return spark.read.parquet(f"{table}/flags").groupBy("qc").agg(*(F.sum(c).alias(c) for c in FLAG_COLUMNS))

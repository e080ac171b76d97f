"""A corpus pipeline of five text operators; counted as part of readloom.llm.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents. run() applies all of them.

Nulls: a null text is judged as one without words, is no copy of anything, holds no personal data, and encodes to no tokens; rows
without an id are judged, kept as no copies, redacted, mixed and encoded like others. Repeated rows stay repeated (they are one
document to near_copies, which keeps all or none). Columns beside documents' own, whatever their names, pass unchanged up to the
last stage, which names its columns. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import bpe, jaccard, mixing, pii, toxicity
from readloom.llm.queries import tokenizer_path
from readloom.llm.shared import small_batches, stored

#: SQL can't state a trained classifier or a merge table, so there is none; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    small_batches(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    small_batches(spark)
    redacted = pii.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return redacted


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to weights in proportion to the root of their size, globally shuffled."""
    small_batches(spark)
    return mixing.mixed_rows(docs).select("whole.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    small_batches(spark)
    encoded = bpe.bpe_encode(docs.select("doc_id", "source", "lang", "text"), tokenizer_path())
    return encoded.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's result over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

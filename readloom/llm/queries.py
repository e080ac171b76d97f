"""The text operators' queries over whole tables, and the SQL that states some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import ann, bpe, centroids, jaccard, lexical, licenses, lm, media, mixing, pii, sharding, substrings, toxicity
from readloom.llm.shared import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file that op3 uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.pii_spans(_table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_discovered")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", F.col("copy").cast("int").alias("copy"), "rate", "shuffle_key")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(_table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digest(_table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, _table(spark, sf_dir, "labels")).select("doc_id", "p_poor", "p_toxic", "is_toxic")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digest(_table(spark, sf_dir, "embeddings"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_mixing": op2_mixing,
        "op3_bpe": op3_bpe,
        "op4_sharding": op4_sharding,
        "op5_ann": op5_ann,
        "op6_media": op6_media,
        "op7_substrings": op7_substrings,
        "op8_jaccard": op8_jaccard,
        "op9_toxicity": op9_toxicity,
        "op10_lm": op10_lm,
        "op11_centroids": op11_centroids,
        "op12_lexical": op12_lexical,
        "op13_licenses": op13_licenses,
    }


# The Poisson count as the number of terms whose running sum does not exceed the document's uniform value.
OP2_SQL = """
WITH RECURSIVE by_source AS (
  SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS chars FROM documents GROUP BY source
), totals AS (SELECT sum(sqrt(chars)) AS w, sum(chars) AS c FROM by_source),
rates AS (
  SELECT source, round(sqrt(chars) / totals.w * totals.c / chars, 6) AS rate FROM by_source, totals
), terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM terms
  WHERE k + 1 <= floor(rate + 14 * sqrt(rate) + 30)
), drawn AS (
  SELECT d.*, ('0x' || substr(md5('0:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d
), copies AS (
  SELECT d.doc_id, d.source, d.text, t.k AS copy, t.rate
  FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.cdf <= d.u
)
SELECT doc_id, source, text, copy::INTEGER AS copy, rate,
  md5('shuffle-0:' || doc_id || ':' || md5(coalesce(text, '')) || ':' || copy) AS shuffle_key
FROM copies
"""


_SQUARES = "list_sum(list_transform(list_zip(a.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def _assigned(name: str, centroids: str) -> str:
    """Every vector with every centroid, the nearest of which stays."""
    return f"""{name} AS (
  SELECT row, vec_id, v, cluster, distance FROM (
    SELECT a.row, a.vec_id, a.v, c.cluster, {_SQUARES} AS distance FROM kept a, {centroids} c
  ) QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1
)"""


def _moved(name: str, assigned: str, before: str) -> str:
    return f"""{name}_sums AS (
  SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {assigned}) GROUP BY cluster, i
), {name} AS (
  SELECT b.cluster, coalesce(m.v, b.v) AS v FROM {before} b LEFT JOIN (SELECT cluster, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS v FROM {name}_sums GROUP BY cluster) m USING (cluster)
)"""


def _op11_sql(rounds: int = 3) -> str:
    steps = []
    for r in range(rounds):
        steps += [_assigned(f"a{r}", f"c{r}"), _moved(f"c{r + 1}", f"a{r}", f"c{r}")]
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), v) - 1)::INTEGER AS cluster, v FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < 16
), {", ".join(steps)}, {_assigned("last", f"c{rounds}")}
SELECT l.vec_id, l.cluster, l.distance, (sum(l.distance) OVER (PARTITION BY l.cluster))::BIGINT AS cluster_inertia, (sum(l.distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last l JOIN c{rounds} c USING (cluster)
"""


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
sums AS (SELECT count(*) FILTER (len(words) > 0)::BIGINT AS docs, sum(len(words))::BIGINT AS terms FROM d),
held AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(words) AS term FROM d) GROUP BY row, term),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_WORDS.format("text")}) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)) GROUP BY item_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), sums
), scored AS (
  SELECT a.item_id, h.row, sum(a.times * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (100 - 25 + (25 * len(d.words) * sums.docs) // sums.terms))))::BIGINT AS score
  FROM asked a JOIN held h USING (term) JOIN weights w USING (term) JOIN d USING (row), sums GROUP BY a.item_id, h.row
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored JOIN d USING (row) WHERE score > 0 QUALIFY rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op11_centroids": _op11_sql(), "op12_lexical": OP12_SQL}

"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 5).

Every vector is centred, rotated by a seeded random orthogonal matrix and reduced to its signs: one packed bit a
dimension, with two correction scalars (its distance from the centre and the code's inner product with the
rotated unit vector). A query's inner product with a vector is estimated from the packed bits and the scalars,
with an error bound; only vectors whose upper bound reaches the k-th best true score so far are reranked with the
original vectors in double precision.

Vectors are dealt by hash into blocks of BLOCK rows and queries into blocks of QUERIES. All rows are indexed and every
query block meets every block of vectors, so the only loss is the bound's (measured in the tests); the work is the
number of queries times that of vectors, at one bit a dimension for most of it.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, neither as queries nor as candidates. Rows repeated under one vec_id are candidates each, never of their own id; a
query id asks once, with the vector of least hash if its rows differ.
Ties in score go to the smaller vec_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.shared import stored

BLOCK, QUERIES, SLICES = 1024, 512, 6
#: Width of the error bound, in standard deviations of the estimate for a random rotation.
EPSILON = 2.2


def rotation(dimensions: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distance from the centre, and the code's inner product with the rotated unit vector."""
    moved = vectors - centre
    length = np.linalg.norm(moved, axis=1)
    unit = moved / np.where(length > 0, length, 1)[:, None] @ turn.T
    return np.packbits(unit > 0, axis=1), length, np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])


def estimate(bits: np.ndarray, length: np.ndarray, alignment: np.ndarray, centre: np.ndarray, turn: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries, vectors) and their error bounds, from codes and scalars alone."""
    d = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * np.float32(2 / np.sqrt(d)) - np.float32(1 / np.sqrt(d))
    turned = (queries @ turn.T).astype(np.float32)
    safe = np.where(alignment > 0, alignment, 1)
    guess = (queries @ centre)[:, None] + (turned @ signs.T) * (length / safe)[None, :]
    spread = length * np.sqrt(np.maximum(1 - safe**2, 0)) / safe * EPSILON / np.sqrt(max(d - 1, 1))
    return guess, np.linalg.norm(queries, axis=1)[:, None] * spread[None, :]


def search_block(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray, length: np.ndarray, alignment: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[int, int, float]]:
    """Candidates of each query in one block; floors: the k-th best score that a query has already, or -inf."""
    guess, bound = estimate(bits, length, alignment, centre, turn, queries)
    out = []
    for i, q in enumerate(queries):
        other = ids != q_ids[i]
        usable = np.flatnonzero(other)
        if not len(usable):
            continue
        if floors[i] > -np.inf:
            chosen = np.flatnonzero(other & (guess[i] + bound[i] >= floors[i]))
        else:
            first = usable[np.argpartition(-guess[i, usable], min(2 * k, len(usable)) - 1)[: 2 * k]]
            floor = np.sort((vectors[first] * q).sum(axis=1))[-min(k, len(first))]
            chosen = np.union1d(np.flatnonzero(other & (guess[i] + bound[i] >= floor)), first)
        score = (vectors[chosen] * q).sum(axis=1)
        best = np.lexsort((ids[chosen], -score))[:k]
        out += [(int(q_ids[i]), int(ids[chosen[j]]), float(score[j])) for j in best]
    return out


def usable_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def nearest(df: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest by inner product. is_query: a condition on vec_id."""
    rows = stored(usable_vectors(df, id_column, vector), "ann-rows")
    spark = rows.sparkSession
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).orderBy(F.desc("n"), "d").first()
    result = "query_id long, vec_id long, score double"
    if size is None or not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n_blocks, n_queries = size["d"], -(-size["n"] // BLOCK), -(-size["q"] // QUERIES)
    rows = rows.where(F.size("v") == d)
    mean = {r["pos"]: r["m"] for r in rows.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).collect()}
    centre, turn = np.array([mean[i] for i in range(d)]), rotation(d)  # d and d*d doubles

    def pack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = table.column("v").combine_chunks()
        return table.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def index(table: pa.Table) -> pa.Table:
        ids, vectors = pack(table)
        bits, length, alignment = encode(vectors, centre, turn)
        parts = [ids.astype(np.int64), vectors, bits, length, alignment]
        return pa.table([[table.column("block")[0].as_py()], *([p.tobytes()] for p in parts)], names=["block", "ids", "vectors", "bits", "length", "alignment"])

    def gather(table: pa.Table) -> pa.Table:
        ids, vectors = pack(table)
        return pa.table([[table.column("q_block")[0].as_py()], [ids.astype(np.int64).tobytes()], [vectors.tobytes()]], names=["q_block", "q_ids", "queries"])

    at = F.xxhash64("vec_id", F.monotonically_increasing_id())
    blocks = rows.withColumn("block", F.pmod(at, F.lit(n_blocks))).groupBy("block").applyInArrow(index, "block long, ids binary, vectors binary, bits binary, length binary, alignment binary")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    asked = queries.withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_queries))).groupBy("q_block").applyInArrow(gather, "q_block long, q_ids binary, queries binary")
    # A block of vectors goes once to each block of queries. A query block's work is dealt into SLICES streams, each of
    # which reads its queries first and then vectors block by block, so it holds k results a query and gives no more.
    zero = F.lit(0).cast("long")
    left = blocks.select(F.explode(F.sequence(zero, F.lit(n_queries - 1).cast("long"))).alias("q_block"), F.pmod("block", F.lit(SLICES)).alias("slice"), F.col("block").alias("at"), "ids", "vectors", "bits", "length", "alignment")
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("bits", "length", "alignment")]
    right = asked.select("q_block", F.explode(F.sequence(zero, F.lit(SLICES - 1).cast("long"))).alias("slice"), F.lit(-1).cast("long").alias("at"), F.col("q_ids").alias("ids"), F.col("queries").alias("vectors"), *nothing)
    streams = left.union(right).repartition("q_block", "slice").sortWithinPartitions("q_block", "slice", "at")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids = queries = None
        best: dict[int, list[tuple[float, int]]] = {}

        def done() -> pa.RecordBatch:
            rows = [(q, i, -s) for q, found in best.items() for s, i in found]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(len(batch)):
                get = lambda c, t: np.frombuffer(batch.column(c)[row].as_buffer(), t)  # noqa: B023, E731
                ids, vectors = get("ids", np.int64), get("vectors", float).reshape(-1, d)
                if batch.column("at")[row].as_py() < 0:
                    yield done()
                    q_ids, queries, best = ids, vectors, {}
                    continue
                floors = np.array([-best[q][k - 1][0] if len(best.get(q, ())) >= k else -np.inf for q in q_ids.tolist()])
                for q, i, s in search_block(q_ids, queries, ids, vectors, get("bits", np.uint8).reshape(len(ids), -1), get("length", float), get("alignment", float), centre, turn, k, floors):
                    best.setdefault(q, []).append((-s, i))
                best = {q: sorted(found)[:k] for q, found in best.items()}
        yield done()

    found = streams.mapInArrow(search, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

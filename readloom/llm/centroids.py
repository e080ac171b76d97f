"""Centroid clustering over an n-simplex projection (operator 11).

Vectors are turned into integers. A few pivots are chosen among the starting centroids, each as far as possible from the span of
those before it, and every vector's distances to them are measured once: they determine the vector's apex over the simplex that the
pivots form, one coordinate a pivot, which is stored beside the vector. From two apices follow a lower and an upper Euclidean bound on the
distance of their vectors (the apices on one side of the base and on both sides of it). In each round a centroid gets its apex in the same
way; for a vector, centroids whose lower bound exceeds the least upper bound are dropped, and the rest are compared by exact integer
distance. Bounds are widened by SLACK of the squared sizes for rounding, so that the result is that of comparing all.

Rounds read the stored table, add up by task and cluster, and bring home centroids * dimensions sums; nothing else is shuffled.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part. A null id can't start a
centroid, but its vector is assigned. Repeated rows are vectors each. Equal hashes of starting ids are taken by smaller vector. With fewer
vectors than centroids, every vector with an id starts one. Without centroids (no ids) or vectors there are no rows. Components beyond
2^27 in size, whose squared distances may not fit 64 bits, are refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.shared import stored

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, PIVOTS = 16, 3, 64, 64, 16
#: A pivot's height over those before it, as a share of the largest squared distance, and what bounds are widened by.
LEAST_HEIGHT, SLACK, LARGEST = 1e-3, 1e-7, 1 << 27


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a to rows of b."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


class Simplex:
    """Pivots and the lower triangular coordinates of the simplex that they form, the first at the origin."""

    def __init__(self, candidates: np.ndarray, most: int):
        between = squared(candidates, candidates).astype(float)
        chosen, gram = [0], (between[0][:, None] + between[0][None, :] - between) / 2
        left, steps = np.diag(gram).copy(), np.zeros((len(candidates), 0))
        scale = left.max(initial=0.0)
        while len(chosen) < most and scale > 0 and left.max() > LEAST_HEIGHT * scale:
            k = int(left.argmax())
            step = (gram[:, k] - steps @ steps[k]) / np.sqrt(left[k])
            steps = np.column_stack([steps, step])
            left -= step**2
            left[[*chosen, k]] = 0
            chosen.append(k)
        self.pivots, self.base = candidates[chosen], np.tril(steps[chosen[1:]])

    def apices(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates from distances to the pivots alone; the last one is the height over the pivots' span."""
        to = squared(vectors, self.pivots).astype(float)
        m, size = len(self.base), (self.base**2).sum(axis=1)
        out = np.zeros((len(vectors), m + 1))
        for i in range(m):
            inner = (to[:, 0] + size[i] - to[:, i + 1]) / 2
            out[:, i] = (inner - out[:, :i] @ self.base[i, :i]) / self.base[i, i]
        out[:, m] = np.sqrt(np.maximum(to[:, 0] - (out[:, :m] ** 2).sum(axis=1), 0))
        return out


def open_pairs(apices: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which (vector, centroid) pairs the bounds leave to the exact comparison."""
    flat = (apices[:, None, :-1] - centroids[None, :, :-1]) ** 2
    flat, low, high = flat.sum(axis=2), apices[:, -1:] - centroids[None, :, -1], apices[:, -1:] + centroids[None, :, -1]
    slack = SLACK * ((apices**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None, :])
    return flat + low**2 - slack <= (flat + high**2 + slack).min(axis=1, keepdims=True)


def assign(vectors: np.ndarray, apices: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray]:
    """Number of and exact squared distance to the nearest centroid, the smaller number of equally near ones."""
    left = open_pairs(apices, simplex.apices(centroids))
    row, column = np.nonzero(left)
    exact = np.full(left.shape, np.iinfo(np.int64).max)
    exact[row, column] = ((vectors[row] - centroids[column]) ** 2).sum(axis=1)
    nearest = exact.argmin(axis=1)
    return nearest, exact[np.arange(len(vectors)), nearest]


def integer_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<bigint>, floors of scale times the components) of the vectors that take part."""
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.size("v") == dimensions)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = rows.where(F.coalesce(finite, F.lit(False)))
    fits = F.forall("v", lambda x: F.abs(x) * scale < LARGEST)
    checked = F.when(fits, F.col("v")).otherwise(F.raise_error("a component is too large for 64-bit distances"))
    return held.select("vec_id", F.transform(checked, lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64)


def clusters(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS, id_column: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of every vector, stored, and the final centroids."""
    d, given = dimensions, stored(integer_vectors(df, id_column, vector, dimensions, scale), "centroid-vectors")
    spark = given.sparkSession
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = given.where("vec_id IS NOT NULL").orderBy(key, "v").limit(k).collect()  # k vectors
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, d), np.int64)
    centroids = np.array([r["v"] for r in first], np.int64)
    simplex = Simplex(centroids, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apices = simplex.apices(_matrix(batch.column("v"), d))
            made = pa.FixedSizeListArray.from_arrays(pa.array(apices.ravel()), apices.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), made], ["vec_id", "v", "apex"])

    table = stored(given.mapInArrow(measure, "vec_id long, v array<bigint>, apex array<double>"), "centroid-apices")

    def nearest(batch: pa.RecordBatch, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = _matrix(batch.column("v"), d)
        apices = batch.column("apex").flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        return vectors, *assign(vectors, apices, centroids, simplex)

    for _ in range(rounds):

        def add_up(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                vectors, cluster, _ = nearest(batch, centroids)
                np.add.at(sums, cluster, vectors)
                counts += np.bincount(cluster, minlength=k)
            met = np.flatnonzero(counts)
            totals = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack([counts, sums])[met].ravel()), d + 1).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), totals], ["cluster", "totals"])

        parts = table.mapInArrow(add_up, "cluster long, totals array<bigint>").select("cluster", F.posexplode("totals").alias("at", "part"))
        totals = {(r["cluster"], r["at"]): int(r["total"]) for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total")).collect()}  # k * (d + 1) rows
        centroids = np.array([[totals[c, i + 1] // totals[c, 0] for i in range(d)] if (c, 0) in totals else centroids[c].tolist() for c in range(len(centroids))], np.int64)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = nearest(batch, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return stored(table.mapInArrow(settle, "vec_id long, cluster int, distance long"), "centroid-assigned"), centroids


def cluster_digest(df: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector."""
    assigned, centroids = clusters(df, **options)
    spark = assigned.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row for each centroid
    total = sum(sums.values())
    rows = [(c, s, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

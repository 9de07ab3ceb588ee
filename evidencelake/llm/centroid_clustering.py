"""Centroid clustering (operator 13) with a LAESA pivot table.

The distances of every vector to a few fixed pivots are computed once and written beside the vectors. In a round, the
centroids' distances to the same pivots give a lower bound of every distance between vector and centroid (the
largest difference over the pivots, by the triangle inequality). The centroid with the least bound is measured first; only
centroids whose bound does not exceed that distance survive, and those receive exact integer distances. Bounds are
floating point and widened by more than their error, so pruning never changes a result, ties included.

Each task adds its vectors up by cluster before anything is exchanged, so a round shuffles one row a task and cluster,
and the driver sees the k centroids and nothing else. The pivots are those of the first centroids that lie farthest
apart.

Edge cases: vectors of another length, with null or non-finite components, and null vectors are left out; so are
vectors with a component beyond LARGEST after scaling, whose squared distances do not fit 64 bits exactly. A null
vec_id is clustered but comes last as a first centroid. Rows that repeat a vec_id are vectors of their own; those that
tie as first centroids are ordered by their components. Fewer vectors than k give as many centroids. An inertia
beyond 64 bits is null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fixed_bytes

#: A scaled component may not exceed this, so that 2^11 squared differences of it fit 64 bits.
LARGEST = 1 << 25
MOST_DIMENSIONS, MOST_CENTROIDS = 2048, 4096
#: Vectors that a task handles at once.
BLOCK = 8192


def integer_vectors(vectors: DataFrame, dimensions: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as 64-bit integers, for the vectors that are kept."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == dimensions)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float(LARGEST)))
    return rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def farthest(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each as far as can be from those before it."""
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(points, pivots) Euclidean distances, correctly rounded up to one unit."""
    return np.sqrt(np.stack([((points - p) ** 2).sum(axis=1) for p in pivots], axis=1).astype(np.float64))


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, d) of rows(vec_id, v): components and distances to the pivots as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                points = part.column("v").flatten().to_numpy().reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([x.tobytes() for x in points], pa.binary()), pa.array([x.tobytes() for x in to_pivots(points, pivots)], pa.binary())], names=["vec_id", "v", "d"])

    return rows.mapInArrow(run, "vec_id long, v binary, d binary")


def nearest(points: np.ndarray, near: np.ndarray, centroids: np.ndarray, centroid_near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, its squared distance, exact distances taken); near: distances to the pivots."""
    bound = np.zeros((len(points), len(centroids)))
    for p in range(near.shape[1]):
        np.maximum(bound, np.abs(near[:, p, None] - centroid_near[None, :, p]), out=bound)
    first = bound.argmin(axis=1)
    best = ((points - centroids[first]) ** 2).sum(axis=1)
    slack = 1e-6 + 1e-12 * (near.max(axis=1) + centroid_near.max())
    row, centroid = np.nonzero(bound <= (np.sqrt(best.astype(np.float64)) + slack)[:, None])
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    for at in range(0, len(row), BLOCK):
        r, c = row[at : at + BLOCK], centroid[at : at + BLOCK]
        exact[r, c] = ((points[r] - centroids[c]) ** 2).sum(axis=1)
    number = exact.argmin(axis=1)  # the smaller number of a tie
    return number, exact[np.arange(len(points)), number], len(row) + len(points)


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int, n_pivots: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, fixed_bytes(part.column("v"), 8 * dimensions).view(np.int64), fixed_bytes(part.column("d"), 8 * n_pivots).view(np.float64)


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round over pivot_table() rows: floors of the means, empty ones as they were."""
    k, dimensions = centroids.shape
    centroid_near = to_pivots(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sums stay exact: components are split in two, each half far below 2^31
        sums, counts = np.zeros((k, dimensions, 2), np.int64), np.zeros(k, np.int64)
        for _, points, near in _blocks(batches, dimensions, len(pivots)):
            number = nearest(points, near, centroids, centroid_near)[0]
            counts += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            present, at = np.unique(number[order], return_index=True)
            for half, values in enumerate((points >> 16, points & 0xFFFF)):
                sums[present, :, half] += np.add.reduceat(values[order], at, axis=0)
        full = np.flatnonzero(counts)
        total = (sums[full, :, 0].astype(object) << 16) + sums[full, :, 1]
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(counts[full]), pa.array(total.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = table.mapInArrow(run, "cluster int, n long, total array<long>")
    each = parts.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.array(*(F.sum(F.col("total")[i].cast("decimal(20,0)")) for i in range(dimensions))).alias("total"))
    out = centroids.copy()
    for r in each.collect():  # k rows at most
        out[r["cluster"]] = [int(x) // int(r["n"]) for x in r["total"]]
    return out


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, n_exact): n_exact is the number of exact distances that a block took, on its first row."""
    centroid_near = to_pivots(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, points, near in _blocks(batches, centroids.shape[1], len(pivots)):
            number, distance, n_exact = nearest(points, near, centroids, centroid_near)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance), pa.array(np.r_[n_exact, np.zeros(max(len(part) - 1, 0), np.int64)][: len(part)])], names=["vec_id", "cluster", "distance", "n_exact"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long, n_exact long")


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt and vec_id, in that order."""
    by_hash = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return np.array([r["v"] for r in rows.orderBy(by_hash, "v").limit(k).collect()], np.int64)


def centroid_clustering(vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, n_pivots: int = 12, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    if dimensions > MOST_DIMENSIONS or k > MOST_CENTROIDS:
        raise ValueError(f"at most {MOST_DIMENSIONS} dimensions and {MOST_CENTROIDS} centroids")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    rows = integer_vectors(vectors, dimensions, scale, id_col, vector_col)
    centroids = first_centroids(rows, k, salt)
    if not len(centroids):
        none = [("vec_id", "long"), ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]
        return rows.where("false").select(*(F.lit(None).cast(t).alias(c) for c, t in none))
    pivots = farthest(centroids, n_pivots)
    table = scratch.table(pivot_table(rows, pivots), "pivots")
    for _ in range(rounds):
        centroids = moved(table, centroids, pivots)
    found = scratch.table(assigned(table, centroids, pivots), "assigned")
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}  # k rows at most
    small = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    side = spark.createDataFrame([(i, small(x), small(sum(sums.values())), sha[i]) for i, x in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.drop("n_exact").join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

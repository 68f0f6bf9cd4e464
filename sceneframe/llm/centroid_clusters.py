"""Centroid clustering of integer vectors over an incremental matrix of exact dot products.

Components become integers (``floor(64 * x)`` as a default), so dot products, sums and distances are exact and no order of
evaluation changes them. Each vector's row carries its dot products with all centroids. When centroids move, only the
components that changed enter: ``dot += x[changed] * change[changed]``; then the nearest centroid is picked anew from
``|x|^2 - 2 dot + |c|^2``. Every round writes these rows to the shared folder, so a lost executor repeats one round at most,
and deletes the rows of the round before. Each task adds up its vectors by cluster before anything is shuffled: one row for
each task, cluster and component moves, and the driver sees the centroids alone, so one cluster may hold all rows.

Defined results: a null vector, one of another length and one with a null or non-finite component is left out. A null id is
kept and comes last among the candidates for first centroids; candidates that tie are ordered by their vector. Rows that repeat
are clustered each by itself. Fewer vectors than clusters give fewer centroids, an empty table gives no row. Other columns of
the input are ignored, whatever their names. A component beyond +-2^26 after scaling is an error, as 64 bits would not
hold its distances.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.session import removed, written

CLUSTERS, ROUNDS, SCALE, LENGTH = 16, 3, 64, 64
LARGEST = 2**26
STATE = "vec_id bigint, x binary, dots binary, cluster int, distance bigint"


def finite_vectors(vectors: DataFrame, key: str, vector: str, length: int) -> DataFrame:
    """``vec_id, x`` (array of double) of the vectors that count."""
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    number = lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))  # noqa: E731  NaN counts as the largest
    return rows.filter((F.size("x") == length) & F.forall("x", number))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(x * float(scale))
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return scaled.astype(np.int64)


def move(dots: np.ndarray, x: np.ndarray, change: np.ndarray) -> None:
    """Add to ``dots`` (vectors x centroids) what the ``change`` (centroids x components) of the centroids makes of ``x``."""
    for k, row in enumerate(change):
        at = np.flatnonzero(row)
        if len(at):
            dots[:, k] += x[:, at] @ row[at]


def nearest(dots: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector; of equally near centroids the first."""
    distance = (x * x).sum(1)[:, None] - 2 * dots + (centroids * centroids).sum(1)
    cluster = distance.argmin(1) if len(x) else np.zeros(0, np.int64)
    return cluster.astype(np.int32), distance[np.arange(len(x)), cluster]


def _packed(matrix: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.dtype.itemsize * matrix.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(matrix), [None, pa.py_buffer(matrix.tobytes())]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.int64)


def _state(ids: pa.Array, x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> pa.RecordBatch:
    cluster, distance = nearest(dots, x, centroids)
    columns = [ids, _packed(x.astype("<i4")), _packed(dots.astype("<i8")), pa.array(cluster), pa.array(distance)]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "dots", "cluster", "distance"])


def started(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """The rows ``STATE`` of all vectors under the first centroids."""

    def start(batches):
        for b in batches:
            x = integers(np.asarray(b.column("x").flatten()).reshape(-1, centroids.shape[1]), scale)
            dots = np.zeros((len(x), len(centroids)), np.int64)
            move(dots, x, centroids)  # a move of all from zero
            yield _state(b.column("vec_id"), x, dots, centroids)

    return rows.select("vec_id", "x").mapInArrow(start, STATE)


def stepped(state: DataFrame, centroids: np.ndarray, change: np.ndarray) -> DataFrame:
    """The rows ``STATE`` after the centroids have moved by ``change`` to ``centroids``."""
    k, length = centroids.shape

    def step(batches):
        for b in batches:
            x, dots = _unpacked(b.column("x"), "<i4", length), _unpacked(b.column("dots"), "<i8", k)
            move(dots, x, change)
            yield _state(b.column("vec_id"), x, dots, centroids)

    return state.select("vec_id", "x", "dots").mapInArrow(step, STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise ``floor(sum / count)`` of each cluster; an empty one stays where it is."""
    k, length = centroids.shape

    def add(batches):
        sums = np.zeros((k, length + 1), np.int64)  # the last column counts
        for b in batches:
            x, cluster = _unpacked(b.column("x"), "<i4", length), np.asarray(b.column("cluster"))
            for c in np.unique(cluster):
                mine = x[cluster == c]
                sums[c] += np.append(mine.sum(0), len(mine))
        c, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[c, j])], ["c", "j", "v"])

    total = np.zeros((k, length + 1), np.int64)
    parts = state.select("x", "cluster").mapInArrow(add, "c int, j int, v bigint")
    for r in parts.groupBy("c", "j").agg(F.sum("v").alias("v")).collect():  # one row for each component of a centroid
        total[r.c, r.j] = r.v
    count = total[:, length:]
    return np.where(count > 0, total[:, :length] // np.maximum(count, 1), centroids)


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
             scale: int = SCALE, length: int = LENGTH, seed: str = "1") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector that counts.

    The first centroids are the ``k`` vectors with the least sha256 of ``<seed>:<id>``.
    """
    rows = finite_vectors(vectors, key, vector, length)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("x", drawn.alias("drawn")).orderBy(F.col("drawn").asc_nulls_last(), "x").limit(k).collect()
    centroids = integers(np.array([r.x for r in first], np.float64).reshape(-1, length), scale)
    state = written(started(rows, centroids, scale), "centroid-dots")
    for _ in range(rounds):
        new = means(state, centroids)
        change = new - centroids
        if not change.any():  # nothing would move in later rounds either
            break
        before, centroids = state, new
        state = written(stepped(before, centroids, change), "centroid-dots")
        removed(before)
    inertia = np.zeros(len(centroids), object)
    for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect():  # one row a centroid
        inertia[r.cluster] = r.d
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))

    return state.select("vec_id", "cluster", "distance", of_cluster(inertia.tolist(), "bigint").alias("cluster_inertia"),
                        F.lit(int(inertia.sum())).cast("bigint").alias("inertia"), of_cluster(shown, "string").alias("centroid_sha256"))

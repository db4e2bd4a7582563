"""Clusters around integer centroids, each vector assigned by Orchard's search.

Every centroid holds the list of all centroids sorted by their distance from it. A vector
starts at a centroid and walks that centroid's list; as soon as a closer centroid turns up,
the walk jumps to the start of the closer one's list. Centroids that were already measured
are marked and not measured again. The walk ends at a centroid that lies strictly beyond
twice the present distance: by the triangle inequality neither it nor any later one in the
list can be as close, so ties are still seen and the result is exact.

Vectors are whole numbers and all distances are squared, so nothing is rounded. The k
centroids and their lists are the only thing that travels to the tasks and back to the
driver; a round reads the vectors once and shuffles one partial sum per task, centroid and
component. The walks of a batch of vectors advance together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import staged

DIMENSIONS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Whole components beyond this saturate, so that squared distances of DIMENSIONS components fit 64 bits.
MOST = 1 << 27
#: Vectors whose walks advance together.
BATCH_ROWS = 8192


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, far): row c lists all centroids by distance from c, with those squared distances."""
    gaps = centroids[:, None, :] - centroids[None, :, :]
    far = np.einsum("ijk,ijk->ij", gaps, gaps)
    order = np.argsort(far, axis=1, kind="stable")
    return order, np.take_along_axis(far, order, axis=1)


def _square(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    gaps = vectors - centroids
    return np.einsum("ij,ij->i", gaps, gaps)


def orchard(
    vectors: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector, and how many distances were measured.

    The smaller number wins a tie.
    """
    order, far = lists or neighbour_lists(centroids)
    n, k = len(vectors), len(centroids)
    best, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    square = _square(vectors, centroids[best])
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    measured, walking = n, np.arange(n)
    while len(walking):
        at, step = best[walking], place[walking]
        # Strictly beyond twice the distance: four times the square.
        on = (step < k) & (far[at, np.minimum(step, k - 1)] <= 4 * square[walking])
        walking, at, step = walking[on], at[on], step[on]
        if not len(walking):
            break
        next_one = order[at, step]
        place[walking] += 1
        fresh = ~seen[walking, next_one]
        rows, candidate = walking[fresh], next_one[fresh]
        seen[rows, candidate] = True
        measured += len(rows)
        new = _square(vectors[rows], centroids[candidate])
        closer = (new < square[rows]) | ((new == square[rows]) & (candidate < best[rows]))
        jumped = rows[closer]
        best[jumped], square[jumped], place[jumped] = candidate[closer], new[closer], 0
    return best, square, measured


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of ``dimensions`` finite components, as floor(scale * x)."""
    def finite(x: Column) -> Column:
        value = x.cast("double")
        return x.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))

    def whole(x: Column) -> Column:
        scaled = F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST))))
        return scaled.cast("int")

    kept = embeddings.filter((F.size("embedding") == dimensions) & F.forall("embedding", finite))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``; null ids come last, and of
    equal ids the smaller vector first."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.withColumn("name", name).orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def _partial_sums(centroids: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimensions = centroids.shape
        lists, sums, counts = neighbour_lists(centroids), np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for piece in _pieces(batches):
            vectors = _matrix(piece.column("v"), dimensions)
            cluster, _, _ = orchard(vectors, centroids, lists)
            counts += np.bincount(cluster, minlength=k)
            by_cluster = np.argsort(cluster, kind="stable")
            held, starts = np.unique(cluster[by_cluster], return_index=True)
            sums[held] += np.add.reduceat(vectors[by_cluster], starts, axis=0)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(held, pa.int32()), "n": pa.array(counts[held], pa.int64()),
            "sums": pa.array(sums[held].tolist(), pa.list_(pa.int64())),
        })
    return run


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of every centroid's vectors; one without vectors stays."""
    partial = vectors.select("v").mapInArrow(_partial_sums(centroids), "cluster int, n bigint, sums array<bigint>")
    spread = partial.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    total = spread.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    moved = centroids.copy()
    for r in total.collect():  # at most one row per centroid and component
        moved[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return moved


def _assignment(centroids: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = neighbour_lists(centroids)
        for piece in _pieces(batches):
            cluster, square, _ = orchard(_matrix(piece.column("v"), centroids.shape[1]), centroids, lists)
            yield pa.RecordBatch.from_pydict({
                "vec_id": piece.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(square, pa.int64()),
            })
    return run


def centroid_clusters(
    embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 1,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) per
    kept vector of ``embeddings`` (vec_id, embedding).

    Vectors that are null, of another length, or hold a null or a value that is not finite
    are left out. Whole components saturate at ``MOST``. With fewer than ``k`` kept vectors
    each is a centroid at the start; with none, as for an empty table, there is no row. Rows
    with equal or null ids, and repeated rows, are vectors of their own. An inertia beyond 64
    bits is null. Other columns are left out.
    """
    vectors = staged(whole_vectors(embeddings, dimensions, scale), "whole-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    assigned = staged(vectors.mapInArrow(_assignment(centroids), "vec_id bigint, cluster int, distance bigint"), "clusters")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    per_cluster = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(wide.alias("total")).collect()}

    def long_or_null(value: int) -> int | None:
        return value if value < 1 << 63 else None

    about = [
        (c, long_or_null(per_cluster.get(c, 0)), long_or_null(sum(per_cluster.values())),
         sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist())
        for c in range(len(centroids))
    ]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
    described = embeddings.sparkSession.createDataFrame(about, schema)  # k rows
    return assigned.join(F.broadcast(described), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )

"""Orchard search and integer centroids against brute force."""

import math
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import orchard
from feedloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def nearest(vectors, centroids):
    gaps = vectors[:, None, :] - centroids[None]
    square = (gaps * gaps).sum(axis=2)
    return square.argmin(axis=1), square.min(axis=1)


def brute_force(rows, k=16, rounds=3, dimensions=64):
    rows = [
        (vec_id, [math.floor(64.0 * x) for x in v]) for vec_id, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = sorted(rows, key=lambda r: sha256(f"1:{r[0]}".encode()).hexdigest())[:k]
    centroids, vectors = [r[1] for r in first], np.array([r[1] for r in rows], np.int64)
    for _ in range(rounds):
        cluster, _ = nearest(vectors, np.array(centroids))
        for c in range(len(centroids)):
            mine = vectors[cluster == c]
            if len(mine):
                centroids[c] = [int(x) // len(mine) for x in mine.sum(axis=0)]
    cluster, square = nearest(vectors, np.array(centroids))
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        (r[0], int(c), int(s), int(square[cluster == c].sum()), int(square.sum()), names[c])
        for r, c, s in zip(rows, cluster, square, strict=True)
    )


def test_whole_table(spark):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = QUERIES["op11_orchard_clusters"](spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == brute_force(given)


@pytest.mark.parametrize("dimensions", [1, 2, 8])
def test_search_is_exact_and_saves_distances(dimensions):
    rng = np.random.default_rng(dimensions)
    # Few values, so that there are many ties and equal centroids.
    vectors, centroids = rng.integers(-9, 9, (4000, dimensions)), rng.integers(-9, 9, (40, dimensions))
    cluster, square, measured = orchard.orchard(vectors, centroids)
    wanted, least = nearest(vectors, centroids)
    assert (cluster == wanted).all() and (square == least).all()
    assert measured < 4000 * 40
    if dimensions == 1:
        assert measured < 4000 * 20


def test_lists_are_sorted():
    centroids = np.array([[0], [10], [3]])
    order, far = orchard.neighbour_lists(centroids)
    assert order.tolist() == [[0, 2, 1], [1, 2, 0], [2, 0, 1]]
    assert far.tolist() == [[0, 9, 100], [0, 49, 100], [0, 9, 49]]


ODD = [
    (1, [0.5, -0.5]), (2, [0.25, None]), (3, None), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, []),
    (1, [0.5, -0.5]), (None, [0.0, 0.001]), (8, [1.0, 1.0]), (8, [-1.0, 2.0]), (9, [0.5, -0.49]), (10, [1.0, 2.0, 3.0]),
]


def odd(spark):
    rows = spark.createDataFrame(ODD, "vec_id bigint, embedding array<double>")
    return rows.select("*", *[F.lit("x").alias(c) for c in ("cluster", "v", "n", "name", "distance", "inertia", "label")])


def test_odd_vectors(spark):
    for k in (2, 4, 16):
        out = orchard.centroid_clusters(odd(spark), k=k, dimensions=2).drop("centroid").collect()
        assert len(out) == 6 and {r.inertia for r in out} == {sum(r.distance for r in out)}
    # More centroids than vectors: each vector lies on one, the smaller number of two equal ones.
    assert {r.distance for r in out} == {0} and len({r.cluster for r in out}) == 4


def test_null_ids_seed_last(spark):
    vectors = orchard.whole_vectors(odd(spark), 2)
    names = sorted((sha256(f"1:{i}".encode()).hexdigest(), i) for i in (1, 1, 8, 8, 9))
    whole = {1: [[32, -32]], 8: [[-64, 128], [64, 64]], 9: [[32, -32]], None: [[0, 0]]}
    wanted = []
    for _, i in names:
        wanted.append(whole[i][0] if i != 8 else whole[8].pop(0))
    assert orchard.first_centroids(vectors, 16).tolist() == [*wanted, [0, 0]]


def test_no_vectors(spark):
    assert orchard.centroid_clusters(odd(spark).limit(0)).count() == 0
    assert orchard.centroid_clusters(odd(spark), dimensions=9).count() == 0


def test_large_values_saturate(spark):
    rows = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    out = {r.vec_id: r for r in orchard.centroid_clusters(rows, k=1, rounds=0, dimensions=2).collect()}
    assert sorted(r.distance for r in out.values()) == [0, 2 * orchard.MOST**2]

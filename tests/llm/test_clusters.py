"""Centroid clustering against comparing every vector with every centroid."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from hazelake.llm import clusters


def brute(points, centres):
    d = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(points)), best]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.integers(1, 5), st.sampled_from([2, 4, 30, clusters.MOST]))
def test_search_finds_the_nearest_and_of_ties_the_smallest_number(seed, k, dims, most):
    rng = np.random.default_rng(seed)
    centres, points = rng.integers(-most, most + 1, (k, dims)), rng.integers(-most, most + 1, (60, dims))
    best, far = clusters.Search(centres).nearest(points)
    want, distance = brute(points, centres)
    assert (best == want).all() and (far == distance).all()


def test_search_looks_at_few_centres():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1000, (200, 2))
    points = rng.integers(0, 1000, (500, 2))
    search = clusters.Search(centres)
    search.nearest(points)
    assert search.looked_at < 500 * 200 / 3


def expected(rows, k, rounds, size):
    """{id: (cluster, distance, cluster_inertia, inertia, centroid)} by plain Python."""
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == size and None not in v and np.isfinite(v).all()]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), p) for i, p in kept)
    centres = [p for _, p in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(centres)) for _, p in kept]

    for _ in range(rounds):
        at = assign()
        for n in range(len(centres)):
            own = [p for (_, p), (_, c) in zip(kept, at) if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    total = {n: sum(d for d, c in at if c == n) for n in range(len(centres))}
    return sorted((i is not None, i, c, d, total[c], sum(total.values()), tuple(centres[c])) for (i, _), (d, c) in zip(kept, at))


def test_clusters_are_exact(spark):
    rng = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(90)]
    vectors += [(100 + i, [0.5, -0.25, 0.0, 1.0]) for i in range(60)]  # a third are one vector
    vectors += [(7, vectors[7][1]), (7, vectors[3][1]), (200, None), (201, []), (202, [1.0, 2.0, 3.0]), (203, [1.0, None, 2.0, 3.0])]
    vectors += [(204, [1.0, float("nan"), 0.0, 0.0]), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [-1e-30, 0.0, -0.0, 1e-30]), (None, [0.1, 0.2, 0.3, 0.4])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, id string, cluster int").repartition(5)
    rows = clusters.clustered(table, k=6, rounds=3, size=4).collect()
    found = sorted((r["vec_id"] is not None, r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in rows)
    assert found == expected([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors], 6, 3, 4)


def test_vectors_out_of_range_are_returned_unclustered(spark):
    rows = [(1, [0.0, 1.0]), (2, [1e30, 0.0]), (3, [0.0, 0.5])]
    found = {r["vec_id"]: r for r in clusters.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=2).collect()}
    assert found[2]["cluster"] is None and found[2]["inertia"] is None
    assert found[1]["distance"] == found[3]["distance"] == 0  # two centroids only


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1e30, 1.0])]])
def test_nothing_to_cluster(spark, rows):
    found = clusters.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=2).collect()
    assert [r["cluster"] for r in found] == [None] * sum(v is not None for _, v in rows)

"""Threshold algorithm against all exact distances, and clusters against plain loops."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylens.llm import centroids


def brute(x, c):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
    return [(r.index(min(r)), min(r)) for r in d]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 9), st.integers(0, 12), st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 1000, 1 << 27]))
def test_threshold_algorithm_finds_the_nearest(dim, k, rows, seed, spread):
    random = np.random.default_rng(seed)
    c, x = random.integers(-spread, spread + 1, (k, dim)), random.integers(-spread, spread + 1, (rows, dim))
    number, distance, exact = centroids.SortedLists(c).nearest(x)
    assert list(zip(number.tolist(), distance.tolist(), strict=True)) == brute(x, c) and exact <= rows * k


def test_it_stops_before_it_has_seen_all():
    c = np.array([[n * 100, n * 100] for n in range(50)])
    number, _, exact = centroids.SortedLists(c).nearest(c + 3)
    assert number.tolist() == list(range(50)) and exact < 4 * 50


def lloyd(rows, k, rounds):
    """Clusters 0, 1, ... from the k smallest ids, moved ``rounds`` times."""
    start = sorted((i, v) for i, v in rows if i is not None)[:k]
    c = [list(v) for _, v in start]
    for n in range(rounds + 1):
        near = brute([v for _, v in rows], c)
        if n < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (m, _) in zip(rows, near, strict=True) if m == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return c, near


def test_clusters_match_plain_loops(spark):
    random = np.random.default_rng(4)
    v = np.concatenate([random.normal(m, 0.02, (40, 4)) for m in (-0.5, 0.1, 0.7)]).astype(np.float32)
    odd = [(None, v[0].tolist()), (7, v[7].tolist()), (200, [0.1, 0.2, 0.3]), (201, [0.1, None, 0.2, 0.3]), (202, [0.1, float("nan"), 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, None)]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + odd
    df = spark.createDataFrame([(i, x, 0, 0) for i, x in rows], "vec_id long, embedding array<float>, cluster int, x int").repartition(3)
    found = centroids.cluster(df, 6, 3, 4, F.col("vec_id"))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    used = [(i, [int(np.floor(256 * float(c))) for c in x]) for i, x in rows[:122]]
    c, near = lloyd(used, 6, 3)
    got = sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect())
    assert got == sorted((str(i), m, d) for (i, _), (m, d) in zip(used, near, strict=True))
    import hashlib

    hashes = {r["cluster"]: r["centroid_sha256"] for r in found.collect()}
    assert hashes == {m: hashlib.sha256(",".join(map(str, c[m])).encode()).hexdigest() for m in {m for m, _ in near}}
    sums = {m: sum(d for n, d in near if n == m) for m, _ in near}
    assert all(r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values()) for r in found.collect())


@pytest.mark.parametrize("rows", [[], [(None, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0])], [(1, [1e300, -1e300])]])
def test_few_and_extreme_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = centroids.cluster(df, 40, 5, 2, F.col("vec_id")).collect()
    assert len(found) == len(rows) and all(r["cluster"] == 0 and r["distance"] == 0 for r in found)

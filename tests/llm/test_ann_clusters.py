"""Nearest neighbours where a third of the rows are nearly equal vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import ann


@pytest.mark.parametrize("spread", [0.001, 0.00001])
def test_recall_in_a_hot_cluster_of_many_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 256)
    rng = np.random.default_rng(8)
    n, dim = 12_000, 64
    m = rng.normal(size=(n, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hot = rng.permutation(n)[: n // 3]
    m[hot] = m[hot[0]] + spread * rng.normal(size=(len(hot), dim))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    recall = {True: [], False: []}
    for q in range(0, n, 50):
        s = m @ m[q]
        s[q] = -9
        recall[q in set(hot.tolist())].append(len(set(np.argpartition(-s, 5)[:5].tolist()) & got[q]) / 5)
    assert np.mean(recall[True]) >= 0.9 and np.mean(recall[False]) >= 0.9, (np.mean(recall[True]), np.mean(recall[False]))


def test_lengths_do_not_matter(spark):
    """Vectors whose squares vanish or overflow have the cosines of their directions."""
    rows = [(0, [1e-200, 1e-200]), (1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [5e-324, 0.0]), (4, [1.7e308, -1.7e308]), (50, [1.0, 0.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()}
    half = 0.5**0.5
    want = {(0, 1): 1, (0, 2): 1, (0, 3): half, (0, 4): 0, (0, 50): half, (50, 0): half, (50, 1): half, (50, 2): half, (50, 3): 1, (50, 4): half}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from extentlake.llm import topk
from extentlake.llm.topk import products, select, top_k

SCHEMA = "vec_id long, embedding array<double>, rank int"


def brute(rows, k=5):
    v = {(i, tuple(math.floor(256 * x) for x in e)) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in {i for i, _ in v if i % 50 == 0}:
        best = sorted({(-sum(a * b for a, b in zip(x, y)), c) for i, x in v if i == q for c, y in v if c != q and len(x) == len(y)})[:k]
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return out


def run(spark, rows):
    return {tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()}


def test_nulls_ties_repeats_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "BLOCK", 2)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8], 1) for i in range(200)]
    rows += rows[:3] + [rows[7]] * 40
    rows += [(300, None, 1), (None, [0.5] * 6, 1), (301, [0.5, None, 0.5, 0.5, 0.5, 0.5], 1), (302, [math.inf] * 6, 1), (303, [math.nan] * 6, 1), (304, [9.0] * 5, 1), (350, [1.0, 2.0], 1), (351, [3.0, -1.0], 1), (400, [], 1)]
    assert run(spark, rows) == brute(rows)


def test_huge_components_stay_exact():
    a, b = np.array([[2**40, 3]], "i8"), np.array([[2**21, 5], [-(2**21), 1]], "i8")
    assert products(a, b).tolist() == [[2**61 + 15, -(2**61) + 3]]
    assert products(np.array([[1e30]]), np.array([[1e30], [-1e30]])).tolist() == [[2**63 - 1, -(2**63) + 1]]


@pytest.mark.parametrize("big", [1, 2**58])
def test_ties_go_to_the_smaller_id(big):
    s = np.array([[1, 3, 3, 2, 3]]) * big
    ids = np.array([1, 4, 6, 7, 9])
    assert sorted(ids[select(s, ids, 2)[0]]) == [4, 6]


def test_fewer_candidates_and_none(spark):
    assert run(spark, [(0, [1.0], 1), (1, [2.0], 1)]) == {(0, 1, 1, 256 * 512)}
    assert run(spark, [(0, [1.0], 1)]) == set() and run(spark, []) == set()

"""Nearest neighbours by tiles against brute force in double precision: recall is one, order and ties included."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundscope.llm import vector_tiles as vt


def brute(rows, queries, k):
    """Counts of (query_id, rank, vec_id, score) by the rules stated in the module's docstring."""
    def good(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    base = {(i, tuple(v)) for i, v in rows if good(v)}
    out = Counter()
    for qi, q in {(i, tuple(v)) for i, v in queries if good(v) and i is not None}:
        found = []
        for i, v in base:
            if len(v) != len(q) or (i == qi and v == q):
                continue
            score = 0.0
            for a, b in zip(q, v):
                score += (a - b) * (a - b)
            found.append((math.sqrt(score), i is None, i or 0, i))
        out.update((qi, r + 1, f[3], f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k]))
    return out


def check(spark, rows, queries, k, element="float", parts=3):
    if element == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
        queries = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in queries]
    kind = f"id long, vector array<{element}>"
    base, asked = (spark.createDataFrame(x, kind).withColumn("ref", F.lit("x")).repartition(parts).select("id", "vector") for x in (rows, queries))
    assert Counter(tuple(r) for r in vt.search(asked, base, k).collect()) == brute(rows, queries, k)


@pytest.mark.parametrize("element", ["float", "double"])
def test_random_clustered_and_copied(spark, monkeypatch, element):
    monkeypatch.setattr(vt, "BLOCK", 64)
    monkeypatch.setattr(vt, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12))
    rows = [(i, (centres[i % 5] + rng.normal(size=12) * 10.0 ** rng.integers(-4, 1)).tolist()) for i in range(600)]
    rows += [(1000 + i, [1.0] * 12) for i in range(150)] + [(2000 + i, [1.0] * 11 + [1.0 + i * 1e-6]) for i in range(60)]
    queries = [r for r in rows if r[0] % 10 == 0]
    check(spark, rows, queries, 10, element)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dim in (1, 3, 2500):
        x = (rng.normal(size=(40, dim)) * 10.0 ** rng.integers(-6, 6, size=(40, 1))).astype("<f4")
        b = vt.Block(vt._pack(np.arange(40), np.arange(40), x, 0), "<f4")
        low, high = vt.bounds(b, b)
        true = np.array([vt.distances(np.repeat(x[i : i + 1], 40, 0), x) for i in range(40)])
        assert (low <= true).all() and (true <= high).all()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (0, [0.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.5]), (None, [1.0, 0.5]), (9, [-0.0, 2.0]), (10, [1.0, 1.0]), (200, [5.0, 5.0, 5.0])]
    check(spark, rows, rows, 10)
    check(spark, rows, [(77, [0.5, 0.5]), (None, [0.5, 0.5]), (78, None)], 2)
    none = spark.createDataFrame([], "id long, vector array<float>")
    assert vt.search(none, none, 10).count() == 0
    assert vt.search(spark.createDataFrame([(1, [1.0])], "id long, vector array<float>"), none, 10).count() == 0


def test_grid():
    for q, c, tasks in ((1, 7, 24), (542 * 18, 244_000, 32_000), (3, 1, 8), (1000, 1000, 16)):
        down, across = vt._grid(q, c, tasks)
        assert 1 <= down <= q and 1 <= across <= c

"""Repeated query rows of the kNN join."""

import random

import numpy as np
import pytest

from kindred.llm import knn_join


@pytest.mark.parametrize("per", [30, 2048])
def test_repeated_queries(spark, monkeypatch, per):
    """Ids 0 and 20 have many rows: each asks once (with its smallest vector) and finds k others."""
    monkeypatch.setattr(knn_join, "ROWS_PER_PIVOT", per)
    rng = random.Random(6)
    vec = lambda: [rng.randint(-20, 20) for _ in range(6)]
    rows = [(i, vec()) for i in range(300)]
    twin = dict(rows)
    rows += [(0, twin[0])] * 40 + [(20, vec()) for _ in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    got = {}
    for r in knn_join.top_k(df, 20, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 300, 20):
        v = min(x for i, x in rows if i == q)
        best = sorted((-int(np.dot(v, x)), i) for i, x in rows if i != q)[:20]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]

"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaqc.llm import exact_search
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, label int, id string, vec double, rank int, query long, score int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", 0.0, 2, 3, 4) for i, v in rows], SCHEMA)


def found(df, k=5, step=50):
    return sorted(tuple(r) for r in exact_search.top_k(df, F.col("id") % step == 0, k).select("query_id", "rank", "id", "score").collect())


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=7).tolist()) for k in range(230)]
    rows += [(k, rows[10][1]) for k in range(300, 420)]  # a third are copies
    rows += [rows[3], (50, rows[4][1]), (None, rows[0][1]), (500, None), (501, [1.0, None] + [0.0] * 5), (502, [float("nan")] + [0.0] * 6), (503, [float("inf")] * 7)]
    rows += [(600, [0.0] * 7), (601, [-0.0] * 7), (602, [-1e-20] * 7), (650, [1.0, 2.0]), (651, [3.0]), (652, []), (700, []), (750, [1e300] * 7), (751, [-1e12] * 7), (752, [9e7] * 7)]
    want = brute.best_products(rows, 5, 50)
    assert len(want) > 40 and max(r[3] for r in want) == (1 << 63) - 1 and any(r[0] == 700 for r in want)
    assert found(table(spark, rows)) == want
    assert found(table(spark, [])) == [] and found(table(spark, rows[1:40])) == []
    assert found(table(spark, rows[:3])) == brute.best_products(rows[:3], 5, 50)


def test_blocks_and_bounds(spark, monkeypatch):
    """Small blocks; vectors with smooth components, where coarse segments prune most pairs."""
    for name, n in (("ROWS", 100), ("LEAST_ROWS", 20), ("QUERIES", 9)):
        monkeypatch.setattr(exact_search, name, n)
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(size=(40, 4)), 16, axis=1)
    rows = [(k, (centres[k % 40] + rng.normal(size=64) / 10).tolist()) for k in range(1200)]
    df = table(spark, rows)
    assert found(df, 20, 10) == brute.best_products(rows, 20, 10)
    work = exact_search.top_k(df, F.col("id") % 10 == 0, 20, with_work=True).first()
    assert work.left < 0.2 * work.tried


@pytest.mark.parametrize("length", [1, 2, 3, 16, 64])
def test_bound_is_a_bound(length):
    rng = np.random.default_rng(length)
    q, v = (np.floor(256 * rng.normal(size=(50, 64))) for _ in range(2))
    bound = exact_search.segments(q, length) @ exact_search.segments(v, length).T
    assert (bound >= q @ v.T - 1e-6).all() and (length > 1 or np.allclose(bound, q @ v.T))


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in exact_search.query(spark, d).select("query_id", "rank", "vec_id", "score").collect())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert got == brute.best_products(rows, 5, 50) and math.isfinite(got[0][3])

"""Importance resampling against a plain version."""

import numpy as np
import pytest

from mediaqc.llm import resampling
from tests.llm import brute


def found(df, target):
    return sorted((tuple(r) for r in resampling.resample(df, target).select("id", "n_features", "weight", "score", "rank").collect()), key=str)


def targets(spark, texts):
    return spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "item_id long, text string, id string, n_words int")


@pytest.mark.parametrize("texts", [["alpha1 beta2 Gamma3 déjà4", None, "", "a b\tc D'e 日本5"], []])
def test_awkward_rows(spark, messy, rows, texts):
    assert found(messy, targets(spark, texts)) == brute.resampled(rows, texts)


def test_nothing(spark, messy):
    assert found(messy.limit(0), targets(spark, ["x"])) == []
    rows = [(None, None), (None, "one"), (3, "!!"), (3, "A-b c")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), targets(spark, ["b c"])) == brute.resampled(rows, ["b c"])


def test_ties_and_copies(spark):
    """Copies of one row make a third of all, all of one score."""
    rows = [(k, " ".join(f"w{(k * j) % 97}" for j in range(15 + k % 20))) for k in range(400)] + [(7, "same words " * 15)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = found(df, targets(spark, ["w1 w2 w3", "same"]))
    assert got == brute.resampled(rows, ["w1 w2 w3", "same"])
    n = sum(len(t.split()) >= 20 for _, t in rows)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 25 * n // 100 + 1))


def test_features_of_portions():
    """Many texts at once, split anywhere, give what each gives alone."""
    texts = ["", "a", "a b a b", "B c", "", "é é é", "x" * 1000]
    whole, counts = resampling.features(texts)
    alone = [resampling.features([t]) for t in texts]
    assert np.array_equal(whole, np.concatenate([a for a, _ in alone])) and counts.tolist() == [c[0] for _, c in alone]
    assert resampling.features([])[0].size == 0 and resampling.features(["", " . "])[0].size == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    out = resampling.query(spark, d)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute.resampled(rows, target)

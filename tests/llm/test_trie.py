"""The prefix trie against a plain one."""

import random

import pytest

from mediaqc.llm import prefix_trie
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, c int, pos string, node long, depth long, level int, words binary, k0 long"


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "clash", 2, 3, 4, b"w", 5) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=lambda r: r[:2])


def conversations(seed, n):
    rnd = random.Random(seed)
    said = ["hello there", "yes", "no\tno", "", None, "a b  c", "long " * 500]
    rows = []
    for c in [*range(n), *range(-25, -15), 10**12 + 3]:
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rnd.choice(["user", "user", None]), rnd.choice(said[:2]) if turn < 4 else rnd.choice(said)))
    return rows


def test_awkward_rows(spark):
    rows = conversations(1, 70)
    rows += [(None, 0, "user", "lost"), (5, None, "user", "first of all"), (5, None, None, None), (6, 0, "user", "yes"), rows[0], rows[0], rows[3]]
    assert found(spark, rows) == brute.trie(rows)
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []
    assert found(spark, [(41, 0, None, None)]) == brute.trie([(41, 0, None, None)])


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_long_conversations_in_chunks(spark, monkeypatch, chunk):
    """A conversation with a third of all turns, one of copies of a row, and long common beginnings."""
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = conversations(2, 25)
    rows += [(100, k, "user", "same") for k in range(60)] + [(120, k, "user", "same" if k < 50 else f"w{k} x") for k in range(70)] + [(140, 7, "user", "same")] * 40
    assert found(spark, rows, 5) == brute.trie(rows)


def test_levels_grow_with_the_logarithm(spark):
    """Forks at every turn of a long conversation: its path is one array, the forks hang on it."""
    rows = [(k * 20, t, "user", f"t{t}" if t < k else f"own {k} {t}") for k in range(1, 20) for t in range(k + 2)]
    got = found(spark, rows)
    assert got == brute.trie(rows) and max(r[1] for r in got) == 21


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = prefix_trie.query(spark, d)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == brute.trie(rows)

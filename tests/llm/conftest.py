import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size long, kept boolean, digest binary, n int, root long, node long, bucket int, target double, h long"


def messy_rows(seed=1, n=60):
    """Copies, near copies, repeated rows, nulls in each column, empty and long texts; columns whose names operators use too."""
    rnd = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "déjà", "日本", "x1", "42", "+1", "a@b.co", "10.0.0.1", "|", "!!"]
    texts = [" ".join(rnd.choice(words) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(1, 90))) for _ in range(n)]
    texts += texts[:8] + [t + " tail" for t in texts[:8]] + [t.replace(" ", "  ") for t in texts[8:14]] + [t.upper() for t in texts[14:18]]
    texts += [None, "", " \t\n", "one", "long " * 30000, "a b c d e f " * 4000, "\x0b\x0c", "é" * 5000, texts[0]]
    rows = [(k, t, "en" if k % 3 else None, None if k % 7 == 0 else f"s{k % 4}" if k % 2 else "s0", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[5], (None, texts[1], None, None, None), (None, None, None, None, None)]
    return [(*r, "clash", 1, False, b"d", 2, 3, 4, 5, 6.0, 7) for r in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in messy_rows()]

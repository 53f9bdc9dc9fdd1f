"""Operators that judge each row alone: personal data, byte-level BPE, quality."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from mediaqc.llm import bpe, pii, quality
from tests.llm import brute


def test_pii_equals_brute_force(messy, rows):
    got = Counter((r.id, r.s) for r in pii.find_spans(messy).select("id", pii.spelled(F.filter("spans", lambda x: x["kind"] < 4)).alias("s")).collect())
    assert got == Counter((i, brute.base_spans(t)) for i, t in rows)
    assert pii.find_spans(messy.limit(0)).collect() == []


@pytest.mark.parametrize("table", ["messy", "documents"])
def test_pii_report_equals_brute_force(spark, messy, table):
    """All columns of the query, on awkward rows and on a whole table."""
    docs = messy if table == "messy" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = pii.report(docs)
    assert out.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = Counter((r.doc_id, *brute.base_counts(r.text), brute.sha(brute.base_spans(r.text))) for r in docs.select("doc_id", "text").collect())
    got = out.collect()
    assert Counter(tuple(r)[:6] for r in got) == want and any(n for _, *ns, _ in want for n in ns)
    for r in got:
        names = Counter(x.split(":")[0] for x in r.spans.split(",") if x)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_iban, r.n_ssn] == [names[k] for k in ("email", "ip", "card", "phone", "iban", "ssn")]
        assert len(r.scores) == sum(names.values())


def test_pii_kinds_and_context(spark):
    texts = [
        "card 4111 1111 1111 1111 not 4111 1111 1111 1112", "999.1.1.1 1.2.3.4.5.6.7.8 007.0.00.255", "+1 (555) 010-9999, +12 34", "a.b@c.d_e@f.gh x@y",
        "IBAN GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32", "ssn 123-45-6789", "123-45-6789", "🎉 a@b.cd", "a." * 20000 + "@b", "1 " * 400,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.s for r in pii.find_spans(df).select("id", pii.spelled(F.col("spans")).alias("s")).collect()}
    for k, t in enumerate(texts):
        assert ",".join(x for x in got[k].split(",") if not x.startswith(("iban", "ssn"))) == brute.base_spans(t)
    assert "iban:5:32" in got[4] and got[4].count("iban") == 1 and got[5] == "ssn:4:15" and got[6] == "" and got[7] == "email:2:8"


def test_pii_lists_and_accounts_before_other_words(spark):
    texts = [
        "SSN: 123-45-6789, 234-56-7890, 345-67-8901", "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "GB82WEST12345698765432 DE89370400440532013000",
        "DE89 3704 0044 0532 0130 01 BIC COBADEFFXXX", "x" * 70 + " 123-45-6789 " + "y" * 40, "123-45-6789 234-56-7890 taxpayer", "ssn " + "z" * 60 + " 123-45-6789",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.s for r in pii.find_spans(df).select("id", pii.spelled(F.col("spans")).alias("s")).collect()}
    own = {k: [x for x in v.split(",") if x.startswith(("ssn", "iban"))] for k, v in got.items()}
    assert own[0] == ["ssn:5:16", "ssn:18:29", "ssn:31:42"] and own[1] == ["iban:0:27"] and own[2] == ["iban:0:22", "iban:23:45"]
    assert own[3] == own[4] == own[6] == [] and own[5] == ["ssn:0:11", "ssn:12:23"]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_prefix_sums(spark, n):
    r = spark.range(1).select(pii.prefix_sums(F.expr(f"transform(slice(sequence(1, {n} + 1), 1, {n}), x -> x % 7)").cast("array<int>")).alias("x")).first()
    assert r.x == np.cumsum([k % 7 for k in range(1, n + 1)]).tolist()


@pytest.fixture(scope="module")
def codec():
    path, pattern = bpe.vocabulary()
    v = bpe._Vocabulary(path)
    return v, bpe.Codec(v.tokens, v.table, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(v.tokens)}, special_tokens={})


def test_perfect_hash_is_minimal_and_perfect(codec):
    v, _, _ = codec
    assert sorted(v.table.ids.tolist()) == list(range(len(v.tokens)))
    assert all(v.table.find(t, v.tokens) == i for i, t in enumerate(v.tokens))
    assert v.table.find(b"no such token at all", v.tokens) == -1 and bpe.PerfectHash([]).find(b"x", []) == -1


def test_bpe_equals_tiktoken_and_round_trips(codec, messy, rows):
    _, c, enc = codec
    for t in ["", "a" * 999, " " * 70, "<|endoftext|>", "don't\r\n\tx", "日本語🎉é́  ", "12345678901234567890", *(t or "" for _, t in rows)]:
        ids = c.encode(t)
        assert ids == enc.encode_ordinary(t) and c.decode(ids) == t.encode()
    path, pattern = bpe.vocabulary()
    want = Counter()
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), brute.sha(",".join(map(str, ids))), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(messy, path, pattern).collect()) == want
    assert bpe.encode(messy.limit(0), path, pattern).collect() == []


def test_bpe_keeps_what_is_asked_for_again(codec, monkeypatch):
    """Words that come again and again are merged once, however many others come between."""
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    v, _, enc = codec
    made = Counter()

    class Counting(bpe.Codec):
        def word(self, word):
            made[word] += 1
            return super().word(word)

    c = Counting(v.tokens, v.table, bpe.vocabulary()[1])
    common = [f" qzx{chr(97 + k // 26)}{chr(97 + k % 26)}vw" for k in range(40)]
    for k in range(30):
        text = "".join(common + [f" wq{chr(97 + k)}{chr(97 + j)}kj" for j in range(26)])
        assert c.encode(text) == enc.encode_ordinary(text)
    assert [made[w] for w in common] == [1] * 40 and len(c.ids_of) + len(c.ids_of.old) <= 200


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    grades = quality.grades(spark.read.parquet(f"{d}/labels.parquet"))
    model = quality.train(docs, grades.where("doc_id % 4 <> 0"))
    assert model.thresholds[0] < model.thresholds[1]
    got = quality.score(docs, model).join(grades.where("doc_id % 4 = 0"), F.col("id") == F.col("doc_id"))
    kept = {r.grade: r.k for r in got.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[2] > 0.98 and kept[0] < 0.05 and kept[1] < kept[2]
    order = [r.e for r in got.groupBy("grade").agg(F.avg("expected_grade").alias("e")).orderBy("grade").collect()]
    assert order == sorted(order)


def test_quality_finds_toxic_texts(spark):
    """At the production threshold, with all ratings and with a sample that a uniform draw would leave without enough toxic ones."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    grades = quality.grades(spark.read.parquet(f"{d}/labels.parquet"))
    for most, least in ((quality.MOST_RATED, 0.4), (500, 0.3)):
        model = quality.train(docs, grades.where("doc_id % 4 <> 0"), most=most)
        got = quality.score(docs, model).join(grades.where("doc_id % 4 = 0"), F.col("id") == F.col("doc_id"))
        dropped = {r.grade: r.k for r in got.groupBy("grade").agg(F.avg((F.col("tail") < 0.4).cast("int")).alias("k")).collect()}
        assert dropped[1] > least and dropped[2] < 0.02 and dropped[0] > 0.95


def test_quality_sample_is_filled_by_grade(spark):
    rated = spark.range(1000).select("id", F.when(F.col("id") % 50 == 0, 1).otherwise(F.col("id") % 2 * 2).cast("int").alias("grade"))
    n = {r.grade: r["count"] for r in quality.sample(rated, 3, 100, 15).groupBy("grade").count().collect()}
    assert n[1] >= 15 and n[0] + n[2] <= 100 and {r.id for r in rated.orderBy(F.xxhash64("id"), "id").limit(100).collect()} <= {r.id for r in quality.sample(rated, 3, 100, 15).collect()}


def test_quality_keeps_rare_features_of_a_middle_grade():
    """A word that only three toxic texts have gets a weight, and weighting back leaves the shares as they are."""
    rest = [(np.array([1], np.int32), np.array([1.0], np.float32))] * 1200
    toxic = [(np.array([1, 2], np.int32), np.array([1.0, 1.0], np.float32))] * 3
    model = quality.fit(rest + toxic, np.array([2] * 1200 + [1] * 3), 3)
    assert model.weights[2] < -1
    v = [(np.array([1], np.int32), np.array([1.0], np.float32))] * 200
    model = quality.fit(v, np.array([0] * 50 + [1] * 100 + [2] * 50), 3, rounds=800, rate=0.05, decay=0.0, shares=np.array([0.25, 0.25, 0.5]))
    tails = model.tails(model.weights[[1]].astype(float))
    assert abs(tails[0, 0] - 0.75) < 0.03 and abs(tails[0, 1] - 0.5) < 0.03


def test_quality_cases(spark, messy):
    none = spark.createDataFrame([], "doc_id long, grade int")
    scored = quality.score(messy, quality.train(messy, none)).collect()
    assert len(scored) == messy.count() and all(r.kept and r.tail == 0.5 for r in scored)
    ratings = spark.createDataFrame([(1, 0), (1, 2), (2, None), (None, 1), (3, 2), (4, 2), (10**6, 0)], "doc_id long, grade int")
    model = quality.train(messy, ratings)
    again = quality.train(messy.repartition(7), ratings)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.thresholds, again.thresholds)
    kept = quality.score(messy, model, carry=True)
    assert kept.columns == messy.columns and kept.count() == quality.score(messy, model).where("kept").count()
    assert quality.score(messy.limit(0), model).collect() == [] and quality.score(messy.limit(0), model, carry=True).collect() == []


def test_quality_sample_is_bounded(spark, monkeypatch):
    """A rated row repeated 20,000 times, and an id with 3,000 texts, bring one vector each to the driver."""
    taken = []
    monkeypatch.setattr(quality, "fit", lambda vectors, grades, n, **more: taken.append(sorted(grades.tolist())) or quality.Model(thresholds=np.zeros(n - 1)))
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("some text").alias("text"))
    many = spark.range(3_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    quality.train(rows.union(many), spark.createDataFrame([(1, 0), (2, 2)], "doc_id long, grade int"))
    assert taken == [[0, 2]]


def test_gradient_is_that_of_the_loss():
    """A tiny fit reaches the likelihood that a fine search over its two weights finds."""
    v = [(np.array([k], np.int32), np.array([1.0], np.float32)) for k in [0] * 30 + [1] * 30]
    g = np.array([0] * 20 + [1] * 5 + [2] * 5 + [0] * 3 + [1] * 7 + [2] * 20)
    m = quality.fit(v, g, 3, rounds=800, rate=0.05, decay=0.0)
    tails = m.tails(m.weights[[0, 1]].astype(float))
    assert abs(tails[0, 0] - 10 / 30) < 0.06 and abs(tails[1, 1] - 20 / 30) < 0.06


def test_quality_driver_holds_the_sample_once(spark, monkeypatch):
    """Python holds what comes to the driver once, and the blocks of the fit, but no further copies."""
    n, given, fit = 8000, [], quality.fit
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(250)), lambda k: F.concat(F.lit("word"), F.pmod(F.xxhash64("id", k), F.lit(3000))))).alias("text"))
    ratings = spark.range(n).select(F.col("id").alias("doc_id"), F.pmod("id", F.lit(3)).cast("int").alias("grade"))
    monkeypatch.setattr(quality, "fit", lambda vectors, *a, **b: given.append(sum(x.nbytes + y.nbytes for x, y in vectors)) or fit(vectors, *a, rounds=3, **b))
    tracemalloc.start()
    try:
        quality.train(docs, ratings)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3.6 * given[0], (peak, given)  # blocks of 12 bytes a feature beside the 8 that came, and fixed arrays

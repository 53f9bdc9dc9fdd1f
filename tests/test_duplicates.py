import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaqc.config import Thresholds
from mediaqc.operators import duplicates as dup

SCHEMA = "seq long, ph_hi long, ph_lo long, dh_hi long, dh_lo long, wh_hi long, wh_lo long"


def near(rnd, x, bits):
    for b in rnd.sample(range(64), bits):
        x ^= 1 << b
    return x


def rows(rnd, n):
    base = [[rnd.getrandbits(64) for _ in range(3)] for _ in range(6)]
    out = []
    for k in range(n):
        h = [near(rnd, x, rnd.choice([0, 2, 5, 6, 7, 8, 9, 20])) for x in rnd.choice(base)]
        out.append((k, *[v for x in h for v in divmod(x, 1 << 32)]))
    return out


def brute(data, t):
    out = {}
    for i, a in enumerate(data):
        for b in data[i + 1 :]:
            d = [bin(a[k] ^ b[k]).count("1") + bin(a[k + 1] ^ b[k + 1]).count("1") for k in (1, 3, 5)]
            v = (d[0] <= t.phash) + (d[1] <= t.dhash) + (d[2] <= t.whash)
            if v >= t.votes:
                out[a[0], b[0]] = (*d, v)
    return out


@pytest.mark.parametrize("t", [Thresholds(), Thresholds(phash=20, dhash=18, whash=20)])
def test_vote_pairs_equal_brute_force(spark, t):
    data = rows(random.Random(4), 150)
    got = {(r.l, r.r): (r.ph_d, r.dh_d, r.wh_d, r.votes) for r in dup.vote_pairs(spark.createDataFrame(data, SCHEMA), t).collect()}
    assert got == brute(data, t) and got


def test_best_match_prefers_votes_then_confidence_then_earliest(spark):
    pairs = spark.createDataFrame([(0, 9, 0, 9, 9, 2), (1, 9, 6, 8, 5, 3), (2, 9, 6, 8, 5, 3), (3, 8, 1, 1, 99, 2), (4, 8, 0, 0, 99, 2)], "l long, r long, ph_d int, dh_d int, wh_d int, votes int")
    got = {r.r: r.match_id for r in dup.best_match(pairs).collect()}
    assert got == {9: 1, 8: 4}


def test_registration_equals_sequential(spark):
    rnd = random.Random(2)
    n = 120
    edges = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(150)} | {(0, 1), (1, 2)})
    reg = []
    for i in range(n):
        if not any((j, i) in set(edges) for j in reg):
            reg.append(i)
    nodes = spark.range(n).withColumnRenamed("id", "node")
    got = sorted(r.node for r in dup.registered(nodes, spark.createDataFrame(edges, "l long, r long")).where("registered").collect())
    assert got == reg


def test_cluster_roots_follow_chains(spark):
    m = spark.createDataFrame([(k, k - 1) for k in range(1, 12)] + [(20, 15)], "r long, match_id long")
    got = {r.r: r.root for r in dup.cluster_roots(m).collect()}
    assert got == {**{k: 0 for k in range(1, 12)}, 20: 15}


def test_cosine_pairs_and_crowd_out(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[50:] = x[0] + rng.normal(size=(10, 8)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, emb array<double>")
    pairs = dup.cosine_pairs(df, 3, -1.0)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(unit @ unit.T, 6)
    for r in pairs.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("rank", "l"))).alias("x")).collect():
        want = sorted(range(r.r), key=lambda j: (-s[r.r, j], j))[:3]
        assert [v.l for v in r.x] == want
    # the allowed come after the cut: row 59 has only near rows that are not allowed
    allowed = spark.createDataFrame([(1,), (2,)], "l long")
    assert dup.candidates(pairs, allowed, 24).where("r = 59").count() == 0
    assert dup.candidates(pairs, allowed.limit(0), 24).where("r = 59").count() == 3


def test_keypoint_scan_takes_first_by_rank(spark):
    rows = [(9, 1, 0.8, 1, 40, 25, 90, 90), (9, 2, 0.7, 2, 40, 30, 90, 90), (9, 3, 0.66, 3, 40, 39, 90, 90), (8, 1, 0.63, 1, 40, 39, 90, 90)]
    df = spark.createDataFrame(rows, "r long, l long, cos double, place int, good int, inliers int, kp_a int, kp_b int")
    got = dup.keypoint_scan(df).collect()
    assert [(r.r, r.match_id, r.score, r.method) for r in got] == [(9, 2, 0.7, "ORB Multi-Angle (30 inliers)")]


def test_exact_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id long, t string")
    assert {r.id: r.first_id for r in dup.exact_first(df, "id", F.md5("t")).collect()} == {3: 1, 1: 1, 2: 2}


def test_cosine_decision_counts_a_single_vote(spark):
    from mediaqc.plans import dedup_queries

    zero, far = (0, 0), (-1, -1)
    rows = [(1, *zero, *zero, *zero), (2, *zero, *far, *far), (3, *far, *far, *far), (4, *zero, *zero, *far), (5, *far, *far, *far)]
    h = spark.createDataFrame(rows, "seq long, ph_hi long, ph_lo long, dh_hi long, dh_lo long, wh_hi long, wh_lo long")
    first = spark.createDataFrame([(1, 2, 0.40), (1, 3, 0.40), (1, 4, 0.40), (1, 5, 0.46)], "l long, r long, cos double")
    got = {(r.vec_id, r.votes) for r in dedup_queries.decided(first, h).collect()}
    assert got == {(2, 1), (4, 2), (5, 0)}


def test_exact_first_leaves_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "x", "d1", "r1"), (2, "x", "d2", "r2"), (3, "y", "d3", "r3")], "id long, text string, digest string, row string").withColumn("_digest", F.col("digest")).withColumn("first", F.lit(9))
    got = sorted(dup.exact_first(df, "id", F.md5("text")).collect())
    assert [tuple(r) for r in got] == [(1, "x", "d1", "r1", "d1", 9, 1), (2, "x", "d2", "r2", "d2", 9, 1), (3, "y", "d3", "r3", "d3", 9, 3)]
    with pytest.raises(ValueError, match="already"):
        dup.exact_first(df.withColumn("first_id", F.lit(0)), "id", F.md5("text"))


def test_record_takes_the_first_kind(spark):
    digests = spark.createDataFrame([(5, 1)], "r long, match_id long")
    hashes = spark.createDataFrame([(5, 2, 3, 99.0, 0, 0, 0), (6, 2, 2, 81.5, 1, 20, 2)], "r long, match_id long, votes int, similarity double, ph_d int, dh_d int, wh_d int")
    vectors = spark.createDataFrame([(6, 3, 0.99, 1, "CLIP Semantic"), (7, 3, 0.987654, 2, "CLIP Semantic")], "r long, match_id long, score double, votes int, method string")
    found = dup.explained(dup.record(digests, hashes, vectors).withColumn("original_status", F.lit("Valid")))
    got = {r.r: (r.match_id, r.status, r.similarity, r.layer, r.forensic_reasoning) for r in found.collect()}
    assert got[5] == (1, "Exact Duplicate", 100.0, 1, "MD5 fingerprint matched a recent/current-batch image. Matched 1. Similarity 100.0%. Original: Valid.")
    assert got[6] == (2, "Perceptual Duplicate", 81.5, 1, "Hash votes=2/3 (pHash=1, dHash=20, wHash=2). Matched 2. Similarity 81.5%. Original: Valid.")
    assert got[7] == (3, "CLIP Semantic", 98.77, 3, "CLIP Semantic: score=0.988, support=2. Matched 3. Original: Valid.")

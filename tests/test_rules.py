import itertools

import pytest
from pyspark.sql import functions as F

from mediaqc import config as c
from mediaqc.config import Thresholds
from mediaqc.operators import duplicates, rules

BASE = {
    "raw_moire": 0.0, "poster": False, "has_bezel": False, "bezel_score": 0.0, "ela_score": 0.0, "ss_software": False, "has_timestamp": False,
    "is_blurry": False, "blur_score": 100.0, "edge_mean": 0.0, "edge_std": 0.0, "hist_peaks": 0, "face_count": 1, "gray_std": 20.0, "has_branding_colors": True,
}


def frame(spark, rows, base=BASE):
    return spark.createDataFrame([{**base, **r, "n": k} for k, r in enumerate(rows)])


def test_cv_truth_table(spark):
    cases = list(itertools.product([False, True], repeat=5))
    rows = [{"has_bezel": b, "bezel_score": 0.4 if b else 0.0, "ela_score": 0.51 if e else 0.0, "ss_software": s, "is_blurry": u, "blur_score": 10.0 if u else 100.0, "edge_mean": 210.0 if g else 0.0, "hist_peaks": 9 if g else 0, "raw_moire": 0.39 if g else 0.0} for b, e, s, u, g in cases]
    got = {r.n: (r.score, r.x) for r in rules.forensic_score(frame(spark, rows)).select("n", "score", rules.cv_reject().alias("x")).collect()}
    for k, (b, e, s, u, g) in enumerate(cases):
        ioi = 0.0
        for on, w in ((b, 0.45), (g, 0.30), (g, min(0.39 * 0.35, 0.35)), (e, 0.20), (g, 0.12)):
            ioi += w if on else 0.0
        score = 0.0
        for on, w in ((b, 0.35), (e, 0.20), (s, 0.25), (u, 0.55), (min(ioi, 1.0) >= 0.48, 0.40)):
            score += w if on else 0.0
        assert got[k] == (min(score, 1.0), min(score, 1.0) > 0.85)


def test_float_trap_rejects(spark):
    row = {"ela_score": 0.6, "ss_software": True, "edge_mean": 210.0, "raw_moire": 0.39, "hist_peaks": 9}
    r = rules.forensic_score(frame(spark, [row])).select("score", rules.cv_reject().alias("x")).first()
    assert r.score == 0.8500000000000001 and r.x


def test_poster_dims_moire(spark):
    r = rules.forensic_score(frame(spark, [{"raw_moire": 0.8, "poster": True}, {"raw_moire": 0.8}])).orderBy("n").collect()
    assert (r[0].has_moire, r[0].moire_score) == (False, 0.8 * 0.15) and r[1].has_moire


def test_gate_order(spark):
    rows = [
        {"has_bezel": True, "ss_software": True, "ela_score": 0.9},
        {"has_bezel": True, "ela_score": 0.9},
        {"gray_std": 4.9},
        {"bezel_score": 0.2, "hist_peaks": 8},
        {"face_count": 0, "ela_score": 0.51},
        {"has_branding_colors": False},
        {"face_count": 0, "has_branding_colors": False},
    ]
    got = [r.x for r in rules.forensic_score(frame(spark, rows)).select("n", rules.pre_ai_reason().alias("x")).orderBy("n").collect()]
    assert got[:3] == [c.SCREENSHOT_GATE, c.MANIPULATED_GATE, c.BLANK_GATE]
    assert got[3].startswith("Screen/printed-photo detected (IoI score=0.57): device_bezel(0.20), pixel_quantization.")
    assert got[4:] == [c.NO_FACE_GATE, c.BRANDING_GATE, None]


def test_minor_policy_all(spark):
    names = ["has_child", "child_only", "minor_holding", "adult_holding"]
    cases = list(itertools.product([False, True], repeat=4))
    df = spark.createDataFrame([{"n": k, **{f"pro_{a}": v for a, v in zip(names, x)}} for k, x in enumerate(cases)])
    got = {r.n: r.x for r in df.select("n", rules.minor_reason("pro").alias("x")).collect()}
    for k, (child, only, holds, adult) in enumerate(cases):
        assert got[k] == (c.ONLY_CHILDREN if only else c.MINOR_HOLDS if holds else c.NO_ADULT_HOLDS if child and not adult else None)


@pytest.mark.parametrize(("cos", "votes", "hit"), [(0.97, 0, True), (0.9699, 0, False), (0.90, 1, True), (0.8999, 1, False), (0.90, 0, False)])
def test_cosine_boundaries(spark, cos, votes, hit):
    df = spark.createDataFrame([(cos, votes)], "cos double, votes int")
    assert (df.select(duplicates.cosine_method().alias("m")).first().m is not None) == hit


def test_face_veto_matrix(spark):
    rows = [(s, m, v, q) for s in (None, 0.54, 0.55) for m in ("CLIP Semantic", "ORB Multi-Angle (60 inliers)") for v in (59, 60) for q in (0.57, 0.58)]
    df = spark.createDataFrame(rows, "face_sim double, method string, votes int, score double")
    for r in df.select("*", duplicates.face_veto().alias("x")).collect():
        strong = r.method.startswith("ORB") and r.votes >= 60 and r.score >= 0.58
        assert r.x == (r.face_sim is not None and r.face_sim < 0.55 and not strong)


def test_switches(spark):
    t = Thresholds(branding_color_gate=False, minor_policy=False)
    df = rules.forensic_score(frame(spark, [{"has_branding_colors": False}])).withColumn("pro_child_only", F.lit(True))
    r = df.select(rules.pre_ai_reason(t).alias("a"), rules.minor_reason("pro", t).alias("b")).first()
    assert r.a is None and r.b is None

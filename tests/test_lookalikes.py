"""The third layer: rows against the rule row by row, and in the batch."""

import random

import numpy as np
from pyspark.sql import functions as F

from mediaqc.config import Thresholds
from mediaqc.operators import duplicates, lookalikes
from mediaqc.plans import batch
from mediaqc.schemas import CLUSTERS
from tests import test_batch as stand_ins
from tests.test_keypoints import image, shown

POINT = "array<struct<kp:long,x:double,y:double,angle:double,size:double,words:array<long>>>"
ROWS = f"seq long, old boolean, emb array<double>, {', '.join(f'{p} long' for p in lookalikes.PARTS)}, face array<double>"


def unit(v):
    return (np.array(v) / np.linalg.norm(v)).tolist()


def at_cosine(rng, v, c):
    """A vector at the cosine ``c`` to the unit vector ``v``."""
    w = rng.normal(size=len(v))
    w -= np.dot(w, v) * np.array(v)
    return (c * np.array(v) + np.sqrt(1 - c * c) * w / np.linalg.norm(w)).tolist()


def by_hand(rows, t):
    """Each row against all earlier ones."""
    out = {}
    for seq, old, emb, *rest in rows:
        if old or emb is None:
            continue
        h, face = rest[:6], rest[6]
        ranked = sorted((-round(float(np.dot(unit(emb), unit(o[2]))), 6), o[0]) for o in rows if o[0] < seq and o[2] is not None)
        if not ranked or -ranked[0][0] < t.cosine_floor:
            continue
        c, other = -ranked[0][0], next(o for o in rows if o[0] == ranked[0][1])
        d = [None if h[2 * k] is None or other[3 + 2 * k] is None else sum(bin(h[2 * k + s] ^ other[3 + 2 * k + s]).count("1") for s in (0, 1)) for k in range(3)]
        votes = sum(x is not None and x <= limit for x, limit in zip(d, (t.phash, t.dhash, t.whash), strict=True))
        if c >= t.cosine_strong or c >= t.cosine and votes >= 1:
            f = other[9]
            if not (face and f and np.dot(unit(face), unit(f)) < t.face_veto):
                out[seq] = (other[0], votes, "CLIP Semantic")
    return out


def test_equals_the_rule(spark):
    rng, t = np.random.default_rng(4), Thresholds(top_k=100, candidates=24)
    base = [unit(rng.normal(size=16)) for _ in range(6)]
    hashes = rng.integers(0, 1 << 32, (6, 6)).tolist()
    rows = []
    for seq in range(150):
        g = int(rng.integers(6))
        h = list(hashes[g])
        for _ in range(int(rng.choice([0, 9, 60]))):
            h[int(rng.integers(6))] ^= 1 << int(rng.integers(32))
        if rng.random() < 0.1:
            h[0] = h[1] = None
        emb = None if rng.random() < 0.05 else at_cosine(rng, base[g], float(rng.choice([0.7, 0.97, 0.995])))
        face = None if rng.random() < 0.4 else unit([1.0, float(rng.choice([0.0, 3.0])), 0.1])
        rows.append((seq, seq < 30, emb, *h, face))
    found = lookalikes.found(spark.createDataFrame(rows, ROWS), t).collect()
    got = {r.r: (r.match_id, r.votes, r.method) for r in found}
    assert got == by_hand(rows, t) and len(got) > 20
    assert any(r.score < t.cosine_strong and r.votes >= 1 for r in found) and any(r.votes == 0 for r in found)
    faceless = by_hand([(*r[:-1], None) for r in rows], t)
    assert len(faceless) > len(got)  # some were cancelled by their faces
    assert lookalikes.found(spark.createDataFrame([], ROWS), t).collect() == []
    allowed = spark.createDataFrame([(k,) for k in range(60, 120)], "l long")
    assert all(r.match_id >= 60 for r in lookalikes.found(spark.createDataFrame(rows, ROWS), t, allowed).collect())


def test_batch_with_vectors(spark):
    """A duplicate by cosine, one by key points, one that the face cancels, and one against a stored vector."""
    rng, rnd = np.random.default_rng(8), random.Random(8)
    shots = {"one": "a", "same_scene": "b", "turned": "old", "other_face": "unsure", "stored": "crash", "plain": "noface"}  # six different images
    points = lambda ps: [(k, *p) for k, p in enumerate(ps)]
    scene = image(rnd, 100)
    v, stored = unit(rng.normal(size=32)), unit(rng.normal(size=32))
    rows = [
        (0, "one", v, [1.0, 0.0], points(scene)),
        (1, "same_scene", at_cosine(rng, v, 0.985), [1.0, 0.1], None),
        (2, "turned", at_cosine(rng, v, 0.75), None, points(shown(rnd, scene, 40, 1.2, 30, -20, 8))),
        (3, "other_face", at_cosine(rng, v, 0.99), [0.0, 1.0], []),
        (4, "stored", at_cosine(rng, stored, 0.98), None, None),
        (5, "plain", unit(rng.normal(size=32)), [1.0, 0.0], points(image(rnd, 50))),
    ]
    rows = spark.createDataFrame([(k, f"http://host/{shots[n]}", n, e, f, p) for k, n, e, f, p in rows], f"row_index int, url string, note string, emb array<double>, face array<double>, points {POINT}")
    as_of = F.lit("2024-05-01 00:00:00").cast("timestamp")
    results = spark.createDataFrame([("before", "Invalid"), ("long_ago", "Valid")], "image_id string, validation_status string").withColumn("processed_at", F.when(F.col("image_id") == "before", F.lit("2024-04-29")).otherwise("2023-01-01").cast("timestamp"))
    vectors = spark.createDataFrame([("long_ago", stored, 1), ("before", at_cosine(rng, stored, 0.999), 2)], "image_id string, emb array<float>, seq long")
    found, registering = batch.verified(rows, stand_ins.SERVICES, results, None, as_of, vectors=vectors)
    got = {r.note: r for r in found.join(rows.select("row_index", "note"), "row_index").collect()}
    assert {n: r.exit_layer == 3 and r.validation_status == "Duplicate" for n, r in got.items()} == {"one": False, "same_scene": True, "turned": True, "other_face": False, "stored": True, "plain": False}
    assert got["same_scene"].duplicate_status == "CLIP Semantic" and got["same_scene"].matched_image_id == got["one"].pv_image_id == got["same_scene"].cluster_id
    assert got["turned"].duplicate_status.startswith("ORB Multi-Angle (") and got["turned"].matched_image_id == got["one"].pv_image_id
    assert got["stored"].matched_image_id == "before" and got["stored"].original_status == "Invalid"  # long_ago is nearer or not, but out of the window
    assert got["same_scene"].forensic_reasoning.startswith("CLIP Semantic: score=0.985, support=0. Matched ") and got["same_scene"].similarity_score == 98.5
    assert registering.count() == 6  # a duplicate by its vector still registers its hashes
    kept = batch.vectors_kept(vectors, found, rows)
    assert {r.image_id for r in kept.collect()} == {"before", "long_ago", *[r.pv_image_id for r in got.values()]}
    members = batch.members_kept(spark.createDataFrame([], CLUSTERS), found, as_of)
    assert {(r.cluster_id, r.image_id) for r in members.collect()} == {(r.cluster_id, r.pv_image_id) for n, r in got.items() if n in ("same_scene", "turned", "stored")}


def test_only_asking_rows_are_answered(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, v, k % 3 == 0) for k, v in enumerate(rng.normal(size=(60, 5)).tolist())], "seq long, emb array<double>, asks boolean")
    every = {tuple(r) for r in duplicates.nearest_earlier(df, 4, -1.0).collect()}
    some = {tuple(r) for r in duplicates.nearest_earlier(df, 4, -1.0, asks="asks").collect()}
    assert some == {r for r in every if r[1] % 3 == 0}

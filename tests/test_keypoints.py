"""Key points: planted turns, scales and shifts; neighbours by bands against all with all."""

import math
import random

from mediaqc.operators import duplicates, keypoints

POINTS = "image long, kp long, x double, y double, angle double, size double, words array<long>, l int, a string, bits int"


def image(rnd, n):
    return [[rnd.uniform(0, 800), rnd.uniform(0, 600), rnd.uniform(0, 360), 31.0, [rnd.getrandbits(32) for _ in range(8)]] for _ in range(n)]


def shown(rnd, points, turn, scale, du, dv, flips):
    t, out = math.radians(turn), []
    for x, y, angle, size, words in points:
        words = list(words)
        for _ in range(flips):
            words[rnd.randrange(8)] ^= 1 << rnd.randrange(32)
        u, v = scale * (x * math.cos(t) - y * math.sin(t)) + du, scale * (x * math.sin(t) + y * math.cos(t)) + dv
        out.append([u + rnd.gauss(0, 1), v + rnd.gauss(0, 1), (angle + turn) % 360, size * scale, words])
    return out


def table(spark, images):
    return spark.createDataFrame([(i, k, *p, 1, "clash", 2) for i, points in images.items() for k, p in enumerate(points)], POINTS)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "l long, r long")


def test_planted_poses_are_found(spark):
    rnd = random.Random(1)
    a, b = image(rnd, 120), image(rnd, 120)
    images = {1: a, 2: shown(rnd, a, 73, 1.4, -90, 55, 12), 3: shown(rnd, a[:70], 200, 0.6, 10, 400, 20) + image(rnd, 30), 4: b, 5: [[*p[:4], q[4]] for p, q in zip(image(rnd, 120), a, strict=True)]}
    images[6] = [[None, *p[1:]] for p in a[:20]]
    got = {(r.l, r.r): r for r in keypoints.compared(pairs(spark, [(1, 2), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 9)]), table(spark, images)).withColumn("dup", duplicates.keypoint_decision()[0]).collect()}
    assert len(got) == 6
    assert got[1, 2].good >= 118 and got[1, 2].inliers >= 110 and got[1, 2].dup
    assert got[1, 3].good >= 66 and got[1, 3].inliers >= 60 and got[1, 3].dup and got[1, 3].kp_b == 100
    assert got[1, 4].good == got[1, 4].inliers == 0 and not got[1, 4].dup
    assert got[1, 5].good == 120 and got[1, 5].inliers < 26 and not got[1, 5].dup  # the same descriptors all over the place
    assert (got[1, 6].kp_b, got[1, 6].good) == (20, 0) and (got[1, 9].kp_b, got[1, 9].good) == (0, 0)
    assert keypoints.compared(pairs(spark, []), table(spark, images)).collect() == []


def test_matches_equal_all_with_all(spark):
    """Distances around the reach and the ratio, and descriptors that share many bands."""
    rnd = random.Random(2)
    a = image(rnd, 40)
    b = shown(rnd, a, 0, 1, 0, 0, 30) + shown(rnd, a[:20], 0, 1, 0, 0, 38) + shown(rnd, a[20:], 0, 1, 0, 0, 10) + [[*p[:4], a[0][4]] for p in image(rnd, 3)]
    got = {(r.a.kp, r.b.kp) for r in keypoints.matches(pairs(spark, [(1, 2)]), table(spark, {1: a, 2: b})).collect()}
    want = set()
    for i, p in enumerate(a):
        near = sorted((d, j) for j, q in enumerate(b) if (d := sum((x ^ y).bit_count() for x, y in zip(p[4], q[4], strict=True))) <= keypoints.REACH)
        if near and near[0][0] < keypoints.RATIO * (near[1][0] if len(near) > 1 else keypoints.REACH + 1):
            want.add((i, near[0][1]))
    assert got == want and want


def test_chunks_and_passes_equal_all_with_all(spark, monkeypatch):
    """Images of several chunks, several passes and matrices: the same matches and figures; a point travels once a pair, not once a band."""
    rnd = random.Random(3)
    a = image(rnd, 45)
    images = {1: a, 2: shown(rnd, a, 40, 1.2, 9, -30, 12) + shown(rnd, a[:20], 40, 1.2, 9, -30, 14), 3: image(rnd, 7), 4: shown(rnd, a[:9], 10, 1, 0, 0, 3)}
    images[3][0][4] = None
    points, asked = table(spark, images), pairs(spark, [(1, 2), (1, 3), (1, 4), (4, 2), (2, 1), (1, 1)])

    def run():
        found = keypoints.matches(asked, points).select("l", "r", "a", "b").collect()
        return sorted((r.l, r.r, r.a.kp, r.b.kp, r.a.x, r.b.y) for r in found), sorted(map(tuple, keypoints.compared(asked, points).collect()))

    whole = run()
    sent, deal = [], keypoints._dealt

    def counted(*args):
        sent.append(deal(*args).count())
        return deal(*args)

    monkeypatch.setattr(keypoints, "_dealt", counted)
    assert run() == whole and len(whole[0]) > 100
    want = sum(len(images[i]) for p in asked.collect() for i in p)
    assert sent == [want] * 2
    for name, n in (("CHUNK", 16), ("PASS", 200), ("MATRIX", 64)):
        monkeypatch.setattr(keypoints, name, n)
    assert run() == whole and len(sent) > 4

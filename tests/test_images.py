"""Transforms, recompression and frames of grids against numpy and drawn frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaqc.functions import transforms
from mediaqc.functions.hashing import transform_hashes
from mediaqc.operators.frames import frames
from mediaqc.plans import image_queries


def table(spark, grids):
    return spark.createDataFrame([(k, g) for k, g in enumerate(grids)], "id long, e array<double>")


def cosine_matrix(n):
    return np.array([[np.cos(np.pi * (2 * t + 1) * u / (2 * n)) for t in range(n)] for u in range(n)])


def bits(values, median):
    word = 0
    for v in values:
        word = word * 2 + int(v > median)
    return word >> 32, word & 0xFFFFFFFF


@pytest.mark.parametrize("side", [8, 16, 32])
def test_transform_hashes(spark, side):
    rng = np.random.default_rng(side)
    grids = [rng.normal(size=(side, side)) for _ in range(5)]
    got = {r.id: r for r in table(spark, [g.ravel().tolist() for g in grids]).select("id", *[x.alias(n) for n, x in transform_hashes(F.col("e"), side).items()]).collect()}
    for k, g in enumerate(grids):
        d = cosine_matrix(side)
        low = (d @ g @ d.T)[:8, :8].ravel().round(9)
        blocks = g.reshape(8, side // 8, 8, side // 8).mean((1, 3)).ravel()
        assert (got[k].ph_hi, got[k].ph_lo) == bits(low, np.median(low))
        assert (got[k].wh_hi, got[k].wh_lo) == bits(blocks, np.median(blocks))


def test_haar_is_orthonormal():
    for n in (8, 16, 32):
        w = np.array(transforms.haar(n, n))
        assert np.allclose(w @ w.T, np.eye(n))


def recompressed(levels, quality):
    d = np.array(transforms.cosines(8, 8, orthonormal=True))
    q = np.array(transforms.quantisers(quality))
    c = np.floor((d @ (np.array(levels).reshape(8, 8) - 128.0) @ d.T).round(9) / q + 0.5) * q
    return np.clip(np.floor((d.T @ c @ d).round(9) + 128.5), 0, 255).ravel()


def test_recompression(spark):
    rng = np.random.default_rng(2)
    smooth = [int(16 * r + 12 * k) for r in range(8) for k in range(8)]
    blocks = [rng.integers(0, 256, 64).tolist() for _ in range(6)] + [smooth, [128] * 64, [0] * 32 + [255] * 32]
    rows = spark.createDataFrame(list(enumerate(blocks)), "id long, levels array<int>")
    for quality in (90, 30):
        got = {r.id: r for r in rows.select("id", transforms.recompressed(F.col("levels"), quality).alias("z"), transforms.recompression_error(F.col("levels"), quality).alias("ela")).collect()}
        for k, b in enumerate(blocks):
            want = recompressed(b, quality)
            assert got[k].z == want.tolist()
            assert got[k].ela == pytest.approx(np.abs(want - b).mean() / 255)
        assert got[7].ela == 0.0 and got[6].ela < got[0].ela


def test_awkward_grids(spark):
    grids = [None, [], [1.0] * 63, [1.0] * 63 + [None], [2.0] * 64, [1.0] * 63 + [float("nan")], [1.0] * 63 + [float("inf")]]
    rows = table(spark, grids).withColumn("levels", transforms.grey_levels(F.col("e")))
    got = {r.id: r for r in rows.select("id", "levels", transforms.recompression_error(F.col("levels")).alias("ela"), *[x.alias(n) for n, x in transform_hashes(F.col("e")).items()]).collect()}
    for k in (0, 1, 2, 3, 5, 6):
        assert got[k][1:] == (None,) * 6
    assert got[4].levels == [0] * 64 and (got[4].wh_hi, got[4].wh_lo) == (0, 0)
    found = {r.id: tuple(r)[1:] for r in frames(rows).collect()}
    assert found == {k: (False, 0.0, 0) for k in range(7)}
    assert frames(rows.limit(0)).collect() == []
    assert [r.id for r in frames(rows.union(rows).union(spark.createDataFrame([(None, [1.0] * 64, [1] * 64)], rows.schema))).orderBy("id").collect()] == list(range(7))


def test_drawn_frames(spark):
    """A bright upright screen, one that fills a corner only, a thin line and a triangle; 24 x 24 levels."""

    def drawn(paint):
        a = np.zeros((24, 24), int)
        for r in range(24):
            for k in range(24):
                a[r, k] = 220 if paint(r, k) else 10
        return a.ravel().tolist()

    shapes = {
        "screen": drawn(lambda r, k: 3 <= r <= 20 and 4 <= k <= 19),
        "small": drawn(lambda r, k: r < 6 and k < 6),
        "line": drawn(lambda r, k: r == 12),
        "triangle": drawn(lambda r, k: r >= 2 and k <= r),
        "weak": [v // 10 for v in drawn(lambda r, k: 3 <= r <= 20 and 4 <= k <= 19)],
    }
    rows = spark.createDataFrame(list(enumerate(shapes.values())), "id long, levels array<int>")
    got = {list(shapes)[r.id]: r for r in frames(rows, side=24).collect()}
    assert {n: r.has_bezel for n, r in got.items()} == {"screen": True, "small": False, "line": False, "triangle": False, "weak": False}
    # the gradient reaches one cell to each side of the screen's border: 20 by 18 cells between rows 2 and 21, columns 3 and 20
    assert got["screen"].bezel_score == pytest.approx(19 * 17 / 576) and got["screen"].regions == 1 and got["weak"].regions == 0


def test_queries_are_registered():
    assert image_queries.QUERIES.keys() == image_queries.ORACLE.keys()

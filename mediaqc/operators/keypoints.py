"""Geometric matching of images by their key points, as joins and aggregates.

Key points are rows (image, kp, x, y, angle in degrees, size, words: the descriptor as ``WORDS`` numbers of 32 bits); candidate
pairs of images are rows (l, r). A key point of the left image matches its nearest one of the right image, within ``REACH``
bits, if that is nearer than ``RATIO`` times the second nearest (neighbours beyond the reach count as one bit beyond it). Each
match tells how the image was turned, scaled and moved, and votes for the two nearest bins of each of these, 16 cells; the
fullest cell of a pair gives a turn, scale and shift by least squares, and the matches that it moves to within ``LIMIT``
pixels are the inliers.

A point travels once for each pair of its image, not once a band: Spark brings the points of both images of a pair together,
and tasks read them pair by pair as a stream and compare all with all. Images of more than ``CHUNK`` points are dealt in
chunks, each chunk meets each of the other image, and the two nearest of all chunks are found by an aggregate, so a task
holds two chunks and a batch. Pairs go in passes of about ``PASS`` points, at most ``PASSES``, each reading the points again,
so that the files of one pass lie on the disk at a time. A pair's votes are counted and summed where they arise.

Defined results: a pair without matches has 0 good and 0 inliers; an image without key points has 0 of them; pairs that
repeat count once; key points with a null place, angle, size or descriptor take no part in matches but are counted; a size
of 0 counts as 1; ties go to the smaller key point, and of equally full cells to the smallest; no pairs give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaqc.plans.lineage import cut, forget

WORDS, REACH = 8, 31
RATIO, LIMIT = 0.75, 10.0
#: Degrees, octaves and pixels of a bin.
TURN, OCTAVE, SHIFT = 30.0, 1.0, 64.0
#: Points of an image that meet at once; points and pairs of a pass, and passes at most; elements of a matrix of distances.
CHUNK, PASS, PASS_PAIRS, PASSES, MATRIX = 4_096, 6 << 20, 1 << 17, 16, 1 << 20

_POINT = ("kp", "x", "y", "angle", "size")
_KEY = ("l", "r", "ca", "cb")


def _usable() -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*_POINT, "words")]) & (F.size("words") == WORDS)


def _sizes(points: DataFrame) -> DataFrame:
    """(image, kps, n): key points of an image, and those that take part."""
    return points.groupBy("image").agg(F.count(F.lit(1)).alias("kps"), F.count(F.when(_usable(), 1)).alias("n"))


def _nearest(a: np.ndarray, b: np.ndarray, kp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(i, j, bits) of each row's up to two nearest rows of ``b`` within the reach, by bits, then by ``kp`` of b; i rises."""
    found, step = [], max(1, MATRIX // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        half = np.bitwise_count(part[:, None, 0] ^ b[None, :, 0])
        half += np.bitwise_count(part[:, None, 1] ^ b[None, :, 1])
        i, j = np.nonzero(half <= REACH)
        bits = half[i, j].astype(np.int64) + sum(np.bitwise_count(part[i, w] ^ b[j, w]).astype(np.int64) for w in range(2, WORDS // 2))
        near = bits <= REACH
        found.append((i[near] + at, j[near], bits[near]))
    i, j, bits = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((kp[j], bits, i))
    i, j, bits = i[order], j[order], bits[order]
    two = np.arange(len(i)) - np.searchsorted(i, i) < 2
    return i[two], j[two], bits[two]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair, chunks and side to (l, r, both points, bits, second, whole): a point's nearest with the second's
    bits where it met all points of the other image (whole), else its two nearest, a row each."""

    def done(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        side, kp, parts = (t[c].to_numpy() for c in ("side", "kp", "parts"))
        words = np.stack([t[f"w{k}"].to_numpy() for k in range(WORDS // 2)], axis=1).view(np.uint64)
        out = []
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            mid = low + int(np.searchsorted(side[low:high], 1))
            if low == mid or mid == high:
                continue
            i, j, bits = _nearest(words[low:mid], words[mid:high], kp[mid:high])
            whole = np.full(len(i), parts[low] == 1)
            second = np.full(len(i), -1)
            if len(i) and whole[0]:
                first = np.ones(len(i), bool)
                first[1:] = i[1:] != i[:-1]
                follows = np.append(~first[1:], False)
                second[follows] = bits[np.flatnonzero(follows) + 1]
                i, j, bits, second, whole = i[first], j[first], bits[first], second[first], whole[first]
            out.append((i + low, j + mid, bits, second, whole))
        i, j, bits, second, whole = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
        a, b = t.take(pa.array(i)), t.take(pa.array(j))
        columns = {"l": a["l"], "r": a["r"]} | {f"{s}_{c}": x[c] for s, x in (("a", a), ("b", b)) for c in _POINT}
        columns |= {"bits": pa.array(bits.astype(np.int32)), "second": pa.array(second.astype(np.int32), mask=second < 0), "whole": pa.array(whole)}
        return pa.table(columns).combine_chunks()

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t.filter(t["ok"])  # here, as Spark would evaluate descriptors once more for a filter before the exchange
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        if not len(t):
            continue
        new = np.zeros(len(t), bool)
        for c in _KEY:
            x = t[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = np.append(0, np.flatnonzero(new))  # the last group may go on
        if len(starts) > 1:
            yield from done(t.slice(0, starts[-1]), starts).to_batches()
        held = t.slice(starts[-1])
    if held is not None:
        yield from done(held, np.array([0, len(held)])).to_batches()


def _dealt(pairs: DataFrame, slim: DataFrame, wide: bool) -> DataFrame:
    """The points of both images of each pair, once for each chunk of the other image. The points are read once."""
    role = lambda own, other, side: pairs.select(F.col(own).alias("image"), "l", "r", F.lit(side).alias("side"), F.col(f"c{own}").alias("mine"), F.col(f"c{other}").alias("theirs"), F.col("cr").alias("parts"))
    roles = role("l", "r", 0).unionByName(role("r", "l", 1))
    joined = slim.join(roles if wide else F.broadcast(roles), "image")
    own, other = F.pmod(F.xxhash64("kp"), F.col("mine")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("theirs") - 1))
    joined = joined.withColumn("own", own).withColumn("other", other)
    cell = lambda side: F.when(F.col("side") == side, F.col("own")).otherwise(F.col("other"))
    return joined.select("l", "r", cell(0).alias("ca"), cell(1).alias("cb"), "side", "parts", "ok", *_POINT, *[f"w{k}" for k in range(WORDS // 2)])


def matches(pairs: DataFrame, points: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(l, r, a, b): the key points of each pair that pass the ratio test; a and b are structs."""
    spark = pairs.sparkSession
    sizes = cut(_sizes(points), "sizes") if sizes is None else sizes
    types = dict(points.dtypes)
    two = [F.shiftleft(F.element_at("words", 2 * k + 1), 32).bitwiseOR(F.element_at("words", 2 * k + 2)).alias(f"w{k}") for k in range(WORDS // 2)]
    slim = points.select("image", "kp", _usable().alias("ok"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "angle")], F.when(F.col("size") == 0, 1.0).otherwise(F.col("size").cast("double")).alias("size"), *two)
    sized = lambda k: sizes.where("n > 0").select(F.col("image").alias(k), F.col("n").alias(f"n{k}"), F.ceil(F.col("n") / CHUNK).cast("int").alias(f"c{k}"))
    asked = cut(pairs.select("l", "r").distinct().join(sized("l"), "l").join(sized("r"), "r"), "asked")
    n, rows, parts = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("nl") * F.col("cr") + F.col("nr") * F.col("cl")), F.lit(0)), F.coalesce(F.max("cr"), F.lit(1))).first()
    passes = max(1, min(PASSES, max(-(-rows // PASS), -(-n // PASS_PAIRS))))
    cols = ", ".join(f"{s}_{c} {types['kp'] if c == 'kp' else 'double'}" for s in "ab" for c in _POINT)
    found = []
    for k in range(passes):
        part = asked.where(F.pmod(F.xxhash64("l", "r"), F.lit(passes)) == k).select("l", "r", "cl", "cr") if passes > 1 else asked.select("l", "r", "cl", "cr")
        cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // passes // (1 << 18)))
        dealt = _dealt(part, slim, n > passes * PASS_PAIRS).repartition(cells, *_KEY).sortWithinPartitions(*_KEY, "side")
        found.append(cut(dealt.mapInArrow(_compared, f"l {dict(asked.dtypes)['l']}, r {dict(asked.dtypes)['r']}, {cols}, bits int, second int, whole boolean"), "near"))
    near = reduce(DataFrame.unionByName, found).select("l", "r", *[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in _POINT]).alias(s) for s in "ab"], "bits", "second", "whole")
    good = lambda bits, second: bits < RATIO * F.coalesce(second, F.lit(REACH + 1))
    out = near.where("whole").where(good(F.col("bits"), F.col("second"))).select("l", "r", "a", "b")
    if parts > 1:
        lot = Window.partitionBy("l", "r", "a.kp").orderBy("bits", "b.kp")
        best = near.where("NOT whole").withColumns({"lot": F.row_number().over(lot), "after": F.lead("bits").over(lot)}).where("lot = 1")
        out = out.unionByName(best.where(good(F.col("bits"), F.col("after"))).select("l", "r", "a", "b"))
    forget(asked)
    out._read = found  # the tables that it reads
    return out


def _bins(value: Column) -> Column:
    """The two bins nearest to a value in bins."""
    low = F.floor(value - 0.5)
    return F.array(low, low + 1)


def voted(found: DataFrame) -> DataFrame:
    """The matches (l, r, x, y, u, v) with a row for each cell (turn, octave, du, dv) that they vote for."""
    turn = F.pmod(F.col("b.angle") - F.col("a.angle"), F.lit(360.0))
    scale = F.col("b.size") / F.col("a.size")
    flat = found.select("l", "r", F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("b.x").alias("u"), F.col("b.y").alias("v"), turn.alias("t"), scale.alias("s"))
    re, im = F.col("s") * F.cos(F.radians("t")), F.col("s") * F.sin(F.radians("t"))
    flat = flat.withColumns({"du": F.col("u") - (re * F.col("x") - im * F.col("y")), "dv": F.col("v") - (im * F.col("x") + re * F.col("y"))})
    cells = {"turn": F.transform(_bins(F.col("t") / TURN), lambda k: F.pmod(k, F.lit(int(360 / TURN)))), "octave": _bins(F.log2("s") / OCTAVE), "cu": _bins(F.col("du") / SHIFT), "cv": _bins(F.col("dv") / SHIFT)}
    for name, bins in cells.items():
        flat = flat.withColumn(name, F.explode(bins))
    return flat.drop("t", "s", "du", "dv")


#: Sums over the matches of a cell, for the least squares.
_SUMS = {"sx": "x", "sy": "y", "su": "u", "sv": "v", "dot": "x * u + y * v", "cross": "x * v - y * u", "square": "x * x + y * y"}


def _fit(s: DataFrame) -> DataFrame:
    """(l, r, re, im, du, dv) by least squares of u + iv = (re + i im)(x + iy) + du + i dv, from (l, r, n and the sums)."""
    spread = F.expr("square - (sx * sx + sy * sy) / n")
    s = s.where(spread > 1e-9).withColumns({"re": F.expr("dot - (sx * su + sy * sv) / n") / spread, "im": F.expr("cross - (sx * sv - sy * su) / n") / spread})
    return s.select("l", "r", "re", "im", F.expr("(su - (re * sx - im * sy)) / n").alias("du"), F.expr("(sv - (im * sx + re * sy)) / n").alias("dv"))


def compared(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(l, r, kp_a, kp_b, good, inliers) of each pair."""
    pairs = cut(pairs.select("l", "r").distinct(), "pairs")
    points = points.select("image", "kp", "x", "y", "angle", "size", "words")
    sizes = cut(_sizes(points), "sizes")
    near = matches(pairs, points, sizes)
    found = cut(near, "matches")
    forget(*near._read)
    cell = ["turn", "octave", "cu", "cv"]
    cells = voted(found).groupBy("l", "r", *cell).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(f"cast({e} as double)")).alias(k) for k, e in _SUMS.items()])
    fullest = cells.groupBy("l", "r").agg(F.min(F.struct((-F.col("n")).alias("less"), *cell, *_SUMS)).alias("w"))
    pose = cut(_fit(fullest.select("l", "r", (-F.col("w.less")).cast("double").alias("n"), *[f"w.{k}" for k in _SUMS])), "poses")
    all_ = found.select("l", "r", F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("b.x").alias("u"), F.col("b.y").alias("v")).join(pose, ["l", "r"], "left")
    off = F.hypot(F.expr("re * x - im * y + du - u"), F.expr("im * x + re * y + dv - v"))
    figures = all_.groupBy("l", "r").agg(F.count(F.lit(1)).alias("good"), F.count(F.when(off <= LIMIT, 1)).alias("inliers"))
    figures = cut(figures, "figures")
    forget(found, pose)
    size = lambda image, kps: sizes.select(F.col("image").alias(image), F.col("kps").alias(kps))
    out = pairs.join(size("l", "kp_a"), "l", "left").join(size("r", "kp_b"), "r", "left").join(figures, ["l", "r"], "left")
    return out.select("l", "r", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kp_a", "kp_b", "good", "inliers")])

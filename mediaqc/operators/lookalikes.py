"""The third layer: rows that are no duplicates by digest or hashes, against the vectors of all earlier ones.

A row's nearest earlier rows are its candidates. The first of them makes it a duplicate by a very high cosine, or by a high
one that a hash supports; else the first candidate whose key points match does. Faces that differ cancel what was found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaqc.config import Thresholds
from mediaqc.functions.hashing import HASHES, hamming
from mediaqc.operators import duplicates, keypoints
from mediaqc.operators.vectors import nearest_earlier
from mediaqc.plans.lineage import cut, forget

PARTS = [f"{n}_{side}" for n in HASHES for side in ("hi", "lo")]


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is null, of another length, or without any direction."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    long = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (long > 0), dot(a, b) / long)


def _pair(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The pairs (l, r, ...) with structs a and b of the columns of both rows. Two equi-joins."""
    a, b = (rows.select(F.col("seq").alias(k), F.struct(*columns).alias(name)) for k, name in (("l", "a"), ("r", "b")))
    return pairs.join(a, "l", "left").join(b, "r", "left")


def found(rows: DataFrame, t: Thresholds = Thresholds(), allowed: DataFrame | None = None) -> DataFrame:
    """(r, match_id, score, votes, method) of the new rows that look like an earlier one, numbers of rows being seq.

    ``rows`` has seq (the order, whole and unique), old (true for stored rows, which are only found), emb, the halves of the
    hashes, and may have face (a vector of the face) and points (an array of key points as ``keypoints`` has them, without
    image). ``allowed`` (l) are the rows that count; the search ranks all.

    Only candidates of rows that cosine leaves open have their key points compared, at most ``t.candidates`` a row. Defined
    results: rows whose vector is null, empty or holds a null or non-finite component neither find nor are found; a null hash
    supports nothing; a missing face or missing key points decide nothing; ties go to the earlier row; no rows give an empty
    table; other columns are not read.
    """
    face, points = (c in rows.columns for c in ("face", "points"))
    slim = cut(rows.select("seq", (~F.col("old")).alias("new"), "emb", *PARTS, *[c for c, has in (("face", face), ("points", points)) if has]), "seen")
    near = nearest_earlier(slim, max(t.top_k, t.candidates), t.cosine_floor, asks="new")
    cands = cut(duplicates.candidates(near, allowed, t.candidates), "candidates")
    first = _pair(cands.where("place = 1"), slim, *PARTS).withColumns({f"{n}_d": hamming(n) for n in HASHES}).withColumn("votes", duplicates.votes(t))
    columns = ["r", "match_id", "score", "votes", "method"]
    kinds = [cut(first.withColumn("method", duplicates.cosine_method(t)).where("method IS NOT NULL").select("r", F.col("l").alias("match_id"), F.col("cos").alias("score"), "votes", "method"), "by_vector")]
    if points:
        open_ = cut(cands.join(kinds[0].select("r"), "r", "left_anti"), "open")
        of = open_.select("l").union(open_.select("r")).distinct().withColumnRenamed("l", "seq")
        shown = slim.select("seq", "points").join(of, "seq", "left_semi").select(F.col("seq").alias("image"), F.explode("points").alias("p")).select("image", "p.*")
        figures = keypoints.compared(open_, shown)
        kinds.append(duplicates.keypoint_scan(open_.join(figures, ["l", "r"]), t).select(*columns))
    matched = reduce(DataFrame.unionByName, [k.withColumn("votes", F.col("votes").cast("long")) for k in kinds])
    if face:
        sides = _pair(matched.withColumn("l", F.col("match_id")), slim, "face").withColumn("face_sim", cosine(F.col("a.face"), F.col("b.face")))
        matched = sides.where(~duplicates.face_veto(t))
    out = cut(matched.select(*columns), "lookalikes")
    forget(slim, cands, *kinds)
    return out

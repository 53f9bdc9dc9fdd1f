"""Duplicates among earlier rows: equal digests, hash votes, cosine, keypoints; registration order; clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaqc.config import EXACT, SUPPORTED, VOTED, Thresholds
from mediaqc.functions.hashing import HASHES
from mediaqc.operators import votes as hash_votes
from mediaqc.operators.graphs import registered
from mediaqc.operators.vectors import nearest_earlier
from mediaqc.plans.lineage import cut, forget

#: Of all pairs of rows, bands may bring together this share; beyond it they prune nothing.
MOST_MET = 1 / 8


def exact_first(df: DataFrame, id_col: str, digest: Column, out: str = "first_id") -> DataFrame:
    """Adds ``out``, the smallest id of an equal digest, to rows whose columns may have any other name.

    Partial aggregation, and a join of two plain exchanges, which the adaptive skew join splits at a hot digest.
    """
    if out in df.columns:
        raise ValueError(f"the rows have a column {out} already")
    keyed = df.select(F.struct("*").alias("row"), digest.alias("digest"), F.col(id_col).alias("id"))
    first = cut(keyed.groupBy("digest").agg(F.min("id").alias("first")), "first")
    return keyed.join(first, "digest").select("row.*", F.col("first").alias(out))


def votes(t: Thresholds) -> Column:
    limits = dict(zip(HASHES, (t.phash, t.dhash, t.whash), strict=True))
    return sum((F.when(F.col(f"{n}_d") <= limit, 1).otherwise(0) for n, limit in limits.items()), F.lit(0))


def confidence(t: Thresholds) -> Column:
    limits = dict(zip(HASHES, (t.phash, t.dhash, t.whash), strict=True))
    return sum((F.greatest(F.lit(0.0), 1.0 - F.col(f"{n}_d") / F.lit(max(limit, 1))) for n, limit in limits.items()), F.lit(0.0)) / 3.0


def _share(t: Thresholds) -> float:
    """The share of all pairs of random rows that have a band of two hashes equal."""
    bands = [[2.0 ** (low - high) for low, high in hash_votes.cuts(limit)] for limit in (t.phash, t.dhash, t.whash)]
    return sum(sum(bands[a]) * sum(bands[b]) for a, b in ((0, 1), (0, 2), (1, 2)))


def vote_pairs(h: DataFrame, t: Thresholds = Thresholds(), id_col: str = "seq") -> DataFrame:
    """(l, r, ph_d, dh_d, wh_d, votes) of all rows l < r that at least ``t.votes`` (two or three) hashes bring together. Exact.

    Thresholds that leave bands of a few bits bring nearly all rows together by them; there all rows are compared, see ``votes``.
    """
    if t.votes < 2:
        raise ValueError("a single vote is not enough to find pairs by bands")
    rows, kind = hash_votes.rows(h, id_col), dict(h.dtypes)[id_col]
    out = hash_votes.met(rows, rows, t) if _share(t) > MOST_MET else hash_votes.banded(rows, t)
    return out.withColumns({c: F.col(c).cast(kind) for c in "lr"})


def best_votes(h: DataFrame, t: Thresholds = Thresholds(), id_col: str = "seq") -> DataFrame:
    """As best_match of vote_pairs, but only each row's best pairs leave the tasks. Of equal hashes the first row is the best match."""
    if t.votes < 2:
        raise ValueError("a single vote is not enough to find pairs by bands")
    rows = hash_votes.rows(h, id_col)
    heads = cut(rows.groupBy(*HASHES).agg(F.min("id").alias("id")).select(rows.columns), "heads")
    return best_match(hash_votes.met(rows, heads, t, best=True), t)


def registered_rows(h: DataFrame, t: Thresholds = Thresholds(), id_col: str = "seq") -> DataFrame:
    """(id, and the hashes) of the rows that register by their votes; those without hashes do."""
    done = hash_votes.registered_ids(hash_votes.rows(h, id_col), t)
    bare = h.where(F.col(id_col).isNotNull() & reduce(lambda a, b: a | b, [F.col(f"{n}_{s}").isNull() for n in HASHES for s in ("hi", "lo")]))
    return done.unionByName(bare.select(F.col(id_col).cast("long").alias("id"), *[F.lit(None).cast("long").alias(n) for n in HASHES]))


def best_match(pairs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(r, match_id, votes, similarity, and the distances): most votes, then confidence, then the earliest."""
    scored = pairs.withColumn("conf", confidence(t))
    distances = [f"{n}_d" for n in HASHES]
    best = F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("conf")).alias("c"), F.col("l"), *distances))
    found = scored.groupBy("r").agg(best.alias("b"))
    return found.select("r", F.col("b.l").alias("match_id"), (-F.col("b.v")).alias("votes"), F.round(70.0 + -F.col("b.c") * 30.0, 2).alias("similarity"), *[F.col(f"b.{d}") for d in distances])


def record(digests: DataFrame | None, hashes: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
    """(r, match_id, status, similarity, layer, reason): one record a duplicate, by the first kind of match that it has.

    ``digests`` has r and match_id; ``hashes`` is as of best_match; ``vectors`` has r, match_id, score, votes and method.
    """
    kinds = []

    def kind(rows, status, similarity, layer, reason):
        what = F.struct(F.lit(len(kinds)).alias("rank"), "match_id", status.alias("status"), similarity.cast("double").alias("similarity"), F.lit(layer).alias("layer"), reason.alias("reason"))
        kinds.append(rows.select("r", what.alias("what")))

    if digests is not None:
        kind(digests, F.lit("Exact Duplicate"), F.lit(100.0), 1, F.lit(EXACT))
    if hashes is not None:
        kind(hashes, F.lit("Perceptual Duplicate"), F.col("similarity"), 1, F.format_string(VOTED, "votes", *[f"{n}_d" for n in HASHES]))
    if vectors is not None:
        kind(vectors, F.col("method"), F.round(F.col("score") * 100, 2), 3, F.format_string(SUPPORTED, "method", "score", "votes"))
    first = reduce(DataFrame.unionByName, kinds).groupBy("r").agg(F.min("what").alias("what"))
    return first.select("r", *[f"what.{c}" for c in ("match_id", "status", "similarity", "layer", "reason")])


def explained(found: DataFrame) -> DataFrame:
    """Adds the text of a record; ``found`` has the record and original_status."""
    match, original = F.col("match_id").cast("string"), F.col("original_status")
    near = F.format_string("%s Matched %s. Similarity %.1f%%. Original: %s.", "reason", match, "similarity", original)
    return found.withColumn("forensic_reasoning", F.when(F.col("layer") == 1, near).otherwise(F.format_string("%s Matched %s. Original: %s.", "reason", match, original)))


def screened(rows: DataFrame, t: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame]:
    """Digests and hash votes of new rows against all earlier ones that registered: (records, new rows that register).

    ``rows`` has seq (the order), image_id, md5, the halves of the hashes (null for none) and ``old``, true for stored rows,
    which have registered. Rows of one digest have the same hashes, so the first of them decides for all: if it registers,
    the others are its exact duplicates; else they are near-duplicates as it is, of the best registered row before each.
    """
    parts = [f"{n}_{s}" for n in HASHES for s in ("hi", "lo")]
    slim = cut(rows.select("seq", "image_id", "md5", "old", *parts), "screened")
    first = cut(slim.where("md5 IS NOT NULL").groupBy("md5").agg(F.min("seq").alias("first")), "firsts")
    heads = slim.join(first, "md5").where("seq = first").unionByName(slim.where("md5 IS NULL").withColumn("first", F.col("seq")))
    hashed = heads.where(reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in parts]))
    pairs = vote_pairs(hashed.select("seq", *parts), t).join(heads.where("NOT old").select(F.col("seq").alias("r")), "r", "left_semi")
    pairs = cut(pairs, "pairs")
    done = cut(registered(heads.select(F.col("seq").alias("node")), pairs), "registered")
    cached = done.where("registered").select(F.col("node").alias("l"))
    copies = slim.where("md5 IS NOT NULL AND NOT old").join(first, "md5").where("seq <> first").select("seq", "first")
    exact = copies.join(cached.withColumnRenamed("l", "first"), "first").select(F.col("seq").alias("r"), F.col("first").alias("match_id"))
    others = copies.join(cached.withColumnRenamed("l", "first"), "first", "left_anti").select("seq")
    late = slim.join(others, "seq", "left_semi").select("seq", *parts).withColumn("late", F.lit(True))
    known = slim.join(cached.withColumnRenamed("l", "seq"), "seq", "left_semi").select("seq", *parts).withColumn("late", F.lit(False))
    near = pairs.join(cached, "l", "left_semi")
    if not late.isEmpty():
        both = vote_pairs(known.unionByName(late).drop("late"), t).join(others.withColumnRenamed("seq", "r"), "r", "left_semi").join(cached, "l", "left_semi")
        near = near.unionByName(both.select(near.columns))
    found = record(exact, best_match(near, t), None)
    names = slim.select(F.col("seq").alias("match_id"), F.col("image_id").alias("matched"))
    records = found.join(names, "match_id").join(slim.select(F.col("seq").alias("r"), "image_id"), "r")
    records = records.select("image_id", F.col("r").alias("seq"), F.col("matched").alias("match_id"), "status", "similarity", "layer", "reason")
    return records, slim.where("NOT old").join(records.select("seq"), "seq", "left_anti").drop("old")


def cosine_pairs(vectors: DataFrame, k: int, floor: float, id_col: str = "seq", vec_col: str = "emb") -> DataFrame:
    """(l, r, cos, rank): for each row its k nearest earlier rows with a cosine of at least ``floor``.

    Exact, see ``vectors.nearest_earlier``. A floor below the ranking leaves the ranks above it as they are.
    """
    return nearest_earlier(vectors, k, floor, id_col, vec_col)


def cosine_candidates(vectors: DataFrame, k: int, floor: float, allowed: str, n: int, id_col: str = "seq", vec_col: str = "emb") -> DataFrame:
    """(l, r, cos, place): ``candidates`` of ``cosine_pairs``, of which only the first n allowed ones leave the tasks. ``allowed`` is a column; if it is true of no row, all are."""
    some = not vectors.where(F.col(allowed)).isEmpty()
    return nearest_earlier(vectors, k, floor, id_col, vec_col, allowed=allowed if some else None, first=n).drop("rank")


def candidates(pairs: DataFrame, allowed: DataFrame | None, n: int) -> DataFrame:
    """The first n allowed of the ranked pairs. ``allowed`` has l; None or, as it is for vectors, no rows allow all."""
    if allowed is not None and not allowed.isEmpty():
        pairs = pairs.join(allowed, "l", "left_semi")
    order = Window.partitionBy("r").orderBy("rank")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("rank")


def cosine_method(t: Thresholds = Thresholds()) -> Column:
    """By cos and votes of a row's first candidate: the method, or null."""
    return F.when((F.col("cos") >= t.cosine_strong) | (F.col("cos") >= t.cosine) & (F.col("votes") >= t.cosine_votes), F.lit("CLIP Semantic"))


def keypoint_decision(t: Thresholds = Thresholds()) -> tuple[Column, Column]:
    """(duplicate, score) of a pair by good matches, inliers and keypoints of both sides."""
    enough = (F.col("kp_a") >= 8) & (F.col("kp_b") >= 8) & (F.col("good") >= t.keypoint_matches)
    score = F.least(2.0 * F.col("inliers") / F.greatest("kp_a", "kp_b", F.lit(1)), F.lit(1.0))
    dup = enough & (F.col("inliers") >= t.keypoint_inliers) & (F.col("inliers") / F.col("good") >= t.keypoint_ratio)
    return F.coalesce(dup, F.lit(False)), F.when(enough, score).otherwise(0.0)


def keypoint_scan(cands: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(r, match_id, score, method, votes): the first candidate by rank that matches by keypoints, from those of enough cosine; votes are its inliers."""
    dup, score = keypoint_decision(t)
    hits = cands.where(F.col("cos") >= t.cosine_floor).withColumn("dup", dup).withColumn("kp", score).where("dup")
    first = F.min(F.struct("place", "l", "cos", "kp", "inliers")).alias("b")
    return hits.groupBy("r").agg(first).select("r", F.col("b.l").alias("match_id"), F.greatest("b.cos", "b.kp").alias("score"), F.format_string("ORB Multi-Angle (%d inliers)", "b.inliers").alias("method"), F.col("b.inliers").alias("votes"))


def recent(pairs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """The pairs (l, r) whose l is among the ``n`` rows before r: what a store that forgets its oldest images still holds.

    ``places`` has seq and place, dense in the order in which images were stored.
    """
    l, r = (places.select(F.col("seq").alias(k), F.col("place").alias(f"place_{k}")) for k in "lr")
    return pairs.join(l, "l").join(r, "r").where((F.col("place_l") < F.col("place_r")) & (F.col("place_r") - F.col("place_l") <= n)).select(*pairs.columns)


def face_veto(t: Thresholds = Thresholds()) -> Column:
    """Faces that differ cancel a match unless the scene matches strongly; an unknown similarity (null) never does."""
    strong = F.col("method").startswith("ORB") & (F.col("votes") >= t.strong_inliers) & (F.col("score") >= t.strong_score)
    return F.coalesce((F.col("face_sim") < t.face_veto) & ~strong, F.lit(False))


def cluster_roots(matches: DataFrame) -> DataFrame:
    """(r, root) for rows matched to an earlier one (r, match_id): chains are followed by pointer jumping."""
    up = cut(matches.select("r", F.col("match_id").alias("root")), "roots")
    while True:
        above = up.select(F.col("r").alias("root"), F.col("root").alias("above"))
        after = cut(up.select("r", "root").join(above, "root", "left").select("r", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        forget(up)
        up = after
        if up.where("moved").isEmpty():
            return up.select("r", "root")

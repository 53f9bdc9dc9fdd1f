"""Queries of the duplicate operators, and the same in plain SQL.

The embeddings of the driver tables stand for 8 x 8 images; their distances are far from production thresholds, so the
queries pass their own, the same on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mediaqc.config import Thresholds
from mediaqc.functions.hashing import HASHES, hamming, sign_hashes
from mediaqc.operators import duplicates as dup
from mediaqc.operators import reports, votes
from mediaqc.plans.lineage import cut

T = Thresholds(phash=20, dhash=18, whash=20, cosine_strong=0.45, cosine=0.35, cosine_floor=0.25)


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def exact_dup_md5(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))
    return dup.exact_first(docs, "doc_id", F.col("md5")).select("doc_id", "first_id", (F.col("doc_id") != F.col("first_id")).alias("is_duplicate"))


def dup_status_kpi(spark, d):
    found = exact_dup_md5(spark, d)
    return reports.status_kpi(found.select(F.when(F.col("is_duplicate"), "Duplicate").otherwise("Valid").alias("status")))


def hashes(spark, d):
    e = _read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), *[x.alias(n) for n, x in sign_hashes(F.col("embedding")).items()])


def sign_hash(spark, d):
    return hashes(spark, d).withColumnRenamed("seq", "vec_id")


def hash_vote_pairs(spark, d):
    return dup.vote_pairs(hashes(spark, d), T)


def order_hashes(spark, d):
    """Hashes at distances near the production thresholds: orders of a customer share theirs but for a few bits."""
    word = lambda text, k: F.conv(F.substring(F.md5(text.cast("binary")), 8 * k + 1, 8), 16, 10).cast("long")

    def half(name: str, side: str):
        flips = [word(F.concat(F.lit(f"{name}{side}"), F.col("o_orderkey").cast("string")), k) for k in range(4)]
        return word(F.concat(F.lit(f"{name}{side}c"), F.col("o_custkey").cast("string")), 0).bitwiseXOR(reduce(lambda a, b: a.bitwiseAND(b), flips)).alias(f"{name}_{side}")

    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), *[half(n, s) for n in HASHES for s in ("hi", "lo")])


def hash_vote_bands(spark, d):
    """At the production thresholds pairs are found by bands."""
    return dup.vote_pairs(order_hashes(spark, d))


def hash_best_match(spark, d):
    return dup.best_votes(hashes(spark, d), T).select("r", "match_id", "votes", "similarity")


def registered_rows(spark, d):
    return dup.registered_rows(hashes(spark, d), T).select(F.col("id").alias("vec_id"))


def hash_duplicates(spark, d):
    """Each row's best match among the earlier rows that registered."""
    h = hashes(spark, d)
    found = votes.met(votes.rows(h), dup.registered_rows(h, T).where("ph IS NOT NULL"), T, best=True)
    return dup.best_match(found, T).select(F.col("r").alias("vec_id"), "match_id", "votes", "similarity")


def _topk(spark, d, first=T.candidates):
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("emb"), (F.col("label") != 3).alias("allowed"))
    return dup.cosine_candidates(e, T.top_k, T.cosine_floor, "allowed", first)


def cosine_topk(spark, d):
    return _topk(spark, d).select("r", "l", "cos", "place")


def cosine_decision(spark, d):
    """Judges each row's first candidate by its cosine and all of its hash votes, a single one included."""
    return decided(_topk(spark, d, 1), hashes(spark, d))


def decided(first, h):
    """The pairs (l, r, cos) that count as duplicates; ``h`` has the hashes by seq."""
    return judged(first, h).where("method IS NOT NULL").select(F.col("r").alias("vec_id"), F.col("l").alias("match_id"), F.round(F.col("cos") * 100, 2).alias("similarity"), "votes", "method")


def judged(first, h):
    """The pairs (l, r, cos) with votes and method. Two equi-joins, as each row has one candidate."""
    a = h.select(F.col("seq").alias("l"), F.struct(*h.columns[1:]).alias("a"))
    b = h.select(F.col("seq").alias("r"), F.struct(*h.columns[1:]).alias("b"))
    both = first.join(a, "l").join(b, "r").withColumns({f"{n}_d": hamming(n) for n in HASHES}).withColumn("votes", dup.votes(T))
    return both.withColumn("method", dup.cosine_method(T))


def first_candidates(spark, d):
    """Each row's first candidate, all of its hash votes, and the method if that makes it a duplicate (one vote is support)."""
    return judged(_topk(spark, d, 1), hashes(spark, d)).select(F.col("r").alias("vec_id"), F.col("l").alias("match_id"), F.round("cos", 6).alias("cos"), "votes", "method")


def dup_decision(spark, d):
    """One record a duplicate: equal digests first, then hash votes, then the vectors' first candidate."""
    e = _read(spark, d, "embeddings")
    digest = F.when(F.col("vec_id") % 10 == 1, F.col("vec_id") - 1).otherwise(F.col("vec_id"))
    exact = dup.exact_first(e.select("vec_id"), "vec_id", digest).where("vec_id <> first_id").select(F.col("vec_id").alias("r"), F.col("first_id").alias("match_id"))
    h = hashes(spark, d)
    voted = dup.best_votes(h, T)
    near = judged(_topk(spark, d, 1), h).where("method IS NOT NULL").select("r", F.col("l").alias("match_id"), F.col("cos").alias("score"), "votes", "method")
    return dup.record(exact, voted, near).withColumnRenamed("r", "vec_id")


def cluster_roots(spark, d):
    return dup.cluster_roots(hash_best_match(spark, d)).select(F.col("r").alias("vec_id"), F.col("root").alias("cluster_id"))


def cluster_report(spark, d):
    matches = cut(hash_best_match(spark, d), "matches")
    roots = dup.cluster_roots(matches).withColumnRenamed("r", "vec_id")
    rows = matches.withColumnRenamed("r", "vec_id").join(roots, "vec_id").select(
        F.col("root").alias("cluster_id"), F.col("vec_id").alias("duplicate_id"), F.col("match_id").alias("original_id"), F.lit("Perceptual Duplicate").alias("match_type"), "similarity", F.lit("Duplicate").alias("status")
    )
    status = matches.select(F.col("r").alias("original_id"), F.lit("Duplicate").alias("original_status"))
    return reports.cluster_report(rows.join(status, "original_id", "left").withColumn("original_status", F.coalesce("original_status", F.lit("Valid"))))


QUERIES = {
    f.__name__: f
    for f in (exact_dup_md5, dup_status_kpi, sign_hash, hash_vote_pairs, hash_vote_bands, hash_best_match, registered_rows, hash_duplicates, cosine_topk, cosine_decision, first_candidates, dup_decision, cluster_roots, cluster_report)
}


def _half(bit: str, first: int, last: int) -> str:
    return f"CAST(list_sum([CASE WHEN {bit} THEN CAST(1 AS BIGINT) << CAST({31 + first} - i AS BIGINT) ELSE 0 END FOR i IN range({first}, {last + 1})]) AS BIGINT)"


_H = f"""
e AS MATERIALIZED (SELECT vec_id, v, (o[32] + o[33]) / 2 AS med FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_sort(CAST(embedding AS DOUBLE[])) AS o FROM embeddings)),
h AS MATERIALIZED (SELECT vec_id, {_half('v[i] > 0', 1, 32)} AS ph_hi, {_half('v[i] > 0', 33, 64)} AS ph_lo, {_half('v[i] < v[i + 1]', 1, 32)} AS dh_hi, {_half('v[i] < v[i + 1]', 33, 63)} AS dh_lo,
  {_half('v[i] > med', 1, 32)} AS wh_hi, {_half('v[i] > med', 33, 64)} AS wh_lo FROM e)
"""
_D = ", ".join(f"bit_count(xor(a.{n}_hi, b.{n}_hi)) + bit_count(xor(a.{n}_lo, b.{n}_lo)) AS {n}_d" for n in ("ph", "dh", "wh"))
_P = f"""{_H},
d AS MATERIALIZED (SELECT a.vec_id AS l, b.vec_id AS r, {_D} FROM h a JOIN h b ON a.vec_id < b.vec_id),
p AS MATERIALIZED (SELECT *, (ph_d <= 20)::INT + (dh_d <= 18)::INT + (wh_d <= 20)::INT AS votes FROM d WHERE (ph_d <= 20)::INT + (dh_d <= 18)::INT + (wh_d <= 20)::INT >= 2),
q AS MATERIALIZED (SELECT *, (greatest(0::DOUBLE, 1::DOUBLE - ph_d / 20::DOUBLE) + greatest(0::DOUBLE, 1::DOUBLE - dh_d / 18::DOUBLE) + greatest(0::DOUBLE, 1::DOUBLE - wh_d / 20::DOUBLE)) / 3::DOUBLE AS conf FROM p)
"""
_WORD = "CAST('0x' || substr(md5({0}), {1}, 8) AS BIGINT)"
_ORDER_HASHES = ", ".join(
    f"xor({_WORD.format(f"'{n}{side}c' || o_custkey", 1)}, {' & '.join(_WORD.format(f"'{n}{side}' || o_orderkey", 8 * k + 1) for k in range(4))}) AS {n}_{side}" for n in HASHES for side in ("hi", "lo")
)
_BEST = """best AS MATERIALIZED (SELECT r, l AS match_id, votes, round(70::DOUBLE + conf * 30::DOUBLE, 2) AS similarity FROM {0} QUALIFY row_number() OVER (PARTITION BY r ORDER BY votes DESC, conf DESC, l) = 1)"""
_REG = """
nb AS MATERIALIZED (SELECT vec_id, rn, coalesce(list(l) FILTER (WHERE l IS NOT NULL), CAST([] AS BIGINT[])) AS ns FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM h) o LEFT JOIN p ON p.r = o.vec_id GROUP BY vec_id, rn),
walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS reg UNION ALL
  SELECT nb.rn, CASE WHEN list_has_any(walk.reg, nb.ns) THEN walk.reg ELSE list_append(walk.reg, nb.vec_id) END FROM walk JOIN nb ON nb.rn = walk.rn + 1),
done AS MATERIALIZED (SELECT unnest(reg) AS vec_id FROM (SELECT reg FROM walk ORDER BY rn DESC LIMIT 1))
"""
_ROOTS = """up AS (SELECT r, match_id AS root FROM best UNION ALL SELECT up.r, best.match_id FROM up JOIN best ON best.r = up.root),
roots AS (SELECT r, min(root) AS root FROM up GROUP BY r)"""
_COS = f"""{_P},
c AS MATERIALIZED (SELECT a.vec_id AS l, b.vec_id AS r, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)), 6) AS cos FROM e a JOIN e b ON a.vec_id < b.vec_id),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY r ORDER BY cos DESC, l) <= 100),
t AS MATERIALIZED (SELECT k.*, row_number() OVER (PARTITION BY r ORDER BY cos DESC, l) AS place FROM k JOIN embeddings m ON m.vec_id = k.l AND m.label <> 3 WHERE cos >= 0.25::DOUBLE)
"""

#: Each row's first candidate with all of its votes.
_FIRST = """f AS MATERIALIZED (SELECT t.r AS vec_id, t.l AS match_id, cos, (ph_d <= 20)::INT + (dh_d <= 18)::INT + (wh_d <= 20)::INT AS votes,
  CASE WHEN cos >= 0.45::DOUBLE OR cos >= 0.35::DOUBLE AND (ph_d <= 20 OR dh_d <= 18 OR wh_d <= 20) THEN 'CLIP Semantic' END AS method FROM t JOIN d ON d.l = t.l AND d.r = t.r WHERE place = 1)"""
_BEST_D = _BEST.format("q").replace("AS similarity FROM", "AS similarity, ph_d, dh_d, wh_d FROM")

ORACLE = {
    "exact_dup_md5": "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS first_id, doc_id <> first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS is_duplicate FROM documents",
    "dup_status_kpi": "WITH s AS (SELECT CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 THEN 'Duplicate' ELSE 'Valid' END AS status FROM documents) SELECT status, count(*) AS n, round(count(*) * 100::DOUBLE / (SELECT count(*) FROM s), 1) AS pct FROM s GROUP BY status",
    "sign_hash": f"WITH {_H} SELECT * FROM h",
    "hash_vote_pairs": f"WITH {_P} SELECT l, r, ph_d, dh_d, wh_d, votes FROM p",
    "hash_vote_bands": f"""WITH h AS MATERIALIZED (SELECT o_orderkey AS vec_id, {_ORDER_HASHES} FROM orders),
      d AS (SELECT a.vec_id AS l, b.vec_id AS r, {_D} FROM h a JOIN h b ON a.vec_id < b.vec_id)
      SELECT l, r, ph_d, dh_d, wh_d, (ph_d <= 6)::INT + (dh_d <= 8)::INT + (wh_d <= 5)::INT AS votes FROM d WHERE (ph_d <= 6)::INT + (dh_d <= 8)::INT + (wh_d <= 5)::INT >= 2""",
    "hash_best_match": f"WITH {_P}, {_BEST.format('q')} SELECT * FROM best",
    "registered_rows": f"WITH RECURSIVE {_P}, {_REG} SELECT vec_id FROM done",
    "hash_duplicates": f"WITH RECURSIVE {_P}, {_REG}, {_BEST.format('(SELECT q.* FROM q JOIN done ON done.vec_id = q.l)')} SELECT r AS vec_id, match_id, votes, similarity FROM best",
    "cosine_topk": f"WITH {_COS} SELECT r, l, cos, place FROM t WHERE place <= 24",
    "cosine_decision": f"""WITH {_COS}, {_FIRST} SELECT vec_id, match_id, round(cos * 100, 2) AS similarity, votes, method FROM f WHERE method IS NOT NULL""",
    "first_candidates": f"""WITH {_COS}, {_FIRST} SELECT vec_id, match_id, cos, votes, method FROM f""",
    "dup_decision": f"""WITH {_COS}, {_FIRST}, {_BEST_D},
      x AS (SELECT vec_id, 0 AS rank, vec_id - 1 AS match_id, 'Exact Duplicate' AS status, 100::DOUBLE AS similarity, 1 AS layer, 'MD5 fingerprint matched a recent/current-batch image.' AS reason FROM embeddings WHERE vec_id % 10 = 1
        UNION ALL SELECT r, 1, match_id, 'Perceptual Duplicate', similarity, 1, printf('Hash votes=%d/3 (pHash=%d, dHash=%d, wHash=%d).', votes, ph_d, dh_d, wh_d) FROM best
        UNION ALL SELECT vec_id, 2, match_id, method, round(cos * 100, 2), 3, printf('%s: score=%.3f, support=%d.', method, cos, votes) FROM f WHERE method IS NOT NULL)
      SELECT vec_id, match_id, status, similarity, CAST(layer AS INTEGER) AS layer, reason FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY rank) = 1""",
    "cluster_roots": f"WITH RECURSIVE {_P}, {_BEST.format('q')}, {_ROOTS} SELECT r AS vec_id, root AS cluster_id FROM roots",
    "cluster_report": f"""WITH RECURSIVE {_P}, {_BEST.format('q')}, {_ROOTS} SELECT root AS cluster_id, best.r AS duplicate_id, best.match_id AS original_id, CASE WHEN o.r IS NULL THEN 'Valid' ELSE 'Duplicate' END AS original_status,
      'Perceptual Duplicate' AS match_type, best.similarity FROM best JOIN roots ON roots.r = best.r LEFT JOIN best o ON o.r = best.match_id""",
}

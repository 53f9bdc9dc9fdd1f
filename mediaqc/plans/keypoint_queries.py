"""Key points derived from order lines, matched geometrically, and the same in plain SQL that compares all with all.

Every 25 orders are an image; a second one shows it turned, with a few bits of each descriptor changed, and in every other
image two points of five replaced. Each image is compared with its own second one and with its neighbour's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaqc.operators import duplicates, keypoints

#: Images of the second kind have numbers from here on.
SECOND = 1_000_000

#: Both engines read these: base columns of a line, and those of its point in either image.
_BASE = f"""l_orderkey // 25 AS g, l_orderkey * 10 + l_linenumber AS kp, CAST((l_orderkey * 37 + l_linenumber * 101) % 640 AS DOUBLE) AS x, CAST((l_orderkey * 53 + l_linenumber * 29) % 480 AS DOUBLE) AS y,
  CAST((l_orderkey * 13 + l_linenumber * 47) % 360 AS DOUBLE) AS angle, sha256(concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR))) AS d, sha256(concat('n', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR))) AS e,
  (l_orderkey // 25) % 2 = 0 AND (l_orderkey + l_linenumber) % 5 >= 3 AS other, CAST((l_orderkey // 25) * 17 % 360 AS DOUBLE) AS turn"""
_TURNED = f"""g + {SECOND} AS image, kp, x * cos(radians(turn)) - y * sin(radians(turn)) + 40 AS x, x * sin(radians(turn)) + y * cos(radians(turn)) + 25 AS y,
  CASE WHEN angle + turn >= 360 THEN angle + turn - 360 ELSE angle + turn END AS angle, CAST(31 AS DOUBLE) AS size, CASE WHEN other THEN e ELSE d END AS d, 5 + kp % 3 AS flip"""


def _spark(sql: str) -> str:
    return sql.replace("l_orderkey // 25", "l_orderkey div 25").replace("VARCHAR", "STRING").replace("sha256(", "sha2_256(").replace("sha2_256(concat(", "sha2(concat(").replace("))) AS d", ")), 256) AS d").replace("))) AS e", ")), 256) AS e")


def points(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    base = lines.selectExpr(*_split(_spark(_BASE)))
    own = base.selectExpr("g AS image", "kp", "x", "y", "angle", "CAST(31 AS DOUBLE) AS size", "d", "0 AS flip")
    both = own.unionByName(base.selectExpr(*_split(_spark(_TURNED))))
    words = [F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("long") for k in range(keypoints.WORDS)]
    words[0] = words[0].bitwiseXOR(F.col("flip").cast("long"))
    return both.select("image", "kp", "x", "y", "angle", "size", F.array(*words).alias("words"))


def _split(sql: str) -> list[str]:
    """The columns of a select list: commas outside of brackets part them."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(sql[start:k])
            start = k + 1
    return [*out, sql[start:]]


def keypoint_matches(spark, d):
    p = points(spark, d)
    images = p.where(F.col("image") < SECOND).select(F.col("image").alias("l")).distinct()
    pairs = images.select("l", F.explode(F.array(F.col("l") + SECOND, F.col("l") + SECOND + 1)).alias("r"))
    found = keypoints.compared(pairs, p)
    dup, score = duplicates.keypoint_decision()
    return found.withColumns({"is_duplicate": dup, "score": F.round(score, 9)})


QUERIES = {"keypoint_matches": keypoint_matches}

_WORD = lambda k: f"CAST(concat('0x', substr(d, {8 * k + 1}, 8)) AS BIGINT)"
_BITS = " + ".join(f"CAST(bit_count(xor(a.w[{k}], b.w[{k}])) AS INTEGER)" for k in range(1, keypoints.WORDS + 1))
_TWO = lambda value: f"unnest([CAST(floor({value} - 0.5) AS BIGINT), CAST(floor({value} - 0.5) AS BIGINT) + 1])"

ORACLE = {
    "keypoint_matches": f"""
WITH base AS (SELECT {_BASE} FROM lineitem),
raw AS (SELECT g AS image, kp, x, y, angle, CAST(31 AS DOUBLE) AS size, d, 0 AS flip FROM base UNION ALL SELECT {_TURNED} FROM base),
p AS MATERIALIZED (SELECT image, kp, x, y, angle, size, [xor({_WORD(0)}, flip), {", ".join(_WORD(k) for k in range(1, keypoints.WORDS))}] AS w FROM raw),
pr AS MATERIALIZED (SELECT DISTINCT image AS l, image + {SECOND} + o AS r FROM p, (SELECT unnest([0, 1]) AS o) WHERE image < {SECOND}),
near AS MATERIALIZED (SELECT l, r, a.kp AS ka, b.kp AS kb, a.x, a.y, b.x AS u, b.y AS v, b.angle - a.angle AS t, b.size / a.size AS s, {_BITS} AS bits FROM pr JOIN p a ON a.image = l JOIN p b ON b.image = r WHERE {_BITS} <= 31),
lot AS (SELECT *, row_number() OVER w AS lot, lead(bits) OVER w AS second FROM near WINDOW w AS (PARTITION BY l, r, ka ORDER BY bits, kb)),
good AS MATERIALIZED (SELECT *, CASE WHEN t < 0 THEN t + 360 ELSE t END AS turned FROM lot WHERE lot = 1 AND bits < 0.75::DOUBLE * coalesce(second, 32)),
moved AS (SELECT *, u - (s * cos(radians(turned)) * x - s * sin(radians(turned)) * y) AS mu, v - (s * sin(radians(turned)) * x + s * cos(radians(turned)) * y) AS mv FROM good),
v1 AS (SELECT *, {_TWO('turned / 30')} AS turn_bin FROM moved), v2 AS (SELECT *, {_TWO('log2(s)')} AS octave FROM v1), v3 AS (SELECT *, {_TWO('mu / 64')} AS cu FROM v2),
votes AS MATERIALIZED (SELECT * REPLACE ((turn_bin + 12) % 12 AS turn_bin), {_TWO('mv / 64')} AS cv FROM v3),
c AS (SELECT l, r, turn_bin, octave, cu, cv, count(*) AS n FROM votes GROUP BY ALL),
w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l, r ORDER BY n DESC, turn_bin, octave, cu, cv) = 1),
s AS (SELECT l, r, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(u) AS su, sum(v) AS sv, sum(x * u + y * v) AS dt, sum(x * v - y * u) AS cr, sum(x * x + y * y) AS sq FROM votes JOIN w USING (l, r, turn_bin, octave, cu, cv) GROUP BY l, r),
ab AS (SELECT *, (dt - (sx * su + sy * sv) / n) / (sq - (sx * sx + sy * sy) / n) AS re, (cr - (sx * sv - sy * su) / n) / (sq - (sx * sx + sy * sy) / n) AS im FROM s WHERE sq - (sx * sx + sy * sy) / n > 1e-9),
pose AS (SELECT l, r, re, im, (su - (re * sx - im * sy)) / n AS du, (sv - (im * sx + re * sy)) / n AS dv FROM ab),
f AS (SELECT l, r, count(*) AS good, count(*) FILTER (WHERE sqrt((re * x - im * y + du - u) ** 2 + (im * x + re * y + dv - v) ** 2) <= 10) AS inliers FROM good LEFT JOIN pose USING (l, r) GROUP BY l, r),
n AS (SELECT image, count(*) AS kps FROM p GROUP BY image),
o AS (SELECT pr.l, pr.r, coalesce(na.kps, 0) AS kp_a, coalesce(nb.kps, 0) AS kp_b, coalesce(good, 0) AS good, coalesce(inliers, 0) AS inliers FROM pr LEFT JOIN n na ON na.image = pr.l LEFT JOIN n nb ON nb.image = pr.r LEFT JOIN f ON f.l = pr.l AND f.r = pr.r)
SELECT *, kp_a >= 8 AND kp_b >= 8 AND good >= 30 AND inliers >= 26 AND inliers::DOUBLE / good::DOUBLE >= 0.46::DOUBLE AS is_duplicate,
  round(CASE WHEN kp_a >= 8 AND kp_b >= 8 AND good >= 30 THEN least(2::DOUBLE * inliers / greatest(kp_a, kp_b, 1), 1::DOUBLE) ELSE 0::DOUBLE END, 9) AS score FROM o"""
}

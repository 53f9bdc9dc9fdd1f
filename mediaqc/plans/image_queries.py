"""Queries of the transforms and frames over the 8 x 8 grids that the embeddings of the driver tables stand for, and the
same in plain SQL: there, sums over cells joined with the basis, the median of plain differences, recursive regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaqc.functions import transforms
from mediaqc.functions.hashing import transform_hashes
from mediaqc.operators.frames import frames

#: Gradients between cells of random grids are steeper than those between pixels.
LOW, HIGH = 330, 600


def _grids(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def transform_hash(spark, d):
    return _grids(spark, d).select("vec_id", *[x.alias(n) for n, x in transform_hashes(F.col("embedding")).items()])


def recompression(spark, d):
    """Error of recompression at three qualities."""
    levels = _grids(spark, d).select("vec_id", transforms.grey_levels(F.col("embedding")).alias("levels"))
    return levels.select("vec_id", *[F.round(transforms.recompression_error(F.col("levels"), q), 9).alias(f"ela_{q}") for q in (90, 75, 40)])


def device_frames(spark, d):
    grids = _grids(spark, d).select(F.col("vec_id").alias("id"), transforms.grey_levels(F.col("embedding")).alias("levels"))
    found = frames(grids, low=LOW, high=HIGH)
    return found.select(F.col("id").alias("vec_id"), "has_bezel", F.round("bezel_score", 9).alias("bezel_score"), "regions")


QUERIES = {f.__name__: f for f in (transform_hash, recompression, device_frames)}

_CELLS = """i AS (SELECT unnest(range(0, 64)) AS cell),
g AS MATERIALIZED (SELECT vec_id, cell, cell // 8 AS r, cell % 8 AS k, CAST(embedding[cell + 1] AS DOUBLE) AS x FROM embeddings, i)"""
_LEVELS = f"""{_CELLS},
m AS (SELECT vec_id, min(x) AS low, max(x) AS high FROM g GROUP BY vec_id),
y AS MATERIALIZED (SELECT vec_id, cell, r, k, CASE WHEN high > low THEN CAST(floor((x - low) / (high - low) * 255::DOUBLE) AS INT) ELSE 0 END AS y FROM g JOIN m USING (vec_id))"""


def _ela(quality: int) -> str:
    table = ", ".join(str(q) for row in transforms.quantisers(quality) for q in row)
    return f"""c{quality} AS (SELECT vec_id, u, v, floor(c / ([{table}])[u * 8 + v + 1] + 0.5::DOUBLE) * ([{table}])[u * 8 + v + 1] AS c FROM dct),
z{quality} AS (SELECT vec_id, u.t * 8 + v.t AS cell, greatest(least(floor(round(sum(c * u.w * v.w), 9) + 128::DOUBLE + 0.5::DOUBLE), 255), 0) AS z FROM c{quality} c JOIN b u ON u.u = c.u JOIN b v ON v.u = c.v GROUP BY ALL),
e{quality} AS (SELECT vec_id, round(sum(abs(y - z)) / (64 * 255::DOUBLE), 9) AS ela_{quality} FROM y JOIN z{quality} USING (vec_id, cell) GROUP BY vec_id)"""


def _word(name: str, first: int) -> str:
    return f"CAST(sum(CASE WHEN cell BETWEEN {first} AND {first + 31} AND {name} > {name}_median THEN CAST(1 AS BIGINT) << CAST({31 + first} - cell AS BIGINT) ELSE 0 END) AS BIGINT) AS {name}_{'lo' if first else 'hi'}"


_B = "SELECT CAST(u AS INT) AS u, CAST(t AS INT) AS t, {0}cos((2 * t + 1) * u * pi() / 16) AS w FROM (SELECT unnest(range(0, 8)) AS u) uu, (SELECT unnest(range(0, 8)) AS t) tt"
_AT = "list_extract(a, CAST(greatest(least(cell // 8 + {0}, 7), 0) * 8 + greatest(least(cell % 8 + {1}, 7), 0) + 1 AS INT))"


def _slope(places: list[tuple[int, int, int]]) -> str:
    return "abs(" + " + ".join(f"({w}) * {_AT.format(r, k)}" for r, k, w in places) + ")"


_ACROSS = _slope([(d, s, s * (2 if d == 0 else 1)) for d in (-1, 0, 1) for s in (-1, 1)])
_DOWN = _slope([(s, d, s * (2 if d == 0 else 1)) for d in (-1, 0, 1) for s in (-1, 1)])

ORACLE = {
    "transform_hash": f"""WITH {_CELLS}, b AS MATERIALIZED ({_B.format('')}),
      p AS (SELECT vec_id, u.u * 8 + v.u AS cell, round(sum(x * u.w * v.w), 9) AS ph FROM g JOIN b u ON u.t = r JOIN b v ON v.t = k GROUP BY ALL),
      w AS (SELECT vec_id, cell, round(x - avg(x) OVER (PARTITION BY vec_id), 9) AS wh FROM g),
      a AS (SELECT vec_id, cell, ph, wh, median(ph) OVER (PARTITION BY vec_id) AS ph_median, median(wh) OVER (PARTITION BY vec_id) AS wh_median FROM p JOIN w USING (vec_id, cell))
      SELECT vec_id, {_word('ph', 0)}, {_word('ph', 32)}, {_word('wh', 0)}, {_word('wh', 32)} FROM a GROUP BY vec_id""",
    "recompression": f"""WITH {_LEVELS}, b AS MATERIALIZED ({_B.format("CASE WHEN u = 0 THEN sqrt(1 / 8::DOUBLE) ELSE sqrt(2 / 8::DOUBLE) END * ")}),
      dct AS MATERIALIZED (SELECT vec_id, u.u AS u, v.u AS v, round(sum((y - 128) * u.w * v.w), 9) AS c FROM y JOIN b u ON u.t = r JOIN b v ON v.t = k GROUP BY ALL), {_ela(90)}, {_ela(75)}, {_ela(40)}
      SELECT vec_id, ela_90, ela_75, ela_40 FROM e90 JOIN e75 USING (vec_id) JOIN e40 USING (vec_id)""",
    "device_frames": f"""WITH RECURSIVE {_LEVELS}, l AS (SELECT vec_id, list(y ORDER BY cell) AS a FROM y GROUP BY vec_id),
      s AS (SELECT vec_id, cell, {_ACROSS} + {_DOWN} AS s FROM l, i),
      c AS MATERIALIZED (SELECT vec_id, cell, s, cell // 8 AS r, cell % 8 AS k FROM s WHERE s >= {LOW}),
      near AS MATERIALIZED (SELECT a.vec_id, a.cell, n.cell AS other FROM c a JOIN c n ON n.vec_id = a.vec_id AND n.cell <> a.cell AND abs(n.r - a.r) <= 1 AND abs(n.k - a.k) <= 1),
      reach AS (SELECT vec_id, cell, cell AS root FROM c UNION SELECT near.vec_id, other, root FROM reach JOIN near ON near.vec_id = reach.vec_id AND near.cell = reach.cell),
      lab AS (SELECT vec_id, cell, min(root) AS root FROM reach GROUP BY ALL),
      rw AS MATERIALIZED (SELECT vec_id, root, r, min(k) AS lo, max(k) AS hi, max(s) AS s, count(*) AS n FROM lab JOIN c USING (vec_id, cell) GROUP BY vec_id, root, r),
      q AS (SELECT vec_id, root, sum(hi - lo) - (min_by(hi - lo, r) + max_by(hi - lo, r)) / 2::DOUBLE AS area, max(r) - min(r) + 1 AS height, max(hi) - min(lo) + 1 AS width, max(s) AS s, sum(n) AS n,
        min((r + lo) * 8 + r) AS a, min((r - hi + 8) * 8 + r) AS b, max((r + hi) * 8 + r) AS c, max((r - lo + 8) * 8 + r) AS d FROM rw GROUP BY vec_id, root),
      co AS (SELECT *, a % 8 AS ar, a // 8 - a % 8 AS ak, b % 8 AS br, 8 + b % 8 - b // 8 AS bk, c % 8 AS cr, c // 8 - c % 8 AS ck, d % 8 AS dr, 8 + d % 8 - d // 8 AS dk FROM q WHERE s >= {HIGH} AND n >= 2),
      f AS (SELECT *, abs(ar * bk - br * ak + br * ck - cr * bk + cr * dk - dr * ck + dr * ak - ar * dk) / 2::DOUBLE AS quad FROM co),
      t AS (SELECT vec_id, count(*) AS n, max(CASE WHEN area > 0.3::DOUBLE * 64 AND abs(quad - area) <= 0.1::DOUBLE * area AND width / height::DOUBLE > 0.3::DOUBLE AND width / height::DOUBLE < 3 THEN least(area / 64, 1) END) AS best FROM f GROUP BY vec_id)
      SELECT e.vec_id, best IS NOT NULL AS has_bezel, round(coalesce(best, 0::DOUBLE), 9) AS bezel_score, coalesce(n, 0) AS regions FROM embeddings e LEFT JOIN t ON t.vec_id = e.vec_id""",
}

"""Exact top-k search by integer inner product: statistics of segments, coarse to fine, prune; survivors are scored exactly.

Each component x becomes floor(256 * x). A segment of L components has a mean m and a deviation s; for two vectors the
squared distance is at least the sum of L * ((m - m')^2 + (s - s')^2) over the segments, which is to say that the inner
product is at most the sum of L * (m * m' + s * s'). Segments of ``LENGTHS`` components, coarse to fine, are tried in
turn; what a bound leaves below a query's k-th best score so far goes, the rest is scored exactly. A bound never removes
a row that ties with the k-th best.

Spark deals rows and queries to blocks by a hash; each block of queries meets each block of rows in one cell of a grid, a
task of bounded size, and only the k best rows of a query go on from there. Rows of equal vectors are one row with their k
+ 1 smallest ids. The queries first search one block; what they find there bounds them in all others.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no part;
vectors of equal length alone meet, those of length 0 with a score of 0; rows repeated whole count once; an id with several
vectors is several queries, and rows that share the query's id are not its candidates; ties go to the smaller id; with
fewer candidates than asked for all are returned; scores beyond a long are the nearest long; a table without queries or
rows gives an empty table; columns of any other names are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaqc.llm.common import cut, forget

#: Components of a segment, coarse to fine.
LENGTHS = (16, 4, 2)
#: Rows and queries of a cell, about, and queries of a tile inside.
ROWS, LEAST_ROWS, QUERIES, TILE = 16_384, 1_024, 2_048, 128
#: Pairs that are scored one by one at once, and the share of a tile beyond which a matrix product scores it.
PAIRS, DENSE = 1 << 15, 1 / 16
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
MOST = float(np.finfo(np.float64).max)
LONG = (1 << 63) - 1


def prepared(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of all rows that take part, each once; vec holds whole numbers as doubles."""
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    finite = raw.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    large = lambda x: F.least(F.greatest(x * 256, F.lit(-MOST)), F.lit(MOST))  # noqa: E731  whole as it is
    whole = F.transform("vec", lambda x: F.when(F.abs(x) >= float(1 << 45), large(x)).otherwise(F.floor(x * 256).cast("double")))
    return finite.select("id", whole.alias("vec")).dropDuplicates()


def collapsed(rows: DataFrame, k: int) -> DataFrame:
    """(ids, vec): a row for each different vector with its k + 1 smallest ids. A group is limited in each task before the shuffle."""
    lot = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("lot", lot).where(F.col("lot") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def segments(m: np.ndarray, length: int) -> np.ndarray:
    """Means and deviations of the segments of each row, weighted so that products of rows are the bounds. ``m`` is whole numbers."""
    starts = np.arange(0, m.shape[1], length)
    n = np.diff(np.append(starts, m.shape[1])).astype(float)
    total, squares = np.add.reduceat(m, starts, axis=1), np.add.reduceat(m * m, starts, axis=1)
    spread = np.maximum(n * squares - total * total, 0.0)  # n squared times the variance, exact
    return np.hstack([total / np.sqrt(n), np.sqrt(spread / n)])


def scored(q: np.ndarray, v: np.ndarray, keep: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact products of the pairs (i, j) that ``keep`` marks."""
    if len(i) > DENSE * keep.size:
        return (q @ v.T)[i, j]
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        p = slice(at, at + PAIRS)
        out[p] = np.einsum("ij,ij->i", q[i[p]], v[j[p]])
    return out


def nearest(q: np.ndarray, q_ids: np.ndarray, bars: np.ndarray, v: np.ndarray, first: np.ndarray, second: np.ndarray, k: int):
    """Of each query the k best rows: (query, row, score, pairs and those that the bounds left). ``first`` and ``second`` are a row's smallest ids.

    ``q`` and ``v`` are so small that sums of products are exact in doubles.
    """
    d = q.shape[1]
    levels = [(segments(q, n), segments(v, n)) for n in LENGTHS if n <= d or n == LENGTHS[-1]] if d else []
    size = np.sqrt((v * v).sum(axis=1))
    for at in range(0, len(q), TILE):
        part, ids = q[at : at + TILE], q_ids[at : at + TILE]
        mine = first[None, :] == ids[:, None]
        least = np.where(mine, second[None, :], first[None, :])  # a row's smallest id that is not the query's
        keep = least != LONG
        tried = int(keep.sum())
        bar = bars[at : at + TILE]
        slack = 1e-9 * np.sqrt((part * part).sum(axis=1))[:, None] * size[None, :] + 1e-3
        for n, (sq, sv) in enumerate(levels):
            bound = sq[at : at + TILE] @ sv.T + slack
            bound[~keep] = -np.inf
            if n == 0 and len(v) > k:  # the best k by bound, scored, raise the bar
                top = np.argpartition(bound, -k, axis=1)[:, -k:]
                s = np.einsum("ij,ikj->ik", part, v[top])
                s[~np.take_along_axis(keep, top, axis=1)] = -np.inf
                bar = np.maximum(bar, s.min(axis=1))
            keep &= bound >= bar[:, None]
        i, j = np.nonzero(keep)
        s = scored(part, v, keep, i, j)
        order = np.lexsort((least[i, j], -s, i))
        i, j, s = i[order], j[order], s[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield at + i[best], j[best], s[best].astype(np.int64), tried, len(i)


def one_by_one(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, first: np.ndarray, second: np.ndarray, k: int):
    """The same in whole numbers of any size."""
    rows = [[int(y) for y in x] for x in v.tolist()]
    for a, x in enumerate(q.tolist()):
        x = [int(y) for y in x]
        least = np.where(first == q_ids[a], second, first)
        found = [(sum(y * z for y, z in zip(x, row, strict=True)), -int(least[b]), b) for b, row in enumerate(rows) if least[b] != LONG]
        best = sorted(((max(-LONG - 1, min(LONG, s)), n, b) for s, n, b in found), reverse=True)[:k]
        yield np.full(len(best), a), np.array([b for _, _, b in best], np.int64), np.array([s for s, _, _ in best], np.int64), len(found), len(found)


def searched(q: np.ndarray, q_ids: np.ndarray, bars: np.ndarray, v: np.ndarray, first: np.ndarray, second: np.ndarray, k: int):
    """``nearest`` for the pairs whose products are exact in doubles, ``one_by_one`` for those with a larger component."""
    limit = (EXACT / max(q.shape[1], 1)) ** 0.5
    small_q, small_v = (np.flatnonzero(np.abs(x).max(axis=1, initial=0.0) < limit) for x in (q, v))
    large_q, large_v = (np.flatnonzero(np.abs(x).max(axis=1, initial=0.0) >= limit) for x in (q, v))
    every = np.arange(len(v))
    for i, j, s, tried, left in nearest(q[small_q], q_ids[small_q], bars[small_q], v[small_v], first[small_v], second[small_v], k):
        yield small_q[i], small_v[j], s, tried, left
    for qs, vs in ((large_q, every), (small_q, large_v)):
        if len(qs) and len(vs):
            for i, j, s, tried, left in one_by_one(q[qs], q_ids[qs], v[vs], first[vs], second[vs], k):
                yield qs[i], vs[j], s, tried, left


def _blocks(n: int, tasks: int, most: int, least: int) -> int:
    """Blocks of about ``most`` of n rows; more, of at least ``least`` rows, where tasks would have nothing to do."""
    return max(1, -(-n // most), min(-(-n // least), tasks))


def _block(n: int, *columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    return a.flatten().to_numpy().reshape(len(a), -1) if len(a) else np.empty((0, 0))


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the second id of each list, LONG for none."""
    a = column.combine_chunks()
    offsets, values = a.offsets.to_numpy(), a.values.to_numpy()
    one = values[offsets[:-1]]
    more = np.diff(offsets) > 1
    two = np.full(len(one), LONG)
    two[more] = values[offsets[:-1][more] + 1]
    return one, two


def cells(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, score, ids, tried, left) of the k best rows of each query in each cell, and what the bounds left of its tile."""
    schema = "query long, score long, ids array<long>, tried long, left long"

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            q, v = _matrix(left["vec"]), _matrix(right["vec"])
            number, q_ids, bars = left["query"].to_numpy(), left["id"].to_numpy(), left["bar"].to_numpy()
            lists = right["ids"].combine_chunks()
            for i, j, s, tried, rest in searched(q, q_ids, bars, v, *_ids(right["ids"]), k):
                once = np.zeros(len(i), np.int64)
                once[:1] = 1  # the figures of a tile stand at its first row
                found.append(pa.Table.from_arrays([pa.array(number[i]), pa.array(s), lists.take(pa.array(j)), pa.array(once * tried), pa.array(once * rest)], names=["query", "score", "ids", "tried", "left"]))
        return pa.concat_tables(found) if found else pa.Table.from_pylist([], pa.schema([("query", pa.int64()), ("score", pa.int64()), ("ids", pa.list_(pa.int64())), ("tried", pa.int64()), ("left", pa.int64())]))

    key = ["width", "q_block", "r_block"]
    return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(run, schema)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", with_work: bool = False) -> DataFrame:
    """(query_id, rank, id, score) of the rows for which ``queries``, a condition on ``id``, holds, against all rows.

    ``with_work`` returns (tried, left) instead: pairs that met, and those that no bound removed.
    """
    plain = cut(prepared(vectors, id_col, vec_col), "vectors")
    rows = cut(collapsed(plain, k), "distinct")
    asked = cut(plain.where(queries).select(F.monotonically_increasing_id().alias("query"), "id", "vec"), "queries")
    n_rows, n_queries = rows.count(), asked.count()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q_blocks = _blocks(n_queries, 1, QUERIES, QUERIES)
    r_blocks = _blocks(n_rows, -(-tasks // q_blocks), ROWS, LEAST_ROWS)
    width = F.size("vec").alias("width")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select("ids", "vec", width, _block(r_blocks, "vec").alias("r_block")).withColumn("q_block", each(q_blocks))
    dealt = asked.select("query", "id", "vec", width, _block(q_blocks, "query").alias("q_block"))
    # one block for all queries: the k-th best there is a bar for the others
    opened = cells(dealt.withColumn("bar", F.lit(float("-inf"))).withColumn("r_block", F.lit(0)), held.where("r_block = 0"), k)
    bars = opened.groupBy("query").agg(F.min("score").cast("double").alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query", "bar")
    bars = cut(bars, "bars")
    barred = dealt.join(bars, "query", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf")))).withColumn("r_block", each(r_blocks))
    found = cut(cells(barred, held, k), "found")
    if with_work:
        return found.agg(F.sum("tried").alias("tried"), F.sum("left").alias("left"))
    named = found.join(asked.select("query", F.col("id").alias("query_id")), "query").withColumn("id", F.explode("ids")).where("id <> query_id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = named.select("query", "query_id", "id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    forget(plain, rows, bars)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
),
o AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""

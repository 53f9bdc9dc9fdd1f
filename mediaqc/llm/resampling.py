"""Importance resampling of documents towards a target: hashed n-grams weigh a document, Gumbel noise draws without replacement.

An integer word dictionary makes the features: the distinct words of a portion of documents (``PORTION`` bytes of text, or
one longer text) get ids, an n-gram is a tuple of ids, the bytes of each distinct tuple are put together and hashed once, and
the buckets are joined back by position. Each document's buckets are then stored once, 14 bits a feature; corpus counts and
weights are read from that table. Portions are not joined to one dictionary of the corpus: on 0.5 GB more than half of all
pairs of words are rare, so such a table and the way back to the documents would move more than the texts themselves, for
the same buckets.

The ``BUCKETS`` counts of source and target are sums over all rows; their gains, a table of fixed size, go to all tasks. Scores
are ranked by a range sort: a row's rank is its place in its partition and what earlier partitions hold.

Defined results: null texts and texts without words have no features and a weight of 0; texts of any length are read whole;
a null id is hashed as an empty one and comes last among ties; repeated rows are documents of their own, each drawn or not;
an empty table gives an empty table; without target texts all buckets gain by the source alone; columns of any other names
are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaqc.llm.common import cut, documents, forget, text_of

BUCKETS = 10_000
SEED, LEAST_WORDS, SHARE = 7, 20, 25
#: Bytes of text whose words share a dictionary.
PORTION = 8 << 20
#: A-Z become small, other ASCII characters but letters and digits become spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def portions(batches: Iterator[pa.RecordBatch], text_at: int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` bytes of text; at the end the worker gives back what Arrow held."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(text_at)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of some texts, one text after another, and the number of words of each."""
    ids: dict[bytes, int] = {}
    counts, flat = np.empty(len(texts), np.int64), []
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()
        counts[k] = len(words)
        flat.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
    ids_of = np.concatenate(flat) if flat else np.empty(0, np.int64)
    words = list(ids)
    out = np.zeros((len(ids_of), 2), np.int16)  # a word, and the pair that it begins
    keep = np.ones((len(ids_of), 2), bool)
    if len(ids_of):
        out[:, 0] = np.array([crc32(w) % BUCKETS for w in words], np.int16)[ids_of]
        keep[np.cumsum(counts)[counts > 0] - 1, 1] = False  # the last word of a text begins none
        begins = np.flatnonzero(keep[:, 1])
        pairs, places = np.unique(ids_of[begins] << 32 | ids_of[begins + 1], return_inverse=True)
        hashed = [crc32(words[a] + b" " + words[b]) % BUCKETS for a, b in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True)]
        out[begins, 1] = np.array(hashed, np.int16)[places]
    return out[keep], counts


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, buckets) of each row."""
    slim = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, 1):
            flat, counts = features(part.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(np.maximum(2 * counts - 1, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "n_words", "buckets"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, n_words long, buckets array<smallint>")


def totals(rows: DataFrame) -> np.ndarray:
    """How often each bucket stands in ``rows``: a table of at most BUCKETS rows is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight, in thousandths."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, the same for an id on each run."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(rows: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of the rows of ``hashed``."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(shared.value[lists.flatten().to_numpy()])])
            n, total = np.diff(ends), upto[ends[1:] - ends[0]] - upto[ends[:-1] - ends[0]]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = weight + np.fromiter((noise(i, seed) for i in batch.column(0).to_pylist()), np.int64, len(weight))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight), pa.array(score)], names=["id", "n_words", "n_features", "weight", "score"])
        pa.default_memory_pool().release_unused()

    return rows.select("id", "n_words", "buckets").mapInArrow(run, f"id {id_type}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (score, id and others) with ``rank``, from 1, by falling score, then id (null last). No partition holds all of an equal score."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    sort = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    lines = cut(sort.drop("row").withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("at", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = lines.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return lines.withColumn("part", part).join(F.broadcast(sizes), "part").withColumn("rank", place + F.col("before") + 1).drop("part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of each row; rank is null for those that aren't drawn."""
    rows = cut(hashed(docs, id_col, text_col), "features")
    wanted = cut(hashed(target.withColumn("_", F.lit(0)), "_", target_text_col), "target")
    found = cut(weighed(rows, gains(totals(rows), totals(wanted)), seed), "scores")
    forget(rows, wanted)
    fit = found.where(F.col("n_words") >= least_words)
    n_drawn = fit.count() * share // 100
    out = ranked(fit)
    out = out.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    rest = found.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def _sql_hex(digits: str, n: int) -> str:
    """The number that ``n`` upper-case hex digits write."""
    return " + ".join(f"(strpos('0123456789ABCDEF', substr({digits}, {k + 1}, 1)) - 1) * {16 ** (n - 1 - k)}" for k in range(n))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAMS = "unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"

#: The checksum goes a byte a step, for all distinct features at once.
ORACLE = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
src AS MATERIALIZED (SELECT r, {_GRAMS} AS f FROM w),
tgt AS MATERIALIZED (SELECT {_GRAMS} AS f FROM (SELECT {_WORDS} AS ws FROM benchmark)),
tab AS MATERIALIZED (SELECT i, list_reduce([i] || [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) t(i)),
c AS (
  SELECT f, hex(encode(f)) AS rest, CAST(4294967295 AS BIGINT) AS crc FROM (SELECT f FROM src UNION SELECT f FROM tgt)
  UNION ALL
  SELECT f, substr(rest, 3), xor(crc >> 8, v) FROM (SELECT *, xor(crc, {_sql_hex('rest', 2)}) & 255 AS i FROM c WHERE rest <> '') JOIN tab USING (i)
),
b AS MATERIALIZED (SELECT f, xor(crc, 4294967295) % 10000 AS b FROM c WHERE rest = ''),
s AS (SELECT b, count(*) AS n FROM src JOIN b USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM tgt JOIN b USING (f) GROUP BY b),
g AS MATERIALIZED (
  SELECT i AS b, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM src) + 10000) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM tgt) + 10000)))) AS BIGINT) AS gain
  FROM range(10000) x(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i
),
d AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM src JOIN b USING (f) JOIN g USING (b) GROUP BY r),
e AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(d.n, 0) AS n_features, coalesce(CAST(floor(total / d.n) AS BIGINT), 0) AS weight,
    upper(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))) AS x FROM w LEFT JOIN d USING (r)
),
o AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln(({_sql_hex('x', 8)} + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (SELECT 25 * count(*) // 100 FROM o WHERE n_words >= 20) THEN place END AS rank FROM k
"""

"""Exact de-duplication with a heavy-hitter split (DataFrame functions only).

A Misra-Gries summary (Spark's frequent-items aggregate) over the digests of the normalised texts names the few digests
that may hold a large share of all rows. Their groups are counted exactly with map-side partial aggregation, and those
that are truly frequent are broadcast, at most ``counters`` rows, so that their rows never meet in one task. All other
digests are grouped by an ordinary shuffle of slim rows (digest, length, id, number of the row).

Defined results: a null text counts as empty; empty texts are equal to each other and to texts of white space only; of
equal rows of the largest length and the smallest id (null ids last) exactly one is kept, also when a row is repeated;
an empty table gives an empty table; columns of any other names are not read, or carried as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaqc.llm.common import COUNTERS, SPACE, cut, documents, forget, text_of, thinned


def digest_of(text_col: str):
    return F.unhex(F.sha2(F.regexp_replace(text_of(text_col), SPACE + "+", ""), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest of the text without white space, code points of the text, number of the row)."""
    return docs.select(
        F.col(id_col).alias("id"), digest_of(text_col).alias("digest"), F.length(text_of(text_col)).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row")
    )


def frequent(slim: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` rows: the digests that hold more than 1/counters of the rows, with winner and exact size."""
    short = slim.select(F.xxhash64("digest").alias("short"), "digest", "n_chars", "id", "row")
    found = short.freqItems(["short"], 1.0 / counters).select(F.explode("short_freqItems").alias("short"))
    exact = (
        short.join(F.broadcast(found), "short")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(rank()).alias("best"))
    )
    total = slim.agg(F.count(F.lit(1)).alias("n_rows"))
    return exact.join(F.broadcast(total), F.col("group_size") * counters > F.col("n_rows")).drop("n_rows")


def rank():
    """Order of the rows of a group: the row that stays comes first. No two rows are equal in it."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary)."""
    slim = cut(digests(docs, id_col, text_col), "digests")
    winners = cut(frequent(slim, counters), "frequent-digests")
    hot = slim.join(F.broadcast(winners), "digest").withColumn("kept", rank() == F.col("best")).withColumn("keep_id", F.col("best.id"))
    cold = slim.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group, ordered = Window.partitionBy("digest"), Window.partitionBy("digest").orderBy(rank())
    cold = (
        cold.withColumn("kept", F.row_number().over(ordered) == 1)
        .withColumn("keep_id", F.first("id").over(ordered))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    out = ["id", "keep_id", "group_size", "kept", "digest"]
    found = cold.select(out).unionByName(hot.select(out))
    found._reads = [slim, winners]
    return found


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they came whatever their names. Texts move only where a row is repeated with its id."""
    found = exact_dedup(docs, id_col, text_col, counters)
    per_id = found.groupBy("digest", "id").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n_rows"))
    changed = cut(per_id.where("NOT stays OR n_rows > 1"), "dropped")
    forget(*found._reads)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest_of(text_col).alias("digest"), text_of(text_col).alias("text"))
    return thinned(rows, changed, ["digest", "id"], docs.count(), F.struct(F.length("text").alias("n"), F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER w = 1 AS kept,
  h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id)
"""

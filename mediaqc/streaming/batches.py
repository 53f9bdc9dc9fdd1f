"""Micro-batches: verify what arrives against earlier rows and the stored registry, exactly once a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaqc.config import Thresholds
from mediaqc.functions.hashing import HASHES
from mediaqc.operators import duplicates
from mediaqc.sources import registry
from mediaqc.streaming.live import Live, counts

PARTS = [f"{n}_{side}" for n in HASHES for side in ("hi", "lo")]
RESULTS = T.StructType(
    [T.StructField(n, t) for n, t in (("image_id", T.StringType()), ("md5", T.StringType()), ("status", T.StringType()), ("match_id", T.StringType()), ("processed_at", T.TimestampType()), ("batch", T.LongType()))]
    + [T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("similarity", T.DoubleType())]
    + [T.StructField(p, T.LongType()) for p in PARTS]
)


def decide(new: DataFrame, history: DataFrame, as_of: Column, days: int, judge: Callable[[DataFrame], DataFrame] | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Each row of ``new`` (image_id, md5, seq, and the halves of the hashes if there are) against all earlier rows that
    registered: those of the window, then those of the batch before it. Equal digests first, then hash votes.

    Rows that are no duplicates get their status from ``judge``, which adds ``status`` (the cascade's, say), else they are
    valid; without a digest they could not be measured and are errors.
    """
    window = history if days <= 0 else history.where(F.col("processed_at") >= registry.since(as_of, days))
    parts = [F.col(p) if p in new.columns else F.lit(None).cast("long").alias(p) for p in PARTS]
    mine = new.select("*", *[c for p, c in zip(PARTS, parts, strict=True) if p not in new.columns])
    rows = mine.select("seq", "image_id", "md5", F.lit(False).alias("old"), *PARTS)
    old = window.where("status <> 'Duplicate' AND md5 IS NOT NULL").select("seq", "image_id", "md5", F.lit(True).alias("old"), *PARTS)
    records, _ = duplicates.screened(rows.unionByName(old), t)
    found = records.select("image_id", "match_id", F.col("status").alias("kind"), "similarity")
    alone = mine.join(found.select("image_id"), "image_id", "left_anti")
    status = F.when(F.col("md5").isNull(), "Error").otherwise("Valid")
    alone = alone.withColumn("status", status) if judge is None else judge(alone).withColumn("status", F.when(F.col("md5").isNull(), "Error").otherwise(F.col("status")))
    stored = ["image_id", "md5", "seq", *PARTS]
    same = mine.join(found, "image_id").select(*stored, F.lit("Duplicate").alias("status"), "match_id", "kind", "similarity")
    both = alone.select(*stored, "status", F.lit("").alias("match_id"), F.lit("").alias("kind"), F.lit(0.0).alias("similarity")).unionByName(same)
    return both.withColumn("processed_at", as_of)


def run(
    stream: DataFrame, path: str, checkpoint: str, as_of: Callable[[SparkSession, int], Column], days: int = 10, watch: Callable[[int, DataFrame], None] | None = None,
    judge: Callable[[DataFrame], DataFrame] | None = None, t: Thresholds = Thresholds(), wait: bool = True, live: Live | None = None,
):
    """Process all that is there in micro-batches into the table at ``path``; returns the query, ended unless ``wait`` is false.

    A batch that is run again after a failure replaces its own rows, so nothing is counted twice. ``stop()`` of the query
    cancels it between batches: what is written stays, and the next run goes on from there. ``live`` counts what is stored while
    the query runs; unless it is waited for, take it off the session's listeners when done.
    """
    spark = stream.sparkSession
    if live is not None:
        live.start(registry.read_table(spark, path, RESULTS, nested=True))
        spark.streams.addListener(live)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        history = registry.read_table(spark, path, RESULTS, nested=True).where(F.coalesce("batch", F.lit(-1)) < number)
        out = decide(batch, history, as_of(spark, number), days, judge, t).withColumn("batch", F.lit(number).cast("long"))
        part = f"{path}/part_{number:09d}"
        if live is None:
            out.write.mode("overwrite").parquet(part)
        else:
            counted, seen = live.observed(out)
            counted.write.mode("overwrite").parquet(part)
            live.stored(number, seen)
        if watch is not None:
            watch(number, registry.read_table(spark, part, RESULTS))

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if live is not None:
        live.query = str(query.id)
    if wait:
        try:
            query.awaitTermination()
        finally:
            if live is not None:
                spark.streams.removeListener(live)
    return query


def progress(results: DataFrame, total: int) -> DataFrame:
    """Counts by status, and how much is done."""
    return results.agg(*counts()).withColumn("total", F.lit(total)).withColumn("left", F.lit(total) - F.col("done"))

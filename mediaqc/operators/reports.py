"""Counts, histograms, subsets, tails and the export join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaqc.plans.lineage import cut
from mediaqc.schemas import EXPORT


def status_kpi(df: DataFrame, status: str = "status") -> DataFrame:
    """(status, n, pct): counts and percentages to one place."""
    counts = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.when(total > 0, F.round(F.col("n") * 100.0 / total, 1)))


def layer_histogram(df: DataFrame, layer: str = "exit_layer", layers: range = range(1, 7)) -> DataFrame:
    """(exit_layer, n) for each layer, 0 included; other layers are left out."""
    counts = df.groupBy(F.col(layer).cast("int").alias("exit_layer")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(k,) for k in layers], "exit_layer int")
    return every.join(counts, "exit_layer", "left").select("exit_layer", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cluster_report(df: DataFrame) -> DataFrame:
    """Duplicates by cluster, with their originals."""
    return df.where("status = 'Duplicate'").select("cluster_id", "duplicate_id", "original_id", "original_status", "match_type", "similarity").orderBy("cluster_id", "duplicate_id")


def tail(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The last n rows in an order, newest first, with their place."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("int"))


def in_status(df: DataFrame, *wanted: str, status: str = "status") -> DataFrame:
    return df.where(F.col(status).isin(*wanted))


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that there are."""
    return df.select(*[c for c in columns if c in df.columns])


def shown(status: Column, names: dict[str, str], other: str = "") -> Column:
    """What is shown for a status: a style, a badge or an icon."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), F.lit(other))


def in_chunks(df: DataFrame, size: int, row_index: str = "row_index") -> DataFrame:
    """Adds ``chunk``, rows in the order in which chunks are appended: by chunk, then by index."""
    return df.withColumn("chunk", F.floor(F.col(row_index) / size).cast("long")).orderBy("chunk", row_index)


def bound(df: DataFrame, url: str, row_index: str, limit: int = 0, only_http: bool = True) -> DataFrame:
    """Row limit first, then the url filter, then dense numbers from 0 in the old order."""
    if limit > 0:
        df = df.where(F.col(row_index) < limit)
    if only_http:
        df = df.where(F.col(url).cast("string").startswith("http"))
    return dense_index(df, row_index)


def dense_index(df: DataFrame, order: str, out: str = "new_index", ranges: int = 64) -> DataFrame:
    """Numbers from 0 in order without one task for all rows: ranges are counted, then numbered inside."""
    parted = cut(df.repartitionByRange(ranges, order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy("_part").orderBy(order)
    return parted.join(F.broadcast(starts), "_part").withColumn(out, F.row_number().over(inside) - 1 + F.col("_start")).drop("_part", "_start")


def export(verdicts: DataFrame, rows: DataFrame, row_index: str = "row_index") -> DataFrame:
    """Input rows with their verdicts; where names clash the verdict's column wins."""
    ours = {name for name, _ in EXPORT}
    kept = [c for c in rows.columns if c not in ours and c != row_index]
    return verdicts.join(rows, row_index, "left").select(*[rows[c] for c in kept], *[verdicts[f].alias(name) for name, f in EXPORT])


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    return df.groupBy(truth.alias("truth"), predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def cost_totals(df: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and costs by group, rounded once at the end."""
    return df.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("usd"), 8).alias("usd"), F.round(F.sum("inr"), 4).alias("inr"))

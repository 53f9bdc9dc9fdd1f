"""Stored tables in folders by day and bucket: a look-back reads the folders of its days, an upsert those of its keys' buckets.

Defined results: a row without a time lies in a folder that no window reaches; rows without a key are one row; a table that is
not there is empty; columns of a table may have any names but those of the folders.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaqc.plans.lineage import cut, forget
from mediaqc.sources import registry

DAY, BUCKET = "by_day", "by_bucket"
#: The folder of rows without a time: before all days.
NO_DAY = -(1 << 31)


@dataclass(frozen=True)
class Layout:
    """``key`` decides the bucket, ``at`` the day (since 1970, UTC; of a time without a zone, as it stands)."""

    key: str = "image_id"
    at: str = "processed_at"
    buckets: int = 64

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def day(self, time: Column, kind: T.DataType) -> Column:
        days = F.unix_date(F.to_date(time)) if isinstance(kind, (T.TimestampNTZType, T.DateType)) else F.floor(F.unix_micros(time) / F.lit(86_400_000_000)).cast("int")
        return F.coalesce(days, F.lit(NO_DAY))

    def placed(self, df: DataFrame) -> DataFrame:
        if taken := {DAY, BUCKET} & set(df.columns):
            raise ValueError(f"the rows have columns {sorted(taken)} already")
        return df.withColumns({DAY: self.day(F.col(self.at), df.schema[self.at].dataType), BUCKET: self.bucket(F.col(self.key))})


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table with its folders' columns, which filters prune by."""
    full = T.StructType([*schema.fields, T.StructField(DAY, T.IntegerType()), T.StructField(BUCKET, T.IntegerType())])
    store, where = _path(spark, path)
    return spark.read.schema(full).parquet(path) if store.exists(where) else spark.createDataFrame([], full)


def _write(placed: DataFrame, path: str, mode: str) -> None:
    """One task and file a folder; a day that holds a third of all rows is still spread over all buckets."""
    placed.repartition(DAY, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(DAY, BUCKET).parquet(path)


def create(df: DataFrame, path: str, layout: Layout = Layout()) -> None:
    """Write the whole table, replacing what is there."""
    _write(layout.placed(df), path, "static")


def recent(table: DataFrame, as_of: Column, days: int, layout: Layout = Layout()) -> DataFrame:
    """The rows since as_of - days, inclusive, from the folders of these days; all rows for days <= 0."""
    if days <= 0:
        return table
    kind = table.schema[layout.at].dataType
    since = registry.since(as_of, days).cast(kind)
    return table.where((F.col(DAY) >= layout.day(since, kind)) & (F.col(layout.at) >= since))


def of_keys(table: DataFrame, keys: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """The rows whose key is among ``keys`` (one column), from the folders of their buckets: at most one number a bucket is collected."""
    keys = keys.select(F.col(keys.columns[0]).alias("_k")).distinct()
    touched = [r[0] for r in keys.select(layout.bucket(F.col("_k"))).distinct().collect()]
    return table.where(F.col(BUCKET).isin(touched)).join(keys, table[layout.key].eqNullSafe(keys["_k"]), "left_semi")


def _cells(placed: DataFrame) -> set[tuple[int, int]]:
    """The folders of rows: their number is bounded by those of days and buckets."""
    return {(r[0], r[1]) for r in placed.select(DAY, BUCKET).distinct().collect()}


def upsert(spark: SparkSession, path: str, new: DataFrame, schema: T.StructType, layout: Layout = Layout(), order: tuple[str, ...] = ()) -> int:
    """Store the last row of each key by ``order`` (the time, if not given); ``new`` wins ties. Returns the number of folders written.

    Only folders that hold a row of ``new``'s keys, before or after, are read whole and written; a key of many rows combines
    before the shuffle. The new folders replace the old ones, then a folder that has lost its last row goes. An upsert that
    fails between these leaves a key twice at most; running it again gives the table it should have.
    """
    names = [f.name for f in schema.fields]
    order = order or (layout.at,)
    incoming = cut(registry.upsert(None, new.select(*names), layout.key, *order), "incoming")
    table = read(spark, path, schema)
    before = of_keys(table, incoming.select(layout.key), layout)
    winners = cut(layout.placed(registry.upsert(before.select(*names), incoming, layout.key, *order).select(*names)), "winners")
    cells = _cells(before) | _cells(winners)
    days_of = defaultdict(list)
    for day, bucket in sorted(cells):
        days_of[bucket].append(day)
    here = reduce(lambda a, b: a | b, [(F.col(BUCKET) == b) & F.col(DAY).isin(days) for b, days in days_of.items()], F.lit(False))
    keys = incoming.select(F.col(layout.key).alias("_k"))
    others = table.where(here).join(keys, table[layout.key].eqNullSafe(keys["_k"]), "left_anti")
    after = cut(others.unionByName(winners), "rewritten")
    left = _cells(after)
    if left:
        _write(after, path, "dynamic")
    for day, bucket in cells - left:
        store, where = _path(spark, f"{path}/{DAY}={day}/{BUCKET}={bucket}")
        store.delete(where, True)
    forget(incoming, winners, after)
    return len(left)

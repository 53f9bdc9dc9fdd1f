"""The stored tables: look-back windows, point lookups, keyed upsert, insert if absent, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def since(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def window_ids(results: DataFrame, as_of: Column, days: int, id_col: str = "image_id", at: str = "processed_at") -> DataFrame:
    """Distinct ids processed since as_of - days, inclusive; all ids for days <= 0. Null and empty ids are left out."""
    rows = results if days <= 0 else results.where(F.col(at) >= since(as_of, days))
    return rows.select(id_col).where(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")).distinct()


def window_hashes(registry: DataFrame, results: DataFrame, as_of: Column, days: int, id_col: str = "image_id", at: str = "processed_at") -> DataFrame:
    """Registry rows with a result in the window; the whole registry for days <= 0."""
    if days <= 0:
        return registry
    return registry.join(results.where(F.col(at) >= since(as_of, days)).select(id_col, at), id_col)


def status_of(matches: DataFrame, results: DataFrame, matched: str = "match_id") -> DataFrame:
    """Adds original_status: the status of the matched row, or an empty text."""
    status = results.select(F.col("image_id").alias(matched), F.col("validation_status").alias("original_status"))
    return matches.join(status, matched, "left").withColumn("original_status", F.coalesce("original_status", F.lit("")))


def _free(name: str, *tables: DataFrame) -> str:
    """``name``, or a longer one that no table has."""
    while any(name in t.columns for t in tables):
        name += "_"
    return name


def upsert(old: DataFrame | None, new: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``; rows of ``new`` win over ``old`` where it ties. Combines before the shuffle."""
    is_new = _free("new", new, *([] if old is None else [old]))
    rows = new.withColumn(is_new, F.lit(1))
    if old is not None:
        rows = old.withColumn(is_new, F.lit(0)).unionByName(rows, allowMissingColumns=True)
    others, best = [c for c in rows.columns if c not in (key, is_new)], _free("best", rows)
    found = rows.groupBy(key).agg(F.max(F.struct(*order, is_new, *[c for c in others if c not in order])).alias(best))
    return found.select(key, *[F.col(best)[c].alias(c) for c in others])


def insert_if_absent(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """``old`` and, for each other key, the first row of ``new`` by ``order``."""
    others, best = [c for c in new.columns if c != key], _free("best", new)
    first = new.groupBy(key).agg(F.min(F.struct(*order, *[c for c in others if c not in order])).alias(best))
    first = first.select(key, *[F.col(best)[c].alias(c) for c in others])
    return old.unionByName(first.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def add_members(clusters: DataFrame, duplicates: DataFrame, at: Column) -> DataFrame:
    """``clusters`` and a member for each duplicate (cluster_id, image_id) that is not in it yet. Members are never originals."""
    new = duplicates.select("cluster_id", "image_id", F.lit(0).alias("is_original"), at.alias("created_at")).dropDuplicates(["cluster_id", "image_id"])
    return clusters.unionByName(new.join(clusters.select("cluster_id", "image_id"), ["cluster_id", "image_id"], "left_anti"))


def add_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """``vectors`` (image_id, emb, seq) and the rows of ``new`` that have a vector and are not in it yet, scaled to length 1.

    All rows that are no duplicates by digest or votes belong here, also those that turn out duplicates by their vector, as
    later rows are compared with them too.
    """
    length = F.sqrt(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x * x)) + 1e-10
    unit = new.where(F.col("emb").isNotNull()).withColumn("length", length)
    unit = unit.select("image_id", F.zip_with("emb", F.array_repeat("length", F.size("emb")), lambda x, n: (x / n).cast("float")).alias("emb"), "seq")
    return insert_if_absent(vectors, unit, "image_id", "seq")


def unchecked(late: DataFrame, checked: DataFrame, *keys: str) -> DataFrame:
    """The candidates that came late and are still to be looked at."""
    return late.join(checked.select(*keys), list(keys), "left_anti")


def read_table(spark: SparkSession, path: str, schema: T.StructType, spare: str | None = None, nested: bool = False) -> DataFrame:
    """A stored table, else its spare copy, else an empty one; ``nested`` if it is a folder of tables."""
    fs = spark._jvm.org.apache.hadoop.fs
    for p in filter(None, (path, spare)):
        where = fs.Path(p)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.read.schema(schema).option("mergeSchema", True).option("recursiveFileLookup", nested).parquet(p)
    return spark.createDataFrame([], schema)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the old table, then swap, so that a reader or a failure never meets half a table."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    df.write.mode("overwrite").parquet(f"{path}.next")
    here, old, following = fs.Path(path), fs.Path(f"{path}.old"), fs.Path(f"{path}.next")
    store = here.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(old, True)
    if store.exists(here):
        store.rename(here, old)
    store.rename(following, here)


def truncate(spark: SparkSession, path: str, schema: T.StructType) -> None:
    replace_table(spark.createDataFrame([], schema), path)

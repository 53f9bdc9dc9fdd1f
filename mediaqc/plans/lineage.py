"""Cut lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: With it Spark deletes the shuffle files of a query when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one, but only if all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and the executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, lost executors cost nothing,
    and the shuffle files of the write are gone when it ends.

    The files lie in a folder for each value of the columns ``by``, so that a filter on them reads no others.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)

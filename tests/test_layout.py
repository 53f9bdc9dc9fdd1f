"""Stored tables by day and bucket: what a look-back reads, what an upsert writes."""

import datetime as dt
import os
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaqc.sources import layout

SCHEMA = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("processed_at", T.TimestampType()), T.StructField("new", T.StringType())])
BY = layout.Layout(buckets=16)
START = dt.datetime(2024, 3, 1, 12)


def stored(spark, tmp_path, n=400, days=20):
    rows = [(f"i{k}", START + dt.timedelta(days=k % days, seconds=k), "old") for k in range(n)] + [(None, START, "nokey"), ("notime", None, "old")]
    path = f"{tmp_path}/table"
    layout.create(spark.createDataFrame(rows, SCHEMA), f"file://{path}", BY)
    return path, rows


def files(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_ino) for p in Path(path).rglob("*.parquet")}


def test_look_back_reads_only_its_days(spark, tmp_path):
    path, rows = stored(spark, tmp_path)
    as_of = START + dt.timedelta(days=19, hours=3)
    first = (START + dt.timedelta(days=9)).toordinal() - dt.date(1970, 1, 1).toordinal()
    for p in Path(path).glob(f"{layout.DAY}=*"):  # what lies outside the window cannot be read any more
        if int(p.name.split("=")[1]) < first:
            for f in p.rglob("*.parquet"):
                f.write_bytes(b"no parquet")
                os.remove(f.with_name(f".{f.name}.crc"))
    found = layout.recent(layout.read(spark, f"file://{path}", SCHEMA), F.lit(as_of), 10, BY)
    assert {r.image_id for r in found.collect()} == {i for i, at, _ in rows if at and at >= as_of - dt.timedelta(days=10)}
    plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert f"{layout.DAY}" in plan.split("PartitionFilters")[1].split("]")[0]


def test_upsert_rewrites_the_folders_of_its_keys(spark, tmp_path):
    path, rows = stored(spark, tmp_path)
    before = files(path)
    later, earlier = START + dt.timedelta(days=30), START - dt.timedelta(days=30)
    new = [(f"i{k}", later, "new") for k in range(7)] + [("i7", earlier, "late"), ("fresh", later, "new"), ("fresh", later - dt.timedelta(days=1), "older"), (None, later, "nokey2")]
    df = spark.createDataFrame(new, SCHEMA)
    layout.upsert(spark, f"file://{path}", df, SCHEMA, BY)
    want = {i: (at, v) for i, at, v in rows} | {i: (at, v) for i, at, v in new if v != "older" and v != "late"}
    read = lambda: {r.image_id: (r.processed_at, r.new) for r in layout.read(spark, f"file://{path}", SCHEMA).collect()}
    after = files(path)
    assert read() == want and layout.read(spark, f"file://{path}", SCHEMA).count() == len(want)
    changed = {str(Path(p).parent) for p in set(before) ^ set(after)} | {str(Path(p).parent) for p in before if after.get(p, before[p]) != before[p]}
    assert len({p.rsplit("=", 1)[1] for p in changed}) <= 10 and 0 < len(changed) <= 20 < len(before) / 5
    layout.upsert(spark, f"file://{path}", df, SCHEMA, BY)  # again: the same
    assert read() == want


def test_upsert_mends_a_failed_one_and_empties_folders(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    one = lambda at, v: spark.createDataFrame([("a", at, v)], SCHEMA)
    assert layout.upsert(spark, path, one(START, "x"), SCHEMA, BY) == 1  # no table yet
    moved = START + dt.timedelta(days=3)
    BY.placed(one(moved, "y")).write.mode("append").partitionBy(layout.DAY, layout.BUCKET).parquet(path)  # written, the old row not yet gone
    assert layout.read(spark, path, SCHEMA).count() == 2
    layout.upsert(spark, path, one(moved, "y"), SCHEMA, BY)
    assert [(r.processed_at, r.new) for r in layout.read(spark, path, SCHEMA).collect()] == [(moved, "y")]
    assert len(files(f"{tmp_path}/table")) == 1
    layout.upsert(spark, path, one(moved, "y").limit(0), SCHEMA, BY)
    assert layout.read(spark, path, SCHEMA).count() == 1 and layout.recent(layout.read(spark, path, SCHEMA), F.lit(START), 0, BY).count() == 1

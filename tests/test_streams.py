"""Counters of a running query, and digests as keyed state."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from mediaqc.sources import registry
from mediaqc.streaming import batches, state
from mediaqc.streaming.live import Live

SCHEMA = "image_id string, md5 string, seq long, at timestamp"
DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
#: One file a batch. x registers on day 0, is still seen on day 6 and no more on day 12; l comes late and last.
BATCHES = [
    [("a", "x", 1, DAY(0)), ("b", "x", 2, DAY(0)), ("c", "y", 3, DAY(0)), ("n", None, 4, DAY(0))],
    [("d", "x", 5, DAY(6)), ("e", "z", 6, DAY(6)), ("m", None, 7, DAY(6))],
    [("f", "x", 8, DAY(12)), ("g", "x", 9, DAY(12)), ("h", "z", 10, DAY(12)), ("i", "y", 11, DAY(12))],
    [("k", "x", 12, DAY(18)), ("l", "y", 13, DAY(18))],
]


def put(spark, src, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)


def stream(spark, src):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def test_counters_equal_what_is_stored(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    for rows in BATCHES[:2]:
        put(spark, src, rows)
        time.sleep(1.1)  # files go by their time
    names, seen, fail = ("valid", "invalid", "duplicate", "error", "done", "total", "left"), [], [False]

    def go(live):
        def watch(number, part):
            assert not (fail[0] and number == 2), "stop here"
            stored = batches.progress(registry.read_table(spark, out, batches.RESULTS, nested=True), 20).first().asDict()
            now = live.snapshot()
            assert {n: now[n] for n in names} == stored
            seen.append(now["done"])

        batches.run(stream(spark, src), out, f"{tmp_path}/cp", lambda s, n: F.lit(DAY(6 * n)), watch=watch, live=live)
        return live

    live = go(Live(20))
    for _ in range(100):  # the engine's reports come later
        if live.snapshot()["rows"] == 7:
            break
        time.sleep(0.1)
    assert seen == [4, 7] and live.snapshot()["rows"] == 7 and live.snapshot()["rate"] > 0
    put(spark, src, BATCHES[2])
    fail[0] = True
    with pytest.raises(Exception, match="stop here"):
        go(Live(20))
    fail[0] = False
    assert go(Live(20)).snapshot()["done"] == 11 and seen == [4, 7, 11]  # batch 2 ran twice and counts once


@pytest.fixture
def ending(spark):
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    state.ends(spark)
    yield spark
    spark.conf.set(name, before)


def test_digest_state_equals_the_micro_batches(ending, tmp_path):
    spark = ending
    src, out, kept = f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/state"
    for rows in BATCHES:  # the query ends and starts again between the batches
        put(spark, src, rows)
        batches.run(stream(spark, src).drop("at"), out, f"{tmp_path}/cp1", lambda s, n: F.lit(DAY(6 * n)))
        found = state.by_digest(stream(spark, src), 10).writeStream.format("parquet").option("path", kept).option("checkpointLocation", f"{tmp_path}/cp2")
        found.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = {r.image_id: (r.status, r.match_id) for r in registry.read_table(spark, out, batches.RESULTS, nested=True).collect()}
    rows = spark.read.parquet(kept).collect()
    assert {r.image_id: (r.status, r.match_id) for r in rows} == want and len(rows) == len(want) == 13
    assert want["d"] == ("Duplicate", "a") and want["f"] == ("Valid", "") and want["g"] == ("Duplicate", "f") and want["n"] == ("Error", "")
    assert {r.image_id: r["at"] for r in rows} == {r[0]: r[3] for b in BATCHES for r in b}


def test_late_rows_meet_what_is_registered(ending, tmp_path):
    spark = ending
    src, kept = f"{tmp_path}/in", f"{tmp_path}/state"
    for rows in ([("new", "x", 9, DAY(20))], [("late", "x", 1, DAY(2)), ("next", "x", 10, DAY(29))]):
        put(spark, src, rows)
        query = state.by_digest(stream(spark, src), 10).writeStream.format("parquet").option("path", kept).option("checkpointLocation", f"{tmp_path}/cp")
        query.trigger(availableNow=True).start().awaitTermination()
    assert {r.image_id: r.match_id for r in spark.read.parquet(kept).collect()} == {"new": "", "late": "new", "next": "new"}

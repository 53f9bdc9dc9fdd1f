import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaqc import schemas
from mediaqc.functions import models, pixels, replies, scalars
from mediaqc.operators import reports
from mediaqc.plans import cascade
from mediaqc.sources import readers, registry, writers
from mediaqc.streaming import batches

FENCE = "```"


def test_lenient_json(spark):
    o = '{"k": 1}'
    texts = [o, f"  {o}\n", f"{FENCE}json\n{o}\n{FENCE}", f"x {FENCE}\n{o}\n{FENCE} y", f"so {o} there", "none", '{"k": 1', None, f"{FENCE}json\nbad\n{FENCE} {FENCE}json\n{o}\n{FENCE}"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, t string")
    got = {r.n: r.k for r in df.select("n", F.try_variant_get(replies.lenient_json(F.col("t")), "$.k", "int").alias("k")).collect()}
    assert [got[k] for k in range(len(texts))] == [1, 1, 1, 1, 1, None, None, None, 1]


def test_truthiness(spark):
    cases = {"true": True, "false": False, '"false"': True, '""': False, "0": False, "2": True, "0.5": True, "null": False, "[]": False, "[1]": True, "{}": False}
    df = spark.createDataFrame([(v, '{"a": %s}' % v) for v in cases] + [("missing", "{}")], "v string, t string")
    got = {r.v: r.x for r in df.select("v", replies.truthy(F.parse_json("t"), "a", F.lit(True)).alias("x")).collect()}
    assert got == {**cases, "missing": True}


def test_cost_and_labels(spark):
    df = spark.createDataFrame([("m-flash", 1_000_000, 0), ("pro", 0, 1_000_000), (None, 1, 1), ("FLASH", 0, 0)], "m string, p long, o long")
    usd, inr = scalars.cost(F.col("m"), F.col("p"), F.col("o"))
    assert [(r.u, r.i) for r in df.select(usd.alias("u"), inr.alias("i")).collect()] == [(0.15, 12.45), (10.5, 871.5), (0.000014, 0.001162), (0.0, 0.0)]
    lab = spark.createDataFrame([("Dulicate ", "verified"), ("", "Verified"), (None, "not verified"), ("x", None)], "d string, s string")
    assert [r.t for r in lab.select(scalars.truth_label(F.col("d"), F.col("s")).alias("t")).collect()] == ["Duplicate", "Valid", "Invalid", "Unknown"]
    assert spark.range(1).select(scalars.sheet_id(F.lit("https://h/d/abc/edit")).alias("x")).first().x == "abc"
    assert spark.range(1).select(scalars.degrees(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("s")).alias("x")).first().x == -10.5


def test_window_edges(spark):
    at = dt.datetime(2024, 1, 11)
    rows = [("a", at - dt.timedelta(days=10)), ("b", at - dt.timedelta(days=10, seconds=1)), ("", at), (None, at)]
    df = spark.createDataFrame(rows, "image_id string, processed_at timestamp")
    ids = lambda days: sorted(r.image_id for r in registry.window_ids(df, F.lit(at), days).collect())
    assert ids(10) == ["a"] and ids(0) == ["a", "b"]


def test_upsert_is_idempotent_and_insert_keeps_first(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 1, "z"), ("c", 5, "w"), ("c", 4, "u")], "k string, n int, v string")
    once = registry.upsert(old, new, "k", "n")
    again = registry.upsert(once, new, "k", "n")
    want = {("a", 1, "z"), ("b", 1, "y"), ("c", 5, "w")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in again.collect()}
    assert {tuple(r) for r in registry.insert_if_absent(old, new, "k", "n").collect()} == {("a", 1, "x"), ("b", 1, "y"), ("c", 4, "u")}


def test_table_swap_truncate_and_spare(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert registry.read_table(spark, path, schemas.CLUSTERS).count() == 0
    registry.replace_table(spark.createDataFrame([("c", "i", 0, None)], schemas.CLUSTERS), path)
    registry.replace_table(spark.createDataFrame([("c", "i", 0, None), ("c", "j", 0, None)], schemas.CLUSTERS), path)
    assert registry.read_table(spark, path, schemas.CLUSTERS).count() == 2
    assert registry.read_table(spark, path + "-gone", schemas.CLUSTERS, path + ".old").count() == 1
    registry.truncate(spark, path, schemas.CLUSTERS)
    assert registry.read_table(spark, path, schemas.CLUSTERS).count() == 0


def test_completed_and_export(spark, tmp_path):
    v = schemas.completed(spark.createDataFrame([("A", 0, None), ("B", 1, "Duplicate")], "pv_image_id string, row_index int, validation_status string"))
    assert len(v.columns) == 40 and v.where("pv_image_id = 'A'").first().validation_status == "Pending Review"
    rows = spark.createDataFrame([(0, "u0", "mine"), (1, "u1", "mine")], "row_index int, url string, PV_Image_ID string")
    out = reports.export(v, rows)
    assert out.columns[:2] == ["url", "PV_Image_ID"] and len(out.columns) == 32
    assert sorted(r.PV_Image_ID for r in out.collect()) == ["A", "B"]
    writers.write_reports(out, f"file://{tmp_path}/r")
    assert readers.read_csv(spark, f"file://{tmp_path}/r/clusters").columns == ["Cluster_ID", "Duplicate_ID", "Original_ID", "Original_Status", "Match_Type", "Similarity_%", "Layer"]
    assert readers.read_csv(spark, f"file://{tmp_path}/r/duplicates").count() == 1


def test_bound_limits_before_filter(spark):
    df = spark.createDataFrame([(0, "http://a"), (1, "x"), (2, "http://b"), (3, "http://c")], "row_index long, url string")
    assert [(r.url, r.new_index) for r in reports.bound(df, "url", "row_index", limit=3).orderBy("new_index").collect()] == [("http://a", 0), ("http://b", 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "u.txt").write_text(" http://a \nftp://x\nhttps://b\n")
    assert [r.url for r in readers.url_list(spark, f"file://{tmp_path}/u.txt").collect()] == ["http://a", "https://b"]
    (tmp_path / "t.CSV").write_text("a,b\n1,x\n")
    assert readers.read_table_file(spark, f"file://{tmp_path}/t.CSV").dtypes == [("a", "int"), ("b", "string")]
    with pytest.raises(ValueError):
        readers.read_table_file(spark, "t.pdf")


class Web:
    def get(self, url):
        if "bad" in url:
            raise OSError
        return ("text/html" if "page" in url else "image/png"), b"x" * (30 << 20 if "big" in url else 3)


def test_fetch(spark):
    df = spark.createDataFrame([(u,) for u in ("http://h/a", "http://h/bad", "http://h/page", "http://h/big", "nan", "file:///x")], "url string")
    got = {r.url: r.load_ok for r in readers.fetch(df, Web, pause=0).select("url", "load_ok").collect()}
    assert [u for u, ok in got.items() if ok] == ["http://h/a"]


def test_models_retry_and_ask(spark):
    waits = []
    text, _, n = models.reply(models.Fake(errors=2), "p", b"i", sleep=waits.append)
    assert json.loads(text.split(FENCE + "json")[1].split(FENCE)[0]) and n == 20 and len(waits) == 2
    assert models.reply(models.Fake(errors=9), "p", b"i", sleep=waits.append) == (None, 0, 0)
    df = models.ask_all(spark.createDataFrame([(b"a",), (b"b",)], "content binary"), models.Fake, "p", tasks=2)
    assert df.where("flash_reply IS NOT NULL").count() == 2


def test_stages_decide_only_open_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    s = lambda x: F.struct(F.lit(x).alias("status"))
    stages = [cascade.Decide("a", F.when(F.col("n") == 1, s("first"))), cascade.Enrich("e", lambda d: d.withColumn("seen", F.lit(True))), cascade.Decide("b", F.when(F.col("n") < 3, s("second")))]
    got = {r.n: (r.verdict and r.verdict.status, r.seen) for r in cascade.run(df, stages).collect()}
    assert got == {1: ("first", None), 2: ("second", True), 3: (None, True)}


def test_pixels():
    flat = np.full((64, 64, 3), 128, np.uint8)
    board = np.indices((64, 64)).sum(axis=0) % 2 * 255
    board = np.repeat(board[:, :, None], 3, axis=2).astype(np.uint8)
    assert pixels.gray(flat).std() == 0 and pixels.blur(pixels.gray(flat)) == 0 and pixels.blur(pixels.gray(board)) > 80
    assert pixels.moire(pixels.gray(flat)) < 1e-3 or pixels.moire(pixels.gray(flat)) <= 1
    ramp = np.repeat(np.tile(np.arange(64, dtype=np.uint8) * 4, (64, 1))[:, :, None], 3, axis=2)
    assert pixels.dhash(pixels.gray(ramp)) == (1 << 64) - 1 and pixels.dhash(pixels.gray(ramp[:, ::-1])) == 0
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:64, :64]
    scene = 128 + sum(rng.normal() * 25 * np.cos(x * a / 20 + rng.normal()) * np.cos(y * b / 20 + rng.normal()) for a in range(8) for b in range(8)) / 2
    scene = np.clip(np.repeat(scene[:, :, None], 3, axis=2), 0, 255).astype(np.uint8)
    noisy = np.clip(scene + rng.integers(-2, 3, scene.shape), 0, 255).astype(np.uint8)
    other = np.ascontiguousarray(scene[::-1, ::-1])
    for f in (pixels.phash, pixels.dhash, pixels.whash):
        bits = lambda a, b, f=f: bin(f(pixels.gray(a)) ^ f(pixels.gray(b))).count("1")
        assert bits(scene, noisy) <= 8 < bits(scene, other)
    blue = np.zeros((10, 10, 3), np.uint8)
    blue[..., 2] = 200
    assert pixels.branding(blue) and not pixels.branding(flat) and pixels.branding(np.zeros((0, 0, 3), np.uint8))
    assert pixels.pixel_md5(flat) == pixels.pixel_md5(flat.copy()) != pixels.pixel_md5(flat.reshape(32, 128, 3))
    assert pixels.at_most(ramp, 32).shape == (32, 32, 3) and pixels.at_most(ramp, 64) is ramp
    assert pixels.edge_band(pixels.gray(np.full((64, 64, 3), 255, np.uint8))) == (255.0, 0.0)
    assert len(pixels.features(ramp)) == len(pixels.FEATURES.split(", "))


def _png(path, rgb):
    import struct
    import zlib

    h, w, _ = rgb.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_to_features(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (48, 40, 3), dtype=np.uint8)
    _png(tmp_path / "a.png", a)
    _png(tmp_path / "b.png", a)
    (tmp_path / "bad.png").write_bytes(b"nothing")
    got = pixels.extract(readers.images(spark, f"file://{tmp_path}")).collect()
    assert [r.md5 for r in got] == [pixels.pixel_md5(a)] * 2 and got[0].width == 40


def test_stream(spark, tmp_path):
    schema = "image_id string, md5 string, seq long"
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    at = lambda s, n: F.lit(dt.datetime(2024, 1, 1 + n))
    go = lambda: batches.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), out, f"{tmp_path}/cp", at)
    put([("a", "x", 1), ("b", "x", 2), ("c", "y", 3)])
    go()
    put([("d", "x", 4), ("e", "z", 5)])
    go()
    got = registry.read_table(spark, out, batches.RESULTS, nested=True)
    assert {(r.image_id, r.status, r.match_id) for r in got.collect()} == {("a", "Valid", ""), ("b", "Duplicate", "a"), ("c", "Valid", ""), ("d", "Duplicate", "a"), ("e", "Valid", "")}
    assert batches.progress(got, 10).first().asDict() == {"valid": 3, "invalid": 0, "duplicate": 2, "error": 0, "done": 5, "total": 10, "left": 5}


def test_sheets_and_sources(spark, tmp_path):
    class Client:
        tabs = []

        def records(self, sheet):
            return [{"sheet": sheet, "n": 1}]

        def append_tab(self, sheet, title, rows):
            self.tabs.append((title, rows))

    for address in ("https://docs/x/d/abc-1/edit#gid=0", " abc-1 "):
        assert readers.read_source(spark, "sheet", Client(), address).first().asDict() == {"sheet": "abc-1", "n": 1}
    assert writers.write_sheet(spark.createDataFrame([(k, None) for k in range(5)], "a int, b string"), Client(), "s", "T", page=3) == 5
    assert [(t, len(r)) for t, r in Client.tabs] == [("T", 3), ("T (2)", 3), ("T (3)", 2)] and all(r[0] == ["a", "b"] for _, r in Client.tabs) and Client.tabs[0][1][1] == [0, ""]
    (tmp_path / "u.txt").write_text(" http://a/b \nnothing\n")
    assert [r.url for r in readers.read_source(spark, "urls", f"file://{tmp_path}/u.txt").collect()] == ["http://a/b"]
    with pytest.raises(ValueError, match="unknown source"):
        readers.read_source(spark, "tape")
    with pytest.raises(ValueError, match="no reader"):
        readers.read_table_file(spark, "x.pdf")


def test_small_expressions(spark):
    from mediaqc.functions import hashing, models

    row = spark.createDataFrame([("00000001ffffffff", 429, "slow", None, ["a", "", None, "b"], '{"x": "y", "n": "2"}')], "h string, code int, msg string, whole string, parts array<string>, j string")
    hi, lo = hashing.from_hex(F.col("h"))
    tree = replies.lenient_json(F.col("j"))
    got = row.select(hi.alias("hi"), lo.alias("lo"), scalars.rate_limited(F.col("code"), F.col("msg")).alias("limited"), replies.joined_parts(F.col("whole"), F.col("parts")).alias("text"),
                     replies.text(tree, "x", F.lit("")).alias("x"), replies.number(tree, "n", F.lit(0.0)).alias("n"), replies.number(tree, "none", F.lit(7.0)).alias("d"), scalars.sheet_id(F.lit("a/d/q/r")).alias("id")).first()
    assert tuple(got) == (1, 0xFFFFFFFF, True, "ab", "y", 2.0, 7.0, "q")
    tokens = models.token_totals(spark.createDataFrame([(3, None)], "flash_prompt_tokens long, flash_output_tokens long"), "flash").first()
    assert tokens.flash_total_tokens == 3


def test_stream_near_duplicates_errors_and_judge(spark, tmp_path):
    parts = ", ".join(f"{p} long" for p in batches.PARTS)
    schema = f"image_id string, md5 string, seq long, {parts}"
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    h = [1 << 20, 77, 5, 6, 7, 8]
    far = [x ^ 0xFFFFFFFF for x in h]
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    judge = lambda df: df.withColumn("status", F.when(F.col("image_id") == "f", "Invalid").otherwise("Valid"))
    go = lambda: batches.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), out, f"{tmp_path}/cp", lambda s, n: F.lit(dt.datetime(2024, 1, 1 + n)), judge=judge)
    put([("a", "m1", 1, *h), ("b", "m2", 2, h[0] ^ 3, *h[1:]), ("f", "m3", 3, *far), ("e", None, 4, *[None] * 6)])
    go()
    put([("c", "m4", 5, h[0], h[1] ^ 1, *h[2:]), ("d", "m1", 6, *h), ("g", "m2", 7, h[0] ^ 3, *h[1:])])
    go()
    got = {r.image_id: (r.status, r.match_id, r.kind) for r in registry.read_table(spark, out, batches.RESULTS, nested=True).collect()}
    near, exact = "Perceptual Duplicate", "Exact Duplicate"
    assert got == {"a": ("Valid", "", ""), "b": ("Duplicate", "a", near), "f": ("Invalid", "", ""), "e": ("Error", "", ""), "c": ("Duplicate", "a", near), "d": ("Duplicate", "a", exact), "g": ("Duplicate", "a", near)}


def test_orientation_and_edges():
    a = np.arange(6).reshape(2, 3)
    up = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a, 2).T, 8: np.rot90(a)}
    assert all(np.array_equal(pixels.oriented(a, k), v) for k, v in up.items()) and np.array_equal(pixels.oriented(a, 0), a)
    g = np.zeros((40, 40), np.uint8)
    g[:, 20:] = 200
    found = pixels.edges(g)
    assert found.sum() == 40 and len(set(np.nonzero(found)[1])) == 1 and not pixels.poster(g)
    ramp = np.zeros((40, 40), np.uint8)
    ramp[:, 20:] = np.linspace(20, 200, 40).astype(np.uint8)[:, None]  # weak at one end, strong at the other: one edge
    assert pixels.edges(ramp).sum() > 30 and pixels.edges(np.full((9, 9), 7, np.uint8)).sum() == 0
    lines = np.tile(np.array([0, 0, 0, 255, 255, 255], np.uint8), (60, 10))
    assert pixels.poster(lines)


def test_stored_members_vectors_and_recency(spark):
    from mediaqc.operators import duplicates

    at = F.lit(dt.datetime(2024, 1, 1))
    clusters = spark.createDataFrame([], schemas.CLUSTERS)
    one = registry.add_members(clusters, spark.createDataFrame([("c", "a"), ("c", "a"), ("c", "b")], "cluster_id string, image_id string"), at)
    two = registry.add_members(one, spark.createDataFrame([("c", "b"), ("d", "b")], "cluster_id string, image_id string"), at)
    assert sorted((r.cluster_id, r.image_id, r.is_original) for r in two.collect()) == [("c", "a", 0), ("c", "b", 0), ("d", "b", 0)]
    new = spark.createDataFrame([("a", [3.0, 4.0], 1), ("a", [1.0, 0.0], 2), ("b", None, 3)], "image_id string, emb array<float>, seq long")
    got = registry.add_vectors(registry.add_vectors(spark.createDataFrame([], schemas.VECTORS), new), new).collect()
    assert [(r.image_id, r.seq) for r in got] == [("a", 1)] and abs(got[0].emb[0] - 0.6) < 1e-6
    late = registry.unchecked(spark.createDataFrame([(1,), (2,)], "l long"), spark.createDataFrame([(1,)], "l long"), "l")
    assert [r.l for r in late.collect()] == [2]
    places = spark.range(10).select(F.col("id").alias("seq"), F.col("id").alias("place"))
    pairs = spark.createDataFrame([(1, 4), (2, 4), (3, 4), (5, 4)], "l long, r long")
    assert sorted(r.l for r in duplicates.recent(pairs, places, 2).collect()) == [2, 3]
    shown = spark.createDataFrame([("Valid",), ("?",), (None,)], "s string").select(reports.shown(F.col("s"), {"Valid": "ok"}, "-").alias("x"))
    assert [r.x for r in shown.collect()] == ["ok", "-", "-"]
    assert [r.chunk for r in reports.in_chunks(spark.range(5).withColumnRenamed("id", "row_index"), 2).collect()] == [0, 0, 1, 1, 2]

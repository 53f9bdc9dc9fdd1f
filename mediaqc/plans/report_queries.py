"""Queries of sources, tables, replies, costs and reports, and the same in plain SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mediaqc.config import Prices
from mediaqc.functions import grids, replies, scalars
from mediaqc.operators import reports
from mediaqc.plans.lineage import shared_folder
from mediaqc.schemas import EXPORT, VERDICT, VERDICT_DEFAULTS, completed
from mediaqc.sources import layout, registry


#: A rate that leaves no sum half-way between two roundings, where engines differ.
RATE = Prices(inr_per_usd=82.8731237)


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark, d):
    return _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _last(events):
    """The time of the last event, as a one-row table that is broadcast."""
    return F.broadcast(events.agg(F.max("ts").alias("as_of")))


def window_ids(spark, d):
    events = _events(spark, d)
    return registry.window_ids(events.join(_last(events)), F.col("as_of"), 10, "event_id", "ts")


def window_hash_join(spark, d):
    events = _events(spark, d)
    hashes = _read(spark, d, "embeddings").select(F.col("vec_id").alias("user_id"), "label")
    recent = events.join(_last(events)).where(F.col("ts") >= registry.since(F.col("as_of"), 10)).select("event_id", "user_id")
    return recent.join(hashes, "user_id").select("event_id", "user_id", "label")


def window_hashes(spark, d):
    """Registry rows with a result in the window, by the operator itself."""
    events = _events(spark, d)
    results = events.join(_last(events)).select(F.col("user_id").alias("image_id"), F.col("ts").alias("processed_at"), "as_of", "event_id")
    stored = _read(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    return registry.window_hashes(stored, results, F.col("as_of"), 10).select("image_id", "label", "processed_at")


def upsert_latest(spark, d):
    rows = _events(spark, d).select("user_id", "ts", "event_id", "event_type", "value")
    return registry.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "ts", "event_id")


def stored_window(spark, d):
    """A look-back over a stored table, from the folders of its days; the time of the last event is a value, so that they are pruned."""
    events = _events(spark, d).select("event_id", "ts", "event_type", "user_id")
    last = events.agg(F.max("ts")).first()[0]
    by = layout.Layout("event_id", "ts", 8)
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    layout.create(events, path, by)
    return layout.recent(layout.read(spark, path, events.schema), F.lit(last and str(last)).cast("timestamp_ntz"), 10, by).select(*events.columns)


def stored_upsert(spark, d):
    """The last event of each user in a stored table, after two upserts that rewrite the folders of their users."""
    events = _events(spark, d).select("user_id", "ts", "event_id", "event_type", "value")
    by = layout.Layout("user_id", "ts", 4)
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    for k in (0, 1):
        layout.upsert(spark, path, events.where(F.col("event_id") % 2 == k), events.schema, by, ("ts", "event_id"))
    return layout.read(spark, path, events.schema).select(*events.columns)


def insert_or_ignore(spark, d):
    rows = _events(spark, d).select("user_id", "event_id", "event_type")
    old = registry.insert_if_absent(rows.limit(0), rows.where("event_type = 'view'"), "user_id", "event_id")
    return registry.insert_if_absent(old, rows, "user_id", "event_id")


def original_status(spark, d):
    """The stored status of each matched row, empty where there is none."""
    labels = _read(spark, d, "labels")
    results = labels.select(F.col("doc_id").cast("string").alias("image_id"), F.when(F.col("quality") == 1, "Valid").otherwise("Invalid").alias("validation_status"))
    matches = _read(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).cast("string").alias("match_id"))
    return registry.status_of(matches, results)


def layer_histogram(spark, d):
    return reports.layer_histogram(_events(spark, d).select((F.floor("value") % 8).alias("exit_layer")))


def lenient_json(spark, d):
    fence = replies.FENCE
    kind = F.col("event_id") % 7
    text = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.concat(F.lit("  \n"), "props", F.lit(" ")))
        .when(kind == 2, F.concat(F.lit(f"Sure!\n{fence}json\n"), "props", F.lit(f"\n{fence} done")))
        .when(kind == 3, F.concat(F.lit(f"{fence}\n"), "props", F.lit(f"\n{fence}")))
        .when(kind == 4, F.concat(F.lit("The answer is "), "props", F.lit(" as asked.")))
        .when(kind == 5, F.expr("substring(props, 1, length(props) - 1)"))
        .otherwise(F.lit("no object here"))
    )
    reply = replies.lenient_json(text)
    return _events(spark, d).select("event_id", F.try_variant_get(reply, "$.k", "bigint").alias("k"))


def _costs(spark, d):
    model = F.when(F.col("role") == "assistant", "large-pro").otherwise("small-flash")
    n = F.length("text")
    usd, inr = scalars.cost(model, n, F.floor(n / 4), RATE)
    total = scalars.usage_total(n, F.floor(n / 4), F.lit(0))
    return _read(spark, d, "conversations").select("conv_id", "turn", model.alias("model"), total.cast("long").alias("tokens"), usd.alias("usd"), inr.alias("inr"))


def ai_cost(spark, d):
    return _costs(spark, d)


def cost_totals(spark, d):
    t = reports.cost_totals(_costs(spark, d), ["model"])
    return t.select("model", "tokens", F.round("usd", 6).alias("usd"), F.round("inr", 3).alias("inr"))


def _verdicts(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    first = docs.groupBy("md5").agg(F.min("doc_id").alias("first_id"))
    labels = _read(spark, d, "labels")
    status = F.when(F.col("doc_id") != F.col("first_id"), "Duplicate").when(F.col("quality") == 0, "Invalid").otherwise("Valid")
    return docs.join(first, "md5").join(labels, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", status.alias("status"), "quality", "toxic")


def export_join(spark, d):
    return _verdicts(spark, d)


def export_full(spark, d):
    """All columns of the export, by the operator itself: verdicts completed with defaults, and the input's own columns."""
    v = _verdicts(spark, d)
    stored = v.select(
        F.col("doc_id").cast("int").alias("row_index"), F.concat(F.lit("D"), "doc_id").alias("pv_image_id"), F.col("status").alias("validation_status"),
        F.when(F.col("status") == "Duplicate", 1).otherwise(4).alias("exit_layer"), (F.col("n_chars") / 8.0).alias("similarity_score"), F.lit(None).cast("string").alias("image_quality"),
    )
    rows = _read(spark, d, "documents").select(F.col("doc_id").cast("int").alias("row_index"), "lang", "source", F.lit("clash").alias("PV_Image_ID"))
    return reports.export(completed(stored), rows)


def invalid_subset(spark, d):
    return reports.in_status(_verdicts(spark, d), "Invalid", "Pending Review").select("doc_id", "status")


def dup_subset(spark, d):
    return reports.in_status(_verdicts(spark, d), "Duplicate").select("doc_id", "status")


def confusion_matrix(spark, d):
    v = _verdicts(spark, d).where("quality IS NOT NULL")
    truth = scalars.truth_label(F.when(F.col("toxic") == 1, " Dulicate ").otherwise(""), F.when(F.col("quality") == 1, "Verified").otherwise("NOT verified"))
    return reports.confusion(v, truth, scalars.predicted_label(F.col("status")))


def url_validate(spark, d):
    pages = _read(spark, d, "pages").select("page_id", "url")
    bad = ["", " nan ", "None", "null", "ftp://host/x", "http://", "https:///path", "www.host.org", " HTTP://Host.org/a "]
    extra = spark.createDataFrame([(-1 - k, u) for k, u in enumerate(bad)], "page_id long, url string")
    return pages.unionByName(extra).select("page_id", scalars.url_ok(F.col("url")).alias("ok"))


def limit_then_filter(spark, d):
    pages = _read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("x"), "url")).otherwise(F.col("url")).alias("url"))
    return reports.bound(pages, "url", "page_id", limit=100).select("page_id", "new_index")


def recent_tail(spark, d):
    return reports.tail(_events(spark, d).select("event_id", "ts", "event_type"), 50, F.desc("ts"), F.desc("event_id")).select("event_id", "event_type", "place")


def chunk_progress(spark, d):
    chunk = F.floor(F.col("event_id") / 40).cast("long")
    rows = _events(spark, d).groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("done"), F.round(F.sum("value"), 4).alias("elapsed"))
    rate, eta = scalars.throughput(F.col("done").cast("double"), F.lit(40.0) * 2, F.col("elapsed"))
    return rows.select("chunk", "done", F.round(rate, 9).alias("rate"), F.round(eta, 6).alias("eta"))


def _grid(spark, d):
    return _read(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: (x + 1.0) * 127.5).alias("e"))


def blur_8x8(spark, d):
    v = grids.laplacian_variance(F.col("e"))
    return _grid(spark, d).select("vec_id", F.round(v, 4).alias("blur_score"), (v < 80).alias("is_blurry"))


def line_artifact(spark, d):
    return _grid(spark, d).select("vec_id", F.round(grids.percentile(grids.row_steps(F.col("e")), 0.98), 6).alias("p98"))


def edge_glow(spark, d):
    edge = grids.border(F.col("e"))
    mean = F.aggregate(edge, F.lit(0.0), lambda s, x: s + x) / F.size(edge)
    return _grid(spark, d).select("vec_id", F.round(mean, 6).alias("edge_mean"), F.round(F.sqrt(grids.spread(edge)), 4).alias("edge_std"))


def hist_peaks(spark, d):
    return _grid(spark, d).select("vec_id", grids.histogram_peaks(F.col("e"), 8).alias("peaks"))


def batch_label_counts(spark, d):
    return _read(spark, d, "labels").groupBy((F.floor(F.col("doc_id") / 100)).cast("long").alias("batch")).agg(
        F.count_if(F.col("quality") == 1).alias("valid"), F.count_if(F.col("quality") == 0).alias("invalid"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count(F.lit(1)).alias("n")
    )


QUERIES = {
    f.__name__: f
    for f in (
        window_ids, window_hash_join, window_hashes, upsert_latest, stored_window, stored_upsert, insert_or_ignore, original_status, layer_histogram, lenient_json, ai_cost, cost_totals, export_join, export_full, invalid_subset, dup_subset,
        confusion_matrix, url_validate, limit_then_filter, recent_tail, chunk_progress, blur_8x8, line_artifact, edge_glow, hist_peaks, batch_label_counts,
    )
}

_V = """v AS (SELECT doc_id, lang, source, n_chars, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 THEN 'Duplicate' WHEN quality = 0 THEN 'Invalid' ELSE 'Valid' END AS status, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id))"""
_C = """c AS (SELECT conv_id, turn, model, n + n // 4 AS tokens, n / 1e6 * CASE WHEN model = 'small-flash' THEN 0.15::DOUBLE ELSE 3.5::DOUBLE END + (n // 4) / 1e6 * CASE WHEN model = 'small-flash' THEN 0.6::DOUBLE ELSE 10.5::DOUBLE END AS raw
  FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'large-pro' ELSE 'small-flash' END AS model, length(text) AS n FROM conversations))"""
_G = "g AS (SELECT vec_id, [(x + 1) * 127.5::DOUBLE FOR x IN CAST(embedding AS DOUBLE[])] AS e FROM embeddings)"


def _at(r: int, k: int) -> str:
    r, k = (-i if i < 0 else 14 - i if i > 7 else i for i in (r, k))
    return f"e[{r * 8 + k + 1}]"


_LAPLACE = ", ".join(f"{_at(r - 1, k)} + {_at(r + 1, k)} + {_at(r, k - 1)} + {_at(r, k + 1)} - 4 * {_at(r, k)}" for r in range(8) for k in range(8))
_EDGE = ", ".join(f"e[{i}]" for i in [*range(1, 9), *range(57, 65), *range(1, 65, 8), *range(8, 65, 8)])

_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
_STORED = {
    "pv_image_id": "'D' || doc_id", "validation_status": "status", "exit_layer": "CASE WHEN status = 'Duplicate' THEN 1 ELSE 4 END", "similarity_score": "n_chars / 8::DOUBLE",
}


def _default(name: str) -> str:
    return _STORED.get(name) or ("'" + VERDICT_DEFAULTS[name] + "'" if isinstance(VERDICT_DEFAULTS[name], str) else str(VERDICT_DEFAULTS[name]))


_EXPORTED = ", ".join(f'CAST({_default(f)} AS {_SQL_TYPES[VERDICT[f].dataType.simpleString()]}) AS "{name}"' for name, f in EXPORT)

ORACLE = {
    "window_hashes": "SELECT vec_id AS image_id, label, ts AS processed_at FROM events JOIN embeddings ON user_id = vec_id WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS",
    "export_full": f"WITH {_V} SELECT lang, source, {_EXPORTED} FROM v",
    "window_ids": "SELECT DISTINCT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS",
    "window_hash_join": "SELECT event_id, user_id, label FROM events JOIN embeddings ON user_id = vec_id WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS",
    "upsert_latest": "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stored_upsert": "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stored_window": "SELECT event_id, ts, event_type, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS",
    "insert_or_ignore": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'view', event_id) = 1",
    "original_status": "SELECT d.doc_id, CAST(d.doc_id // 2 AS VARCHAR) AS match_id, coalesce(CASE WHEN quality = 1 THEN 'Valid' WHEN quality = 0 THEN 'Invalid' END, '') AS original_status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id // 2",
    "layer_histogram": "SELECT CAST(k AS INTEGER) AS exit_layer, (SELECT count(*) FROM events WHERE CAST(floor(value) AS BIGINT) % 8 = k) AS n FROM range(1, 7) t(k)",
    "lenient_json": "SELECT event_id, CASE WHEN event_id % 7 < 5 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "ai_cost": f"WITH {_C} SELECT conv_id, turn, model, tokens, round(raw, 8) AS usd, round(raw * 82.8731237::DOUBLE, 6) AS inr FROM c",
    "cost_totals": f"WITH {_C} SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(round(raw, 8)), 6) AS usd, round(sum(round(raw * 82.8731237::DOUBLE, 6)), 3) AS inr FROM c GROUP BY model",
    "export_join": f"WITH {_V} SELECT * FROM v",
    "invalid_subset": f"WITH {_V} SELECT doc_id, status FROM v WHERE status IN ('Invalid', 'Pending Review')",
    "dup_subset": f"WITH {_V} SELECT doc_id, status FROM v WHERE status = 'Duplicate'",
    "confusion_matrix": f"WITH {_V} SELECT CASE WHEN toxic = 1 THEN 'Duplicate' WHEN quality = 1 THEN 'Valid' ELSE 'Invalid' END AS truth, status AS predicted, count(*) AS n FROM v WHERE quality IS NOT NULL GROUP BY ALL",
    "url_validate": """WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES (-1, ''), (-2, ' nan '), (-3, 'None'), (-4, 'null'), (-5, 'ftp://host/x'), (-6, 'http://'), (-7, 'https:///path'), (-8, 'www.host.org'), (-9, ' HTTP://Host.org/a ')) t(page_id, url))
      SELECT CAST(page_id AS BIGINT) AS page_id, regexp_matches(lower(trim(url)), '^https?://[^/?#]') AS ok FROM u""",
    "limit_then_filter": "SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS new_index FROM pages WHERE page_id < 100 AND page_id % 5 <> 0",
    "recent_tail": "SELECT event_id, event_type, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events QUALIFY place <= 50",
    "chunk_progress": """WITH c AS (SELECT event_id // 40 AS chunk, count(*) AS done, round(sum(value), 4) AS elapsed FROM events GROUP BY 1)
      SELECT chunk, done, round(CASE WHEN elapsed > 1 THEN done / elapsed ELSE 0::DOUBLE END, 9) AS rate, round(CASE WHEN elapsed > 1 THEN (80 - done) / (done / elapsed) END, 6) AS eta FROM c""",
    "blur_8x8": f"WITH {_G}, l AS (SELECT vec_id, [{_LAPLACE}] AS x FROM g) SELECT vec_id, round(list_var_pop(x), 4) AS blur_score, list_var_pop(x) < 80 AS is_blurry FROM l",
    "line_artifact": f"WITH {_G}, m AS (SELECT vec_id, [list_avg(e[r * 8 + 1:r * 8 + 8]) FOR r IN range(8)] AS m FROM g), x AS (SELECT vec_id, unnest([abs(m[i + 1] - m[i]) FOR i IN range(1, 8)]) AS v FROM m) SELECT vec_id, round(quantile_cont(v, 0.98), 6) AS p98 FROM x GROUP BY vec_id",
    "edge_glow": f"WITH {_G}, b AS (SELECT vec_id, [{_EDGE}] AS x FROM g) SELECT vec_id, round(list_avg(x), 6) AS edge_mean, round(list_stddev_pop(x), 4) AS edge_std FROM b",
    "hist_peaks": f"WITH {_G}, x AS (SELECT vec_id, unnest([least(CAST(floor((v - list_min(e)) / (list_max(e) - list_min(e)) * 8) AS INTEGER), 7) FOR v IN e]) AS b FROM g), n AS (SELECT vec_id, b, count(*) AS n FROM x GROUP BY ALL) SELECT vec_id, CAST(count(*) FILTER (WHERE n > 24) AS INTEGER) AS peaks FROM n GROUP BY vec_id",
    "batch_label_counts": "SELECT doc_id // 100 AS batch, count(*) FILTER (WHERE quality = 1) AS valid, count(*) FILTER (WHERE quality = 0) AS invalid, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) AS n FROM labels GROUP BY 1",
}

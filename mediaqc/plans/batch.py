"""One batch from urls to verdicts: fetch, measure, duplicates, cascade with both models, stored rows, export."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaqc.config import Prices, Thresholds
from mediaqc.functions import models, pixels, replies, scalars
from mediaqc.operators import duplicates, lookalikes, reports, rules
from mediaqc.plans import cascade
from mediaqc.plans.lineage import cut
from mediaqc.schemas import completed
from mediaqc.sources import readers, registry

#: What detectors outside this engine would give; rows that lack them count as unremarkable.
DETECTED = {"has_bezel": False, "bezel_score": 0.0, "ela_score": 0.0, "ss_software": False, "face_count": 1}


@dataclass
class Services:
    """What the outside world does: each is made once a task."""

    fetcher: Callable[[], readers.Fetcher]
    decode: Callable[[bytes], np.ndarray]
    flash: Callable[[], models.Model]
    pro: Callable[[], models.Model]
    prompt: str = "Describe the photo as JSON."
    sleep: Callable[[float], None] = field(default=lambda s: None)


def context(prompt: str) -> Column:
    """The large model is told what the statistics and the small model say."""
    stats = F.to_json(F.struct("raw_moire", "blur_score", "flag_text", F.round("score", 3).alias("score")))
    return F.concat(F.lit(prompt + "\nStatistics: "), stats, F.lit("\nFirst opinion: "), F.coalesce("flash_reply", F.lit("none")))


def measured(rows: DataFrame, services: Services) -> DataFrame:
    """Each url with its image's content and features; what cannot be loaded has load_ok false."""
    named = rows.withColumn("image_id", scalars.image_id(F.col("url"), F.col("row_index")))
    found = pixels.measured(readers.fetch(named, services.fetcher, sleep=services.sleep), services.decode)
    return found.withColumns({n: F.lit(v) for n, v in DETECTED.items() if n not in rows.columns})


def judged(df: DataFrame, contents: DataFrame, services: Services, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds ``verdict`` and both models' columns. Only open rows meet their ``contents`` (image_id, content) and are shown to a
    model; what it answered is written, without the images, before it is used."""

    def flash(open_: DataFrame) -> DataFrame:
        asked = cut(models.ask_all(open_.join(contents, "image_id"), services.flash, services.prompt, side="flash", sleep=services.sleep).drop("content"), "flash")
        return replies.with_flash(asked, F.col("face_count") > 0, F.col("face_count"))

    def pro(open_: DataFrame) -> DataFrame:
        asked = cut(models.ask_all(open_.join(contents, "image_id"), services.pro, context(services.prompt), side="pro", sleep=services.sleep).drop("content"), "pro")
        return replies.with_pro(asked)

    stages: list[cascade.Stage] = [cascade.failed()]
    for name, inputs, decision in rules.verdict(t):
        if name in ("flash", "pro_failed"):
            stages.append(cascade.Enrich(name, {"flash": flash, "pro_failed": pro}[name]))
        stages.append(cascade.Decide(name, decision, inputs))
    return cascade.run(rules.forensic_score(df, t), stages)


def costs(prices: Prices) -> dict[str, Column]:
    out = {}
    for side, model in (("flash", "flash"), ("pro", "pro")):
        used = [F.coalesce(f"{side}_{n}_tokens", F.lit(0)) for n in ("prompt", "output")]
        usd, inr = scalars.cost(F.lit(model), *used, prices)
        out |= {f"{side}_total_tokens": scalars.usage_total(*used, F.lit(0)).cast("int"), f"{side}_cost_usd": usd, f"{side}_cost_inr": inr}
        out[f"{side}_model"] = F.when(F.col(f"{side}_prompt_tokens").isNotNull(), F.lit(model))
    return out


#: Columns of input rows that only the third layer reads: vectors of the image and the face, key points.
SEEN = ("emb", "face", "points")


def looked(seen: DataFrame, rows: DataFrame, records: DataFrame, vectors: DataFrame | None, hashes: DataFrame | None, recent: DataFrame | None, t: Thresholds) -> DataFrame:
    """Records, as of ``duplicates.screened``, of the rows that the first layer left open and that look like an earlier one.

    ``vectors`` are the stored ones (image_id, seq, emb, and face and points if there are any); ``recent`` (image_id) are the
    stored images that count, None for all.
    """
    has = [c for c in SEEN if c in rows.columns]
    parts = lookalikes.PARTS
    open_ = seen.where("load_ok").select("image_id", "row_index", *parts).join(records.select("image_id"), "image_id", "left_anti")
    all_ = open_.join(rows.select("row_index", *has), "row_index").select((F.lit(1 << 40) + F.col("row_index")).alias("seq"), "image_id", F.lit(False).alias("old"), *has, *parts)
    if vectors is not None:
        old = vectors.select("seq", "image_id", F.lit(True).alias("old"), *[c for c in SEEN if c in vectors.columns])
        known = None if hashes is None else hashes.select("image_id", *parts).dropDuplicates(["image_id"])
        all_ = all_.unionByName(old if known is None else old.join(known, "image_id", "left"), allowMissingColumns=True)
    all_ = cut(all_, "vectors")
    allowed = None
    if recent is not None:
        allowed = all_.where("NOT old").select("seq").union(all_.where("old").join(recent, "image_id", "left_semi").select("seq")).withColumnRenamed("seq", "l")
    found = duplicates.record(None, None, lookalikes.found(all_, t, allowed))
    names = all_.select(F.col("seq").alias("match_id"), F.col("image_id").alias("matched"))
    named = found.join(names, "match_id").join(all_.select(F.col("seq").alias("r"), "image_id"), "r")
    return named.select("image_id", F.col("r").alias("seq"), F.col("matched").alias("match_id"), "status", "similarity", "layer", "reason")


def verified(rows: DataFrame, services: Services, stored: DataFrame | None, hashes: DataFrame | None, as_of: Column, days: int = 10, t: Thresholds = Thresholds(), prices: Prices = Prices(), vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, new registry rows) of ``rows`` (row_index, url, others) against the stored results and the registry of the window.

    Rows with a column emb are also compared with earlier ones by their vectors, key points and faces (``looked``), with
    ``vectors`` as the stored ones. Numbers (seq) of stored rows are unique and below 2^40, those of the batch follow them.
    """
    seen = cut(measured(rows.drop(*SEEN), services), "measured")
    parts = [f"{n}_{s}" for n in duplicates.HASHES for s in ("hi", "lo")]
    new = seen.where("load_ok").select((F.lit(1 << 40) + F.col("row_index")).alias("seq"), "image_id", "md5", F.lit(False).alias("old"), *parts)
    if hashes is not None:
        window = registry.window_hashes(hashes, stored, as_of, days) if stored is not None else hashes
        new = new.unionByName(window.select("seq", "image_id", "md5", F.lit(True).alias("old"), *parts))
    records, registering = duplicates.screened(new, t)
    records = cut(records, "records")
    if "emb" in rows.columns:
        recent = registry.window_ids(stored, as_of, days) if stored is not None else None
        records = cut(records.unionByName(looked(seen, rows, records, vectors, hashes, recent, t)), "records")
    status = seen.sparkSession.createDataFrame([], "image_id string, validation_status string") if stored is None else stored
    known = duplicates.explained(registry.status_of(records, status.select("image_id", "validation_status")))
    again = known.select(
        "image_id", F.lit("Duplicate").alias("validation_status"), F.col("status").alias("duplicate_status"), F.col("match_id").alias("matched_image_id"), "original_status", F.col("similarity").alias("similarity_score"),
        F.col("similarity").alias("ai_confidence"), F.col("layer").alias("exit_layer"), "forensic_reasoning",
    )
    rest = judged(seen.drop("content").join(records.select("image_id"), "image_id", "left_anti"), seen.select("image_id", "content"), services, t)
    v = F.col("verdict")
    rest = rest.withColumns(costs(prices)).select(
        "image_id", v["status"].alias("validation_status"), v["layer"].alias("exit_layer"), v["confidence"].alias("ai_confidence"), v["reason"].alias("error_reason"), "face_count",
        *[F.coalesce(f"pro_{n}", f"flash_{n}").alias(c) for n, c in (("face", "has_face"), ("screenshot", "is_screenshot"), ("manipulated", "is_manipulated"), ("branding", "has_required_branding"), ("details", "branding_details"), ("quality", "image_quality"), ("reasoning", "forensic_reasoning"))],
        *[f"{side}_{n}" for side in ("flash", "pro") for n in ("model", "prompt_tokens", "output_tokens", "total_tokens", "cost_usd", "cost_inr")],
        (F.col("flash_total_tokens") + F.col("pro_total_tokens")).alias("total_ai_tokens"), (F.col("flash_cost_usd") + F.col("pro_cost_usd")).alias("total_ai_cost_usd"), F.round(F.col("flash_cost_inr") + F.col("pro_cost_inr"), 6).alias("total_ai_cost_inr"),
    )
    both = rest.unionByName(again, allowMissingColumns=True).join(seen.select("image_id", "row_index"), "image_id")
    out = completed(both.withColumnRenamed("image_id", "pv_image_id").withColumn("processed_at", as_of.cast("string")))
    out = out.withColumn("cluster_id", F.coalesce(F.nullif(F.col("matched_image_id"), F.lit("")), F.col("pv_image_id")))
    return cut(out, "verdicts"), registering


def vectors_kept(vectors: DataFrame, verdicts: DataFrame, rows: DataFrame) -> DataFrame:
    """``vectors`` (image_id, emb, seq) and those of the batch, but of duplicates of the first layer and of images that failed."""
    kept = verdicts.where("validation_status <> 'Error' AND NOT (validation_status = 'Duplicate' AND exit_layer = 1)")
    new = kept.select("row_index", F.col("pv_image_id").alias("image_id")).join(rows.select("row_index", "emb"), "row_index")
    return registry.add_vectors(vectors, new.select("image_id", "emb", (F.lit(1 << 40) + F.col("row_index")).alias("seq")))


def members_kept(clusters: DataFrame, verdicts: DataFrame, at: Column) -> DataFrame:
    """``clusters`` and the batch's duplicates as members of the cluster of what they match."""
    return registry.add_members(clusters, verdicts.where("validation_status = 'Duplicate'").select("cluster_id", F.col("pv_image_id").alias("image_id")), at)


def exported(verdicts: DataFrame, rows: DataFrame) -> DataFrame:
    """Input rows with their verdicts, in the export's columns."""
    return reports.export(verdicts, rows)

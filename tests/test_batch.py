"""The whole batch with stand-ins for network and models: urls to verdicts to export."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaqc.functions import models
from mediaqc.operators import duplicates
from mediaqc.plans import batch
from mediaqc.schemas import EXPORT, VERDICT


def image(seed: int, change: int = 0) -> bytes:
    """48 x 48 raw pixels behind two bytes of size, with a large patch of a branding colour."""
    rng = np.random.default_rng(seed)
    a = np.kron(rng.integers(0, 255, (6, 6, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    a[:20, :20] = (19, 136, 8)
    a[40, 40, 0] ^= change
    return bytes([48, 48]) + a.tobytes()


def decode(data: bytes) -> np.ndarray:
    return np.frombuffer(data[2:], np.uint8).reshape(data[0], data[1], 3)


IMAGES = {"a": image(1), "a2": image(1), "near": image(1, 1), "b": image(2), "noface": image(3), "odd": b"\x30\x30broken", "old": image(4), "unsure": image(5), "crash": image(6)}


class Net:
    def get(self, url):
        name = url.rsplit("/", 1)[1]
        if name not in IMAGES:
            raise OSError("gone")
        return "image/png", IMAGES[name]


class Sure:
    name = "flash"

    def ask(self, prompt, content):
        face = content != IMAGES["noface"]
        answer = {"has_face": face, "has_required_branding": True, "confidence_score": 0.3 if content in (IMAGES["unsure"], IMAGES["crash"]) else 0.95}
        return f"```json\n{json.dumps(answer)}\n```", 40, 10


class Second:
    name = "pro"

    def ask(self, prompt, content):
        assert "First opinion" in prompt and "Statistics" in prompt
        return json.dumps({"recommendation": "Valid", "confidence_score": 0.9, "reasoning": "clear"}), 100, 30


class Never:
    def __init__(self):
        raise RuntimeError("no key")


SERVICES = batch.Services(Net, decode, Sure, Second)
NAMES = ["a", "a2", "near", "b", "noface", "odd", "gone", "old", "unsure"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, f"http://host/{n}", n) for k, n in enumerate(NAMES)], "row_index int, url string, note string")


def test_batch_end_to_end(spark, rows):
    as_of = F.lit("2024-05-01 00:00:00").cast("timestamp")
    first, registry = batch.verified(rows.where("note = 'old'"), SERVICES, None, None, as_of)
    assert first.schema.names == VERDICT.names and [r.validation_status for r in first.collect()] == ["Valid"]
    stored = first.select(F.col("pv_image_id").alias("image_id"), "validation_status", F.lit("2024-04-29").cast("timestamp").alias("processed_at"))
    again = rows.withColumn("row_index", F.col("row_index") + 100)  # other ids, one image of the stored batch among them
    found, new = batch.verified(again, SERVICES, stored, registry.select(F.col("seq") - (1 << 39), *registry.columns[1:]).toDF(*registry.columns), as_of)
    got = {r.note: r for r in found.join(again, "row_index").collect()}
    assert {n: got[n].validation_status for n in NAMES} == {
        "a": "Valid", "a2": "Duplicate", "near": "Duplicate", "b": "Valid", "noface": "Invalid", "odd": "Error", "gone": "Error", "old": "Duplicate", "unsure": "Valid",
    }
    assert got["a2"].duplicate_status == "Exact Duplicate" and got["a2"].matched_image_id == got["a"].pv_image_id and got["a2"].exit_layer == 1
    assert got["near"].duplicate_status == "Perceptual Duplicate" and "Hash votes=3/3" in got["near"].forensic_reasoning
    assert got["old"].original_status == "Valid" and got["old"].cluster_id == first.first().pv_image_id
    assert got["unsure"].exit_layer == 5 and got["unsure"].pro_total_tokens == 130 and got["unsure"].forensic_reasoning == "clear" and got["b"].pro_total_tokens == 0
    assert got["noface"].error_reason == "No clearly visible live human face detected by Flash" and got["b"].exit_layer == 4
    assert {r.image_id for r in new.collect()} == {got[n].pv_image_id for n in ("a", "b", "noface", "unsure")}
    out = batch.exported(found, again)
    assert out.columns == ["url", "note", *[n for n, _ in EXPORT]] and out.count() == len(NAMES)


def test_models_that_cannot_be_made(spark, rows):
    asked = models.ask_all(rows.withColumn("content", F.lit(b"x")), Never, "p", tasks=1).select("flash_reply", "flash_error").distinct().collect()
    assert [tuple(r) for r in asked] == [(None, "no key")]
    services = batch.Services(Net, decode, Sure, Never)
    one = spark.createDataFrame([(1, "http://host/crash")], "row_index int, url string")
    found, _ = batch.verified(one, services, None, None, F.lit("2024-05-01").cast("timestamp"))
    r = found.first()
    assert (r.validation_status, r.exit_layer, r.error_reason) == ("Invalid", 5, "AI pipeline error (graceful): no key")


def test_screened_follows_the_order(spark):
    """Against the rule row by row: copies of a row that did not register match what it matched, or better."""
    rng = np.random.default_rng(11)
    base = [rng.integers(0, 1 << 32, 6) for _ in range(4)]
    rows = []
    for seq in range(60):
        h = base[rng.integers(4)].copy()
        for _ in range(rng.integers(0, 9)):
            h[rng.integers(6)] ^= 1 << int(rng.integers(32))
        copy = rows[rng.integers(len(rows))] if rows and rng.random() < 0.4 else None
        rows.append((seq, f"i{seq}", copy[2] if copy else f"m{seq}", seq < 3, *(copy[4:] if copy else [int(x) for x in h])))
    rows = [r if not r[3] else (*r[:2], f"old{r[0]}", *r[3:]) for r in rows]
    parts = [f"{n}_{s}" for n in duplicates.HASHES for s in ("hi", "lo")]
    df = spark.createDataFrame(rows, "seq long, image_id string, md5 string, old boolean, " + ", ".join(f"{p} long" for p in parts))
    records, new = duplicates.screened(df)
    cache, want = [r for r in rows if r[3]], {}
    for r in rows[3:]:
        same = [c for c in cache if c[2] == r[2]]
        best = None
        for c in cache:
            d = [sum(bin(r[4 + 2 * k + s] ^ c[4 + 2 * k + s]).count("1") for s in (0, 1)) for k in range(3)]
            v = sum(x <= y for x, y in zip(d, (6, 8, 5), strict=True))
            rank = (v, sum(max(0.0, 1 - x / y) for x, y in zip(d, (6, 8, 5), strict=True)) / 3)
            if v >= 2 and (best is None or rank > best[0]):
                best = rank, c[1]
        if same:
            want[r[1]] = ("Exact Duplicate", same[0][1])
        elif best:
            want[r[1]] = ("Perceptual Duplicate", best[1])
        else:
            cache.append(r)
    assert {r.image_id: (r.status, r.match_id) for r in records.collect()} == want and len(want) > 20
    assert {r.image_id for r in new.collect()} == {c[1] for c in cache[3:]}

"""Vision models behind an interface: retries, waits and usage; a deterministic stand-in for tests."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaqc.functions import calls


class Model(Protocol):
    """Answers a prompt about an image with (text, prompt tokens, output tokens), or raises."""

    name: str

    def ask(self, prompt: str, image: bytes) -> tuple[str, int, int]: ...


def wait(attempt: int, limited: bool, chance: random.Random) -> float:
    """Seconds before the next attempt: doubling up to 16, and a part by chance."""
    return min(2**attempt, 16) + chance.uniform(0.25, 2.0 if limited else 1.25)


def limited(error: Exception) -> bool:
    text = str(error).lower()
    return getattr(error, "code", None) == 429 or any(x in text for x in ("429", "rate limit", "resource exhausted", "quota"))


def reply(model: Model, prompt: str, image: bytes, attempts: int = 3, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> tuple[str | None, int, int]:
    """The first answer with text; an empty one is asked again at once, an error after a wait."""
    chance = random.Random(seed)
    for k in range(attempts):
        try:
            text, prompt_tokens, output_tokens = model.ask(prompt, image)
        except Exception as e:
            if k + 1 < attempts:
                sleep(wait(k, limited(e), chance))
            continue
        if text and text.strip() not in ("", "{}"):
            return text, prompt_tokens, output_tokens
    return None, 0, 0


def ask_all(
    df: DataFrame, make: Callable[[], Model], prompt: str | Column, image: str = "content", side: str = "flash", tasks: int = 8, sleep: Callable[[float], None] = time.sleep, flight: int = 5, rate: float | None = None,
) -> DataFrame:
    """Adds ``{side}_reply``, its tokens and ``{side}_error``. ``tasks`` times ``flight`` bounds the calls at a time (40 unless
    told otherwise), ``rate`` those a second in a task. Paid calls: write the result before going on, so that no later failure
    repeats them. ``prompt`` may differ by row. A client that cannot be made gives its rows an error text instead of a reply."""
    said = "said"
    while said in df.columns:
        said += "_"
    asked = df.withColumn(said, prompt if isinstance(prompt, Column) else F.lit(prompt))
    new = {"reply": "string", "prompt_tokens": "long", "output_tokens": "long", "error": "string"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        permits = calls.Permits(rate) if rate else None
        try:
            model, failed = make(), None
        except Exception as e:
            model, failed = None, str(e)

        def one(row: tuple[str, bytes]) -> tuple:
            if model is None:
                return None, 0, 0, failed
            if permits:
                permits.take()
            return (*reply(model, *row, sleep=sleep), None)

        for pdf in batches:
            found = list(calls.in_order(one, zip(pdf[said], pdf[image], strict=True), flight))
            for name, values in zip(new, zip(*found, strict=True) if found else [()] * len(new), strict=True):
                pdf[f"{side}_{name}"] = pd.Series(list(values), index=pdf.index, dtype=object)
            yield pdf.drop(columns=said)

    fields = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"{side}_{n} {t}" for n, t in new.items()])
    return asked.repartition(tasks).mapInPandas(run, fields)


class Fake:
    """Answers by a digest of the image, the same each time."""

    def __init__(self, name: str = "fake-flash", errors: int = 0):
        self.name, self.errors = name, errors

    def ask(self, prompt: str, image: bytes) -> tuple[str, int, int]:
        if self.errors > 0:
            self.errors -= 1
            raise RuntimeError("429 rate limit")
        h = hashlib.md5(image or b"").digest()
        answer = {"has_face": h[0] % 4 > 0, "has_required_branding": h[1] % 4 > 0, "is_screenshot": h[2] % 16 == 0, "confidence_score": h[3] / 255}
        return f"```json\n{json.dumps(answer)}\n```", len(prompt) // 4, 20


def token_totals(df: DataFrame, side: str) -> DataFrame:
    return df.withColumn(f"{side}_total_tokens", F.coalesce(f"{side}_prompt_tokens", F.lit(0)) + F.coalesce(f"{side}_output_tokens", F.lit(0)))

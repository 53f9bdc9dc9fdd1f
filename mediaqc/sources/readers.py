"""Readers: delimited files, workbooks, sheets, url lists, images; and fetching behind an interface."""

from __future__ import annotations

import importlib.util
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaqc.functions import calls
from mediaqc.functions.scalars import SHEET_ID, url_ok

MOST_BYTES = 20 * 1024 * 1024
IMAGE_GLOB = "*.{jpg,jpeg,png,webp,bmp,JPG,JPEG,PNG,WEBP,BMP}"


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A table with a header line; types are looked for where no schema is given."""
    options = {"header": True} if schema is not None else {"header": True, "inferSchema": True}
    return spark.read.csv(path, schema=schema, **options)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, by the driver: a workbook is one small file. Needs openpyxl."""
    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("reading workbooks needs openpyxl")
    return spark.createDataFrame(pd.read_excel(path))


#: What reads a file, by the end of its name.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"csv": read_csv, "xlsx": read_excel, "xlsm": read_excel, "xls": read_excel}


def read_table_file(spark: SparkSession, path: str) -> DataFrame:
    reader = READERS.get(path.rpartition(".")[2].lower())
    if reader is None:
        raise ValueError(f"no reader for {path}; there are readers for {', '.join(READERS)}")
    return reader(spark, path)


class SheetClient(Protocol):
    """A client of an online sheet service."""

    def records(self, sheet: str) -> list[dict]: ...

    def append_tab(self, sheet: str, title: str, rows: list[list]) -> None: ...


def read_sheet(spark: SparkSession, client: SheetClient, address: str) -> tuple[DataFrame, str]:
    """The records of a sheet and its id; ``address`` is the id itself or any address that holds it."""
    found = re.search(SHEET_ID, address)
    sheet = found[1] if found else address.strip()
    return spark.createDataFrame(pd.DataFrame(client.records(sheet))), sheet


#: Tables that a session may be asked for, by kind of source.
SOURCES: dict[str, Callable] = {}


def source(kind: str):
    """Registers a reader for a kind of source."""

    def add(reader: Callable) -> Callable:
        SOURCES[kind] = reader
        return reader

    return add


def read_source(spark: SparkSession, kind: str, *where, **options) -> DataFrame:
    """Rows to verify from any kind of source."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind}; known are {', '.join(sorted(SOURCES))}")
    return SOURCES[kind](spark, *where, **options)


@source("urls")
def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that begin with http."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url").startswith("http"))


@source("images")
def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; files that cannot be decoded are left out."""
    return spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", IMAGE_GLOB).load(path).select("image.*")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).load(path)


SOURCES |= {"table": read_table_file, "sheet": lambda spark, client, address: read_sheet(spark, client, address)[0]}


class Fetcher(Protocol):
    """Gets (content type, bytes) of a url, or raises."""

    def get(self, url: str) -> tuple[str, bytes]: ...


def fetch(
    df: DataFrame, make: Callable[[], Fetcher], url: str = "url", attempts: int = 2, pause: float = 1.5, sleep=time.sleep, flight: int = 8, rate: float | None = None, most: int = 64 << 20,
) -> DataFrame:
    """Adds ``content`` and ``load_ok``, in place of columns of these names. Urls not worth fetching are not asked for.

    A task has one client (of whose ``get`` up to ``flight`` run at a time), at most ``rate`` calls a second, and hands rows on
    whenever their contents reach ``most`` bytes.
    """
    kept = df.drop("content", "load_ok")
    flag = "ok"
    while flag in kept.columns:
        flag += "_"
    ready = kept.withColumn(flag, url_ok(F.col(url)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, permits = make(), calls.Permits(rate) if rate else None

        def one(row: tuple[str, bool]) -> bytes | None:
            address, ok = row
            for k in range(attempts if ok else 0):
                try:
                    if permits:
                        permits.take()
                    kind, content = client.get(address)
                except calls.Refused:
                    return None
                except Exception:
                    if k + 1 < attempts:
                        sleep(pause * 2**k)
                    continue
                return None if "html" in kind.lower() or "json" in kind.lower() or len(content) > MOST_BYTES else content
            return None

        for pdf in batches:
            found = calls.in_order(one, zip(pdf[url], pdf[flag], strict=True), flight)
            for rows, contents in calls.answered(pdf.drop(columns=flag), found, lambda c: len(c or b""), most):
                yield rows.assign(content=pd.Series(contents, index=rows.index, dtype=object), load_ok=[c is not None for c in contents])

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return ready.mapInPandas(run, f"{fields}, content binary, load_ok boolean")

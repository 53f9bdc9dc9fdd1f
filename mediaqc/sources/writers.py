"""Writers: delimited files, JSON, workbooks, sheets."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaqc.operators import reports
from mediaqc.sources.readers import SheetClient


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line."""
    df.write.mode("overwrite").json(path)


#: Rows that fit in a sheet of a workbook, with the header.
SHEET_ROWS = 1_048_576


def write_workbook(df: DataFrame, path: str, sheet: str = "Results") -> int:
    """One workbook on the driver's file system, streamed a partition at a time; the number of rows. Needs openpyxl."""
    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("writing workbooks needs openpyxl")
    from openpyxl import Workbook

    book = Workbook(write_only=True)
    page = book.create_sheet(sheet)
    page.append(df.columns)
    n = 0
    for n, row in enumerate(df.toLocalIterator(), 1):
        if n >= SHEET_ROWS:
            raise ValueError(f"more than {SHEET_ROWS - 1} rows do not fit in a sheet; write delimited files instead")
        page.append([v if isinstance(v, (int, float, str, bool)) else "" if v is None else str(v) for v in row])
    book.save(path)
    return n


def write_reports(exported: DataFrame, path: str) -> None:
    """The whole table, its invalid rows, its duplicates and the cluster report."""
    status = "PV_Validation_Status"
    write_csv(exported, f"{path}/all")
    write_csv(reports.in_status(exported, "Invalid", "Pending Review", status=status), f"{path}/invalid")
    duplicates = reports.in_status(exported, "Duplicate", status=status)
    write_csv(duplicates, f"{path}/duplicates")
    clusters = {
        "PV_Cluster_ID": "Cluster_ID", "PV_Image_ID": "Duplicate_ID", "PV_Matched_Image_ID": "Original_ID", "PV_Original_Status": "Original_Status",
        "PV_Duplicate_Status": "Match_Type", "PV_Similarity_Score_%": "Similarity_%", "PV_Exit_Layer": "Layer",
    }
    write_csv(duplicates.select(*[F.col(a).alias(b) for a, b in clusters.items()]).orderBy("Cluster_ID", "Duplicate_ID"), f"{path}/clusters")


def write_sheet(df: DataFrame, client: SheetClient, sheet: str, title: str, page: int = 1000) -> int:
    """Header and rows in tabs of at most ``page`` lines, streamed a partition at a time; the number of rows. The first tab
    has the title, each further one the title and its number."""
    rows, n, tabs = [df.columns], 0, 0

    def put() -> None:
        client.append_tab(sheet, title if tabs == 0 else f"{title} ({tabs + 1})", rows)

    for row in df.toLocalIterator():
        if len(rows) >= page:
            put()
            rows, tabs = [df.columns], tabs + 1
        rows.append(["" if v is None else v for v in row])
        n += 1
    put()
    return n

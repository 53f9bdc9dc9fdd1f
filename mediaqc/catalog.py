"""The queries over the driver tables, by name, and their SQL twins."""

from __future__ import annotations

from mediaqc.plans import dedup_queries, image_queries, keypoint_queries, report_queries, rule_queries

_MODULES = [dedup_queries, image_queries, keypoint_queries, rule_queries, report_queries]


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.ORACLE.items()}

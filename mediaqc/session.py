"""Settings that a session for these queries should have."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Generated methods of more bytes than this are never compiled by the JVM; stages with such methods run faster as separate
#: projections, which Spark makes of them at this limit.
HUGE_METHOD = "8000"


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    return builder.config("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")

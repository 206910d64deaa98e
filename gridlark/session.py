"""A session with the settings that the library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC and ANSI fix results; AQE splits skewed joins and sizes shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "gridlark", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map={**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}).getOrCreate()

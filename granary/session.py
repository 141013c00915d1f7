"""Spark sessions with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",  # a key's last value counts, as in field codes
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),  # a Python worker holds a batch at a time, and rows can be long
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.pushdown.inFilterThreshold": "400",  # asked terms reach the scan of stored postings
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "granary", **extra: str) -> SparkSession:
    return configure(SparkSession.builder.appName(app).config(map={**SETTINGS, **extra}).getOrCreate())

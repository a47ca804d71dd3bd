"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Days are UTC, shuffles adapt to their size, and history is overwritten by day.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark

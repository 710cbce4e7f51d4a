"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.caseSensitive": "true",  # field names differ by case
    "spark.sql.variant.allowDuplicateKeys": "true",  # the last one counts
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",  # later bindings overwrite fields in SELECT *
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark

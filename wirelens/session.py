"""Session settings that results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings and register the capture source."""
    from wirelens.sources.har import HarDataSource

    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    spark.dataSource.register(HarDataSource)
    return spark

"""The session's settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
}


def session(cores: str | int = "*", **more: str) -> SparkSession:
    """The active session, or a local one."""
    active = SparkSession.getActiveSession()
    if active:
        return active
    builder = SparkSession.builder.master(f"local[{cores}]").appName("prismetric").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    spark = builder.config(map=SETTINGS | more).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

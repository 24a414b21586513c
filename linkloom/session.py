"""A session with the settings that the plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, **settings: str) -> SparkSession:
    """AQE with skew-join splitting on, UTC; everything else is the cluster's."""
    builder = SparkSession.builder.appName("linkloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return (builder.master(master) if master else builder).getOrCreate()

"""A Spark session with the settings the pipeline is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app: str = "shelfmetrics", master: str | None = None, **settings
) -> SparkSession:
    """Adaptive execution sizes and splits the shuffles; times are read as UTC.

    ``settings`` take dots as double underscores: ``spark__sql__shuffle__partitions=8``.
    On a cluster set ``spark.checkpoint.dir`` to a folder that all executors share.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), str(value))
    return builder.getOrCreate()

"""Sessions the engine expects: UTC, ANSI arithmetic, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "keyweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session; ``conf`` keys use ``__`` for dots. Cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in (wanted | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

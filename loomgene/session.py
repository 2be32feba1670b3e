"""Sessions tuned for wide genotype tables."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loomgene", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and Arrow; conf overrides or adds settings."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

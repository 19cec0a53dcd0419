"""Session defaults: exact SQL semantics, UTC, all Parquet logical types readable, adaptive plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("colscope")
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def apply_defaults(spark: SparkSession) -> SparkSession:
    """The defaults on a session that someone else made; only settings that may change at run time."""
    for k, v in DEFAULTS.items():
        spark.conf.set(k, v)
    return spark

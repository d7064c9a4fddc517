"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Bytes of a batch that a Python stage is handed, at most, or one row more. Spark's own limit lets a worker hold 64 MB or 10,000 whole texts at once, and copies of them.
BATCH_BYTES = 4 * 2**20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Python stages of the session get batches of at most BATCH_BYTES from now on; a limit that the session has set stays."""
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def session(name: str = "passagework", **settings: str) -> SparkSession:
    """UTC dates, adaptive plans with skew-join splitting, Arrow for Python stages; further settings override these."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        _LIMIT: str(BATCH_BYTES),
    }
    return SparkSession.builder.appName(name).config(map=base | settings).getOrCreate()

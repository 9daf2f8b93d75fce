"""How much goes to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch that goes to Python; texts can be long, so these are far below Spark's defaults.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes at most in this session; a longer row goes alone."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))

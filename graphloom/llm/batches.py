"""How much Spark hands to Python at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS, BYTES = 1000, 32_000_000


def bound(spark: SparkSession) -> None:
    """Batches of texts are kept small, by rows and by bytes, so that a worker holds few of them at once.

    These are settings of the session, read when a query runs, so they stay set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))

"""Settings of the session that the operators need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch on its way to Python; Spark's own bound lets the batches of four workers fill an executor.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of Arrow batches to BATCH_BYTES, unless it is lower already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))

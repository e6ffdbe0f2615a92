"""Stored tables, columns by position and Arrow batches, as the text operators use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.sources.scratch import dropped, shared_folder, stored

__all__ = ["bounded_batches", "by_position", "dropped", "shared_folder", "stored"]


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named by their places, so that no name can clash or needs quoting, and the new name of each."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


#: Rows and bytes of text that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small in this session, since texts may be long: a batch is held in memory on both sides."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

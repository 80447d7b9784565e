"""Surface overlap kept up to date from a stream of rating parts.

Sufficient statistics are the only state of the engine that merges exactly, so a stream of
parts (one year and type each) appends its sums, and a reader adds up whatever has arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.summary import overlap, overlap_sums


def follow(parts: DataFrame, sums_path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's sums under its batch number, so that a replayed batch overwrites itself."""

    def keep(batch: DataFrame, number: int) -> None:
        overlap_sums(batch).write.mode("overwrite").parquet(f"{sums_path}/batch={number}")

    return parts.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, sums_path: str) -> DataFrame:
    return overlap(spark.read.parquet(sums_path))

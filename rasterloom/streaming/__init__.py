"""Batch functions over micro-batches. The operators have no streaming state of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def every_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply an operator to each micro-batch and write it under path/batch=<id>; a batch that is repeated after a failure overwrites itself."""

    def write(df: DataFrame, number: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()

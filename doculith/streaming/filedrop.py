"""A stream of dropped documents through the batch operators: a capability of its own, built on file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from doculith.plans.analysis import analyse


def watch(spark: SparkSession, folder: str, schema: str, checkpoint: str, store: Callable[[DataFrame, int], None], files: int = 100) -> StreamingQuery:
    """Analyses each new Parquet file of documents in a folder and hands every micro-batch to `store(rows, batch_id)`.

    The analysis is stateless, so no watermark is needed; `store` must be idempotent by batch id. Available files are
    taken `files` at a time, and the query ends when all are done.
    """
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return analyse(docs).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

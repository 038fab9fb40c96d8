"""Logs fed by a stream: operations append to a log's table, and consumers read the increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import since
from ..plans.evaluate import run
from ..sources.tables import LOG, read_log


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """Operations as they are appended to a folder of Parquet files."""
    return spark.readStream.schema(LOG).parquet(path)


def append(ops: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream of operations to a log's table; the checkpoint makes each batch count once."""
    return ops.writeStream.format("parquet").partitionBy("space").option("checkpointLocation", checkpoint).option("path", path).trigger(**(trigger or {"availableNow": True})).start()


def follow(spark: SparkSession, path: str, plan: dict, lower: int, upper: int | None = None) -> DataFrame:
    """A plan over what was asserted in (lower, upper] of a log: the increment that a consumer reads next."""
    return run(plan, since(read_log(spark, path), lower, upper), spark)

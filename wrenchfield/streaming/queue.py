"""Work queue and audit stream on Structured Streaming: checkpoints take the place of claiming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(jobs: DataFrame, limit: int = 1) -> DataFrame:
    """The oldest waiting jobs."""
    return jobs.where(F.col("status").isin("queued", "retry")).orderBy("id").limit(limit)


def arrivals(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, in micro-batches; a batch that is tried again replaces its own files only."""

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_actions(events: DataFrame, at: str = "created_at", late: str = "1 day") -> DataFrame:
    """Actions a day and type; events later than `late` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day"), "action_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "action_type", "n")

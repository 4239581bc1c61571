"""Structured Streaming: reward records that arrive in files, appended once each, and live health by agent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from routeloom.operators.collection import must_fit
from routeloom.sources.readers import append_once


def stream_jsonl(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def sink_once(stream: DataFrame, path: str, checkpoint: str, pool_version: str, agents: list[str], repetitions: int, key: str = "task_id") -> StreamingQuery:
    """Appends records whose key isn't in the table yet, so replayed batches write nothing twice.  Records of another plan stop the query."""

    def write(batch: DataFrame, _: int) -> None:
        must_fit(batch, pool_version, agents, repetitions)
        append_once(batch, path, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_health(calls: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts of calls, empties and errors by window and agent; windows close once the watermark has passed them."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    g = calls.withWatermark(time, late).groupBy(window.alias("w"), "agent")
    return g.agg(F.count("*").alias("n_calls"), F.sum(F.col("empty").cast("long")).alias("n_empty"), F.sum(F.col("error").isNotNull().cast("long")).alias("n_error")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "agent", "n_calls", "n_empty", "n_error")


def drain(query: StreamingQuery, then: Callable[[], None] | None = None) -> None:
    """Waits for a query that ends when its input is used up."""
    query.awaitTermination()
    if then:
        then()

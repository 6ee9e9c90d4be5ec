"""Structured Streaming around the batch operators: ledgers that grow, and scoring of arriving groups.

These are extensions: the batch operators are what is specified. Sessions here are event-time sessions by starts
(session_window), which differ from windows.sessions where durations vary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow_jsonl(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the JSON lines files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Score every micro-batch and write it under its number, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def first_seen(stream: DataFrame, key: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def event_sessions(stream: DataFrame, by: list[str], time: str, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    s = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(*by, s.alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

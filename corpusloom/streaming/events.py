"""Event streams: windowed counts with late data, sessions, and contamination of arriving texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import contamination


def read(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files as they arrive, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by window and type; windows close `late` after their end."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events by user and session: a session ends after a gap without any."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def contaminated(texts: DataFrame, idx: DataFrame, key: str) -> DataFrame:
    """Arriving texts' windows that a static index holds: a stream-static join, without state."""
    return contamination.grams(texts, [key]).join(idx.select("h").distinct(), "h").select(key, "h")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, then stop; started again it goes on where it ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

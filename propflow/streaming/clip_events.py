"""Clip and review events as streams: an extra over the batch operators.

The same rules as operators.clips and operators.quality, kept up to date while
events arrive.  Replays are dropped within a watermark; the last selection of a
scene is state, one small row a scene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, most_files: int = 100) -> DataFrame:
    """Events from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def without_replays(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, as long as a repeat comes within ``late`` of the first."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts(events: DataFrame, kind: str, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events of each kind in windows, tumbling or sliding, that late events can still reach."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = events.withWatermark(time, late).groupBy(window.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with no gap of ``gap`` or more."""
    window = F.session_window(time, gap)
    found = events.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")

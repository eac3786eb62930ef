"""Incremental fusion of frames, and event windows, as Structured Streaming queries.

Both work on any streaming source; the voxel state is a running aggregate per
cell, so it grows with the scanned volume and not with the number of frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoquilt.operators import cameras
from geoquilt.operators.spatial import XYZ, cells

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events of a growing Parquet folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def depth_stream(events: DataFrame) -> DataFrame:
    """Depth pixels (frame, row, col, d in metres) of an event stream; units are known, not guessed, in a stream."""
    i = F.col("event_id")
    return events.select(
        F.floor(i / 1000).alias("frame"), F.floor(i % 1000 / 40).alias("row"), (i % 1000 % 40).alias("col"), (F.col("value") / 100).alias("d")
    )


def running_voxels(depth: DataFrame, fx: float, fy: float, cx: float, cy: float, size: float, truncate: float = 2.5) -> DataFrame:
    """Running count and centroid of every occupied cell over all frames so far; for update or complete output."""
    points = cameras.back_project(depth, fx, fy, cx, cy, truncate)
    keyed = points.withColumns(dict(zip(("ix", "iy", "iz"), cells(size), strict=True)))
    return keyed.groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in XYZ])


def windowed_events(events: DataFrame, width: str, slide: str, lateness: str) -> DataFrame:
    """Count and sum per sliding window and type; events later than ``lateness`` are dropped by the watermark."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.window("ts", width, slide), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Sessions of each user: a new one begins after ``gap`` without an event."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", "user_id", "n")


def to_memory(df: DataFrame, name: str, mode: str) -> StreamingQuery:
    """Run a stream over what its source holds now, into an in-memory table; for tests."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

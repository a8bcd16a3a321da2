"""Structured Streaming forms of the timeline operators (an extension of the batch ones)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
STAGES = ("signup", "view", "click", "purchase", "error")


def events_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """A window is emitted once, when the watermark passes its end; later rows are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def hopping(events: DataFrame, size: str = "60 minutes", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"))


def latest_state(events: DataFrame) -> DataFrame:
    """One state per key: the last stage seen; ``error`` ends a job, which then stays as it is."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stage, at = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for name, ts in zip(rows["event_type"], rows["ts"]):
            if stage != "error":
                stage, at = name, int(ts.timestamp())
        state.update((stage, at))
        yield pd.DataFrame([(key[0], stage, at)], columns=["user_id", "stage", "at"])

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, stage string, at bigint", "stage string, at bigint", "update", "NoTimeout")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """A file sink with a checkpoint: after a restart every row is written exactly once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_segments(frames: DataFrame, size: str = "5 seconds", late: str = "0 seconds") -> DataFrame:
    """Segments of a stream of (video_id, ts, frame), each emitted once, as soon as a later frame completes it."""
    return frames.withWatermark("ts", late).groupBy("video_id", F.window("ts", size)).agg(F.count("*").alias("frames"), F.sort_array(F.collect_list("frame")).alias("held"))


def progress(query) -> dict:
    """Rows read so far, whether data waits, and the last trigger's time in milliseconds."""
    told = query.recentProgress
    rows = sum(p["numInputRows"] for p in told)
    return {"rows": rows, "waiting": bool(query.status["isDataAvailable"]), "last_ms": told[-1]["durationMs"].get("triggerExecution") if told else None}

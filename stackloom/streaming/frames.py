"""Streams of frames: the frame form is stateless, so steps run on streaming DataFrames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stackloom.functions.units import TO_NM
from stackloom.plans.frameplan import run_frames
from stackloom.plans.registry import Step


def process(frames: DataFrame, steps: list[Step], unit: str = "nm") -> DataFrame:
    """Steps on a stream of frames.  The unit is given: guessing it would need the whole stack."""
    if unit not in TO_NM:
        raise ValueError(f"{unit!r} is no length unit")
    if unit != "nm":
        frames = frames.withColumn("pixels", F.transform("pixels", lambda z: z * TO_NM[unit]))
    return run_frames(frames, steps)


def frame_rates(frames: DataFrame, time: str, late: str = "1 minute", window: str = "1 minute") -> DataFrame:
    """Frames by stack and event-time window; state older than the watermark is dropped."""
    return frames.withWatermark(time, late).groupBy("stack_id", F.window(time, window).alias("window")).agg(F.count("*").alias("frames"))


def to_parquet(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

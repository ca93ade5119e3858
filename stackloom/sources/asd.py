"""Binary multi-frame files (.asd), decoded by the public package AFMReader if it is there."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from stackloom.functions import units
from stackloom.stack import FrameStack


def load(spark: SparkSession, path: str | Path, channel: str = "TP") -> FrameStack:
    try:
        from AFMReader.asd import load_asd
    except ImportError as e:
        raise ImportError("reading .asd files needs the package AFMReader") from e
    frames, size, facts = load_asd(str(path), channel)
    return from_decoded(spark, np.asarray(frames, float), float(size), facts, channel, str(path))


def from_decoded(spark: SparkSession, frames: np.ndarray, pixel_size_nm: float, facts: dict, channel: str, path: str = "") -> FrameStack:
    """Topography (TP) is brought to nm by its guessed unit; frame_time is in milliseconds."""
    interval = float(facts["frame_time"]) / 1000
    rate = frames.shape[1] / interval if interval else None
    meta = [{"timestamp": i * interval, "line_rate": rate} for i in range(len(frames))]
    stack = FrameStack.from_numpy(spark, frames, pixel_size_nm, channel, path, meta)
    stack.pixels = units.by_channel(stack.pixels, channel)
    return stack

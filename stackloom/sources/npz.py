"""NPZ bundles: what the NPZ sink writes can be read again."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from stackloom.stack import FrameStack


def load(spark: SparkSession, path: str | Path, channel: str = "height_trace") -> FrameStack:
    with np.load(path, allow_pickle=False) as f:
        data, times = f["data"], f["timestamps"]
        meta = [{"timestamp": None if np.isnan(t) else float(t)} for t in times]
        return FrameStack.from_numpy(spark, data.astype(float), float(f["pixel_size_nm"]), str(f["channel"]), str(path), meta)


def seconds(times: list[float | None]) -> np.ndarray:
    """Times as numbers; NaN where there is none."""
    return np.fromiter((float("nan") if t is None else t for t in times), float, len(times))


def save(path: str | Path, stack: np.ndarray, pixel_size_nm: float, timestamps: list[float | None], channel: str) -> Path:
    """Compressed data float32, pixel_size_nm float32, timestamps float64 (NaN: none), channel as text."""
    path = Path(path).with_suffix(".npz")
    np.savez_compressed(path, data=stack.astype(np.float32), pixel_size_nm=np.float32(pixel_size_nm), timestamps=seconds(timestamps), channel=np.array(channel))
    return path

"""FrameStack: a handle on the lazy frames of one stack and what is known about it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import timestamps
from stackloom.model import FRAME_KEY, assemble_frames
from stackloom.plans.forms import FRAME, PIXEL, Faults, State


class FrameStack:
    """Complete frames numbered from 0, in pixel or frame form, with metadata on the driver (one dict for each frame)."""

    key = FRAME_KEY

    def __init__(self, pixels: DataFrame, n_frames: int, height: int, width: int, pixel_size_nm: float, channel: str, file_path: str = "", frame_metadata: list[dict[str, Any]] | None = None):
        if isinstance(pixel_size_nm, bool) or not isinstance(pixel_size_nm, (int, float)) or pixel_size_nm <= 0:
            raise ValueError("pixel_size_nm must be a number above 0")
        given = list(frame_metadata or [])
        if len(given) > n_frames:
            raise ValueError(f"metadata of {len(given)} frames for {n_frames}")
        self.n_frames, self.height, self.width = n_frames, height, width
        self.state = State(pixels, FRAME if "pixels" in pixels.columns else PIXEL, height, width)
        self.pixel_size_nm, self.channel, self.file_path = pixel_size_nm, channel, str(file_path)
        self.frame_metadata = given + [{} for _ in range(n_frames - len(given))]
        self.snapshots: dict[str, DataFrame] = {}
        self.masks: dict[str, DataFrame] = {}
        self.faults: Faults | None = None
        #: Reads frames low to high of what was loaded, for those who need a few of them.
        self.source: Callable[[int, int], DataFrame] | None = None
        self._loaded = self.state
        self._raw: State | None = None

    @classmethod
    def from_numpy(cls, spark: SparkSession, data: np.ndarray, pixel_size_nm: float, channel: str, file_path: str = "", frame_metadata: list[dict[str, Any]] | None = None) -> FrameStack:
        if not isinstance(data, np.ndarray):
            raise TypeError("data must be a numpy array")
        if data.ndim != 3:
            raise ValueError("data must have three dimensions: frame, row, column")
        n, h, w = data.shape
        import pyarrow as pa

        flat = pa.array(data.astype(float).ravel())
        table = pa.table({"stack_id": pa.array(["0"] * n), "frame_idx": pa.array(range(n), pa.int32()), "height": pa.array([h] * n, pa.int32()), "width": pa.array([w] * n, pa.int32()), "pixels": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h * w, pa.int32()), flat)})
        return cls(spark.createDataFrame(table), n, h, w, pixel_size_nm, channel, file_path, frame_metadata)

    @classmethod
    def load(cls, spark: SparkSession, path: str | Path, channel: str = "height_trace") -> FrameStack:
        from stackloom.sources.load import load_stack

        stack = load_stack(spark, path, channel)
        stack.frame_metadata = timestamps.normalised(stack.frame_metadata)
        return stack

    @property
    def image_shape(self) -> tuple[int, int]:
        return self.height, self.width

    @property
    def pixels(self) -> DataFrame:
        return self.state.to(PIXEL).rows

    @pixels.setter
    def pixels(self, rows: DataFrame) -> None:
        self.state = State(rows, PIXEL, self.height, self.width)

    def frames(self) -> DataFrame:
        """Frame form; as it is where no step asked for pixels."""
        return self.state.to(FRAME).rows

    def set_frames(self, frames: DataFrame) -> None:
        self.state = State(frames.select(*FRAME_KEY, "height", "width", "pixels"), FRAME, self.height, self.width)

    def keep_raw(self) -> None:
        if self._raw is None:
            self._raw = self.state
            self.snapshots["raw"] = self.pixels

    def restore_raw(self) -> DataFrame:
        if self._raw is None:
            raise KeyError("there is no raw snapshot")
        self.state = self._raw
        return self.pixels

    def _index(self, i: int) -> int:
        if not -self.n_frames <= i < self.n_frames:
            raise IndexError(f"frame {i} of {self.n_frames}")
        return i % self.n_frames

    def _between(self, low: int, high: int) -> State:
        """Frames low to high; of a stack that is still as loaded, nothing else is read."""
        rows = self.source(low, high) if self.source and self.state is self._loaded else self.state.rows.where(F.col("frame_idx").between(low, high - 1))
        return replace(self.state, rows=rows)

    def frame(self, i: int) -> np.ndarray:
        """One frame as an array."""
        i = self._index(i)
        rows = self._between(i, i + 1).to(FRAME).rows.first()
        return np.array(rows["pixels"]).reshape(self.height, self.width)

    def each_frame(self, rows: DataFrame | None = None) -> Iterator[np.ndarray]:
        """Frames in order, one at a time on the driver."""
        for r in assemble_frames(self.pixels if rows is None else rows).orderBy("frame_idx").toLocalIterator():
            yield np.array(r["pixels"]).reshape(self.height, self.width)

    def numpy(self, rows: DataFrame | None = None) -> np.ndarray:
        return np.array(list(self.each_frame(rows))).reshape(-1, self.height, self.width)

    def frames_with_metadata(self) -> Iterator[tuple[int, np.ndarray, dict[str, Any]]]:
        for i, f in enumerate(self.each_frame()):
            yield i, f, self.frame_metadata[i]

    def metadata(self, i: int) -> dict[str, Any]:
        if not 0 <= i < self.n_frames:
            raise IndexError(f"frame {i} of {self.n_frames}")
        return self.frame_metadata[i]

    def time_of(self, i: int) -> float | None:
        return self.metadata(i).get("timestamp")

    def channel_of(self, i: int) -> str:
        return self.metadata(i).get("channel", self.channel)

    def __len__(self) -> int:
        return self.n_frames

    def __getitem__(self, item: int | slice) -> np.ndarray | FrameStack:
        """An int gives that frame; a slice a stack numbered from 0, without snapshots and masks."""
        if isinstance(item, (int, np.integer)) and not isinstance(item, bool):
            return self.frame(int(item))
        if not isinstance(item, slice):
            raise TypeError("a stack is indexed by a number or a slice")
        chosen = range(*item.indices(self.n_frames))
        a, step = chosen.start, chosen.step
        low, high = (min(chosen), max(chosen)) if len(chosen) else (0, -1)
        at = F.col("frame_idx") - a
        rows = self._between(low, high + 1).rows.where(at % step == 0).withColumn("frame_idx", (at / step).cast("int"))
        return FrameStack(rows, len(chosen), self.height, self.width, self.pixel_size_nm, self.channel, self.file_path, [self.frame_metadata[i] for i in chosen])

    def apply(self, names: list[str], **params: Any) -> DataFrame:
        from stackloom.plans.pipeline import apply_steps

        return apply_steps(self, names, **params)

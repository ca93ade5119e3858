"""Frames assembled from a stream of pixels, by ``transformWithState``.

Pixels of a frame may come in any order and over any number of micro-batches.  A frame is complete
when every place has a pixel; it then leaves at once, and its key remembers that until the
watermark has passed, so repeated and late pixels don't start it anew.  A frame that isn't complete
when the watermark passes its newest pixel by `grace` leaves with null where pixels are missing (or are NaN).

State of a frame: its pixels so far as packed numbers, one entry for each micro-batch that brought
any, and a bitmap of places.  It ends with the frame's timer, so state is bounded by the frames
that are open at a time.  Of repeated pixels the first that arrives counts, in a batch the first
row; pixels outside of the frame and null keys are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stackloom.model import FRAME_KEY

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "stack_id string, frame_idx int, height int, width int, pixels array<double>, missing int, complete boolean"


class Assembler(StatefulProcessor):
    def __init__(self, height: int, width: int, time: str, grace: timedelta):
        self.height, self.width, self.time, self.grace = height, width, time, int(grace.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getListState("cells", "places binary, z binary")
        self.seen = handle.getValueState("seen", "bits binary, newest bigint, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        size = self.height * self.width
        if self.seen.exists():
            bits, newest, done = self.seen.get()
        else:
            bits, newest, done = bytes(-(-size // 8)), -1, False
        have = np.unpackbits(np.frombuffer(bits, np.uint8), count=size).astype(bool)
        before, last = have.sum(), newest
        for part in rows:
            newest = max(newest, int(part[self.time].max().timestamp() * 1000))
            if done:
                continue
            y, x = part["y"].to_numpy(float), part["x"].to_numpy(float)
            inside = (y >= 0) & (y < self.height) & (x >= 0) & (x < self.width)
            places, first = np.unique((y[inside] * self.width + x[inside]).astype(np.int32), return_index=True)
            z = part["z"].to_numpy(float)[inside][first]
            new = ~have[places]
            if new.any():
                self.cells.appendValue((places[new].tobytes(), z[new].tobytes()))
                have[places[new]] = True
        if newest > last:
            if last >= 0:
                self.handle.deleteTimer(last + self.grace)
            self.handle.registerTimer(newest + self.grace)
        whole = not done and bool(have.all())
        if whole:
            yield self._frame(key)
            self.cells.clear()
        if whole or newest > last or have.sum() > before:
            self.seen.update((np.packbits(have).tobytes(), newest, done or whole))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            if not self.seen.get()[2]:
                yield self._frame(key)
            self.cells.clear()
            self.seen.clear()

    def _frame(self, key: Any) -> pd.DataFrame:
        z, have = np.full(self.height * self.width, np.nan), np.zeros(self.height * self.width, bool)
        for places, values in self.cells.get():
            at = np.frombuffer(places, np.int32)
            z[at], have[at] = np.frombuffer(values, float), True
        missing = int((~have).sum())
        return pd.DataFrame({"stack_id": [key[0]], "frame_idx": [int(key[1])], "height": [self.height], "width": [self.width], "pixels": [z], "missing": [missing], "complete": [missing == 0]})


def with_state_store(spark: SparkSession) -> SparkSession:
    """State of this kind needs the store that Spark keeps in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def assemble(pixels: DataFrame, height: int, width: int, time: str, late: str = "1 minute", grace: timedelta = timedelta(minutes=1)) -> DataFrame:
    """A stream of frames from a stream of (stack_id, frame_idx, y, x, z) with an event time.

    `late`: pixels older than the watermark are dropped; `grace`: how far it passes a frame's newest
    pixel before the frame leaves as it is.
    """
    rows = pixels.where(F.col("stack_id").isNotNull() & F.col("frame_idx").isNotNull() & F.col(time).isNotNull())
    rows = rows.select(*FRAME_KEY, "y", "x", F.col("z").cast("double").alias("z"), time).withWatermark(time, late)
    return rows.groupBy(*FRAME_KEY).transformWithStateInPandas(Assembler(height, width, time, grace), OUT, "append", "eventTime")

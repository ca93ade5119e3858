"""HDF5 containers of many frames (.h5-jpk); needs h5py on the driver and the executors.

All functions on groups need only mappings with ``attrs``, as h5py gives them.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

from stackloom.functions import units
from stackloom.model import explode_frames
from stackloom.sources import files
from stackloom.stack import FrameStack

#: Attribute names of the format: fixed values.
NAME, RETRACE = "channel.name", "retrace"
MULTIPLIER, OFFSET, UNIT = "net-encoder.scaling.multiplier", "net-encoder.scaling.offset", "net-encoder.scaling.unit.unit"
ILENGTH, JLENGTH, ULENGTH = "position-pattern.grid.ilength", "position-pattern.grid.jlength", "position-pattern.grid.ulength"
RATE = "timing-settings.scanRate"


def text(value: Any) -> str:
    return value.decode("utf-8") if isinstance(value, bytes) else str(value)


def truth(value: Any) -> bool:
    return text(value).strip().lower() == "true"


def channels(file: Mapping) -> dict[str, tuple[str, str]]:
    """Channel name to (measurement, channel group); of equal names the first counts."""
    out: dict[str, tuple[str, str]] = {}
    for m in sorted(k for k in file if k.startswith("Measurement_")):
        for c in sorted(k for k in file[m] if k.startswith("Channel_")):
            a = file[m][c].attrs
            out.setdefault(f"{text(a[NAME]).strip().lower()}_{'retrace' if truth(a.get(RETRACE, 'false')) else 'trace'}", (m, c))
    return out


def find(file: Mapping, channel: str) -> tuple[str, str, str]:
    """(measurement, group, dataset) of a channel."""
    known = channels(file)
    if channel not in known:
        raise ValueError(f"no channel {channel!r}; there are {', '.join(known)}")
    return *known[channel], channel.split("_")[0].capitalize()


def scaling(group: Any) -> tuple[float, float]:
    return float(group.attrs.get(MULTIPLIER, 1.0)), float(group.attrs.get(OFFSET, 0.0))


def unit_of(group: Any) -> str | None:
    try:
        return text(group.attrs.get(UNIT, 1.0))
    except Exception:
        return None


def shape(measurement: Any) -> tuple[int, int]:
    """(height, width); KeyError if the grid isn't described."""
    return int(measurement.attrs[JLENGTH]), int(measurement.attrs[ILENGTH])


def pixel_size(measurement: Any) -> float:
    n = float(measurement.attrs[ILENGTH])
    if n == 0:
        raise ValueError("a grid without columns has no pixel size")
    return float(measurement.attrs[ULENGTH]) / n * 1e9


def line_rate(measurement: Any) -> float:
    return float(measurement.attrs[RATE])


@contextlib.contextmanager
def opened(url: str | Path) -> Iterator[Any]:
    """The file at any URL, opened where it is read."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading .h5-jpk files needs the package h5py") from e
    where, path = files.at(url)
    with where.open_input_file(path) as raw, h5py.File(raw, "r") as f:
        yield f


def frame_count(file: Mapping) -> int:
    """Frames of the file: columns of the dataset of any channel."""
    return max((int(file[m][c][name.split("_")[0].capitalize()].shape[1]) for name, (m, c) in channels(file).items()), default=0)


def facts(file: Mapping, channel: str) -> tuple[tuple[int, int], float, float, float]:
    """(height, width), nm per pixel, line rate, and what turns the declared unit into nm."""
    m, c, _ = find(file, channel)
    return shape(file[m]), pixel_size(file[m]), line_rate(file[m]), units.TO_NM.get(unit_of(file[m][c]), 1.0)


def images(file: Mapping, channel: str, low: int, high: int, flip: bool = True) -> np.ndarray:
    """Frames low to high, scaled as the channel says."""
    m, c, name = find(file, channel)
    (a, b), (h, w) = scaling(file[m][c]), shape(file[m])
    z = np.asarray(file[m][c][name][:, low:high], float).T.reshape(-1, h, w) * a + b
    return z[:, ::-1] if flip else z


def load(spark: SparkSession, path: str | Path, channel: str = "height_trace", flip: bool = True) -> FrameStack:
    """Facts are read on the driver, pixels by the data source, ranges of frames (dataset columns) a task."""
    from stackloom.sources.datasource import FORMAT, register

    with opened(path) as f:
        m, c, name = find(f, channel)
        unit = unit_of(f[m][c])
        (h, w), size, rate, known = facts(f, channel)
        n = int(f[m][c][name].shape[1])
    read = lambda frames: register(spark).read.format(FORMAT).option("channel", channel).option("flip", flip).option("frames", frames).load(str(path)).select(*FrameStack.key, "height", "width", "pixels")
    meta = [{"timestamp": i * h / rate, "line_rate": rate} for i in range(n)]
    if unit not in units.TO_NM:
        return FrameStack(units.by_declared_unit(explode_frames(read(":")), unit), n, h, w, size, channel, str(path), meta)
    out = FrameStack(read(":"), n, h, w, size, channel, str(path), meta)
    out.source = lambda low, high: read(f"{low}:{high}")
    return out

"""Folders of .jpk files: TIFF containers, one frame each; read and written by the data source."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stackloom.sources import tiff
from stackloom.stack import FrameStack

#: Private TIFF tags of the format: fixed values.
GRID_ULENGTH, GRID_ILENGTH = 32834, 32838
CHANNEL_NAME, RETRACE = 32848, 32849
N_SLOTS, DEFAULT_SLOT, FIRST_SLOT, SLOT_SIZE = 32896, 32897, 32912, 48
SCALING_TYPE, SCALING, OFFSET = 32931, 32932, 32933
#: Channels stored in metres: fixed values.
LENGTHS = ("height", "measuredheight", "amplitude")

Image = Callable[[bool], np.ndarray]


def channels(raw: bytes) -> Iterator[tuple[str, tuple[int, int], float, float | None, Image]]:
    """Of each channel such as height_trace: name, (height, width), nm per pixel, line rate, and its frame in nm on demand."""
    all_pages = tiff.pages(raw)
    first = all_pages[0]
    size = float(first[GRID_ULENGTH][0]) / float(first[GRID_ILENGTH][0]) * 1e9
    rate = float(first[tiff.SCAN_RATE][0]) if tiff.SCAN_RATE in first else None
    for tags in all_pages[1:]:
        if CHANNEL_NAME not in tags:
            continue
        name = f"{str(tags[CHANNEL_NAME][0]).strip().lower()}_{'trace' if not tags.get(RETRACE, (0,))[0] else 'retrace'}"

        def image(flip: bool, tags: dict = tags, name: str = name) -> np.ndarray:
            z = tiff.image(raw, tags)
            slots = range(int(tags.get(N_SLOTS, (0,))[0]))
            k = next((k for k in slots if tags.get(FIRST_SLOT + k * SLOT_SIZE) == tags.get(DEFAULT_SLOT)), None)
            if k is not None and str(tags.get(SCALING_TYPE + k * SLOT_SIZE, ("",))[0]).startswith("Linear"):
                z = z * float(tags[SCALING + k * SLOT_SIZE][0]) + float(tags[OFFSET + k * SLOT_SIZE][0])
            z = z * 1e9 if name.rpartition("_")[0] in LENGTHS else z
            return np.flipud(z) if flip else z

        yield name, (int(tags[tiff.LENGTH][0]), int(tags[tiff.WIDTH][0])), size, rate, image


def encode(z: np.ndarray, channel: str, pixel_size_nm: float, line_rate: float = 0.0) -> bytes:
    """A file of one channel, as a 64-bit page that channels() reads back; the first line is the lowest."""
    name, _, direction = channel.rpartition("_")
    h, w = z.shape
    data = np.flipud(z / 1e9 if name in LENGTHS else z).astype("<f8").tobytes()
    title = name.encode() + b"\0"
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))

    def page(tags: list[tuple[int, int, bytes]], last: bool) -> None:
        begin = len(out)
        tail = bytearray()
        where = begin + 6 + 12 * len(tags)
        out.extend(struct.pack("<H", len(tags)))
        for tag, kind, value in sorted(tags):
            n = len(value) // tiff.TYPES[kind][0]
            inline = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack("<I", where + len(tail))
            out.extend(struct.pack("<HHI", tag, kind, n) + inline)
            tail.extend(value if len(value) > 4 else b"")
        out.extend(struct.pack("<I", 0 if last else where + len(tail)) + tail)

    whole, real = (lambda v: struct.pack("<I", v)), (lambda v: struct.pack("<d", v))
    page([(GRID_ULENGTH, 12, real(pixel_size_nm * 1e-9 * w)), (GRID_ILENGTH, 4, whole(w)), *([(tiff.SCAN_RATE, 12, real(line_rate))] if line_rate else [])], False)
    tags = [(tiff.WIDTH, 4, whole(w)), (tiff.LENGTH, 4, whole(h)), (tiff.BITS, 3, struct.pack("<H", 64)), (tiff.FORMAT, 3, struct.pack("<H", 3)), (tiff.COUNTS, 4, whole(len(data))), (CHANNEL_NAME, 2, title), (RETRACE, 4, whole(direction == "retrace"))]
    behind = len(out) + 6 + 12 * (len(tags) + 1) + (len(title) if len(title) > 4 else 0)
    page([*tags, (tiff.OFFSETS, 4, whole(behind))], True)
    return bytes(out) + data


def load_folder(spark: SparkSession, folder: str | Path, channel: str = "height_trace", flip: bool = True) -> FrameStack:
    """All frames must have one shape and, within rounding, one pixel size; facts come first, and pixels are decoded once, by who uses them."""
    from stackloom.sources.datasource import FORMAT, register

    source = register(spark).read.format(FORMAT).option("channel", channel).option("flip", flip)
    facts = source.option("pixels", False).load(str(folder)).agg(F.count("*").alias("n"), F.count_distinct("height", "width").alias("shapes"), F.min("pixel_size_nm").alias("lo"), F.max("pixel_size_nm").alias("hi"), F.max("height").alias("h"), F.max("width").alias("w"), F.min_by("line_rate", "frame_idx").alias("rate")).first()
    if not facts["n"]:
        raise FileNotFoundError(f"{folder} has no .jpk files")
    if facts["shapes"] > 1:
        raise ValueError("the frames of this folder differ in shape")
    if not np.isclose(facts["lo"], facts["hi"]):
        raise ValueError("the frames of this folder differ in pixel size")
    rate = facts["rate"]
    meta = [{"timestamp": i * facts["h"] / rate if rate else None, "line_rate": rate} for i in range(facts["n"])]
    read = lambda frames: register(spark).read.format(FORMAT).option("channel", channel).option("flip", flip).option("frames", frames).load(str(folder)).select(*FrameStack.key, "height", "width", "pixels")
    out = FrameStack(read(":"), facts["n"], facts["h"], facts["w"], float(facts["lo"]), channel, str(folder), meta)
    out.source = lambda low, high: read(f"{low}:{high}")
    return out

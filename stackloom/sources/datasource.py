"""Stacks of frames as a Spark data source: ``spark.read.format("stackloom").load(url)``.

A row for each frame and channel of a folder of .jpk files or of one .h5-jpk file, at any URL that
``files`` opens.  A partition is a range of frames; its files are opened on the executor and each
is decoded once.  Frames and channels are asked for by options, so other files are never opened and
pages of other channels never decoded.  (Filters aren't pushed down: Spark 4.1 keeps what one query
has pushed to a Python source for every other use of the same DataFrame, which then lacks rows.)

channel        only this channel, and an error where a file lacks it (else all channels there are)
frames         low:high, numbers of the frames to read (else all); either may be left out
pixels         false: facts only, ``pixels`` is null and no page is decoded
flip           false: lines as they are stored (else the first line is the lowest)
framesPerTask  frames of a partition (64)

``df.write.format("stackloom").mode("append").save(folder)`` writes frames (height, width, pixels
in nm) as .jpk files of lossless 64-bit pages, one for each frame; every task writes its own.  A
rerun of a task writes the same files again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from stackloom.sources import files, h5jpk, jpk

FORMAT = "stackloom"
SCHEMA = "stack_id string, frame_idx int, channel string, height int, width int, pixel_size_nm double, line_rate double, path string, pixels array<double>"
_ARROW = pa.schema([("stack_id", pa.string()), ("frame_idx", pa.int32()), ("channel", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("pixel_size_nm", pa.float64()), ("line_rate", pa.float64()), ("path", pa.string()), ("pixels", pa.list_(pa.float64()))])
BATCH = 1 << 22  # pixels of a batch


@dataclass
class Frames(InputPartition):
    """Frames of one task: (number, file); for a file of many frames only the first and last count."""

    items: list[tuple[int, str]]


def _truth(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


class StackReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("load() needs the path of a folder or file")
        self.path = options["path"]
        self.channel = options.get("channel")
        self.pixels, self.flip = _truth(options, "pixels", True), _truth(options, "flip", True)
        self.size = int(options.get("framesPerTask", 64))
        low, _, high = str(options.get("frames", ":")).partition(":")
        self.low, self.high = int(low or 0), int(high) if high else None

    def _wanted(self, k: int) -> bool:
        return k >= self.low and (self.high is None or k < self.high)

    def partitions(self) -> list[Frames]:
        if self.path.lower().endswith(".h5-jpk"):
            with h5jpk.opened(self.path) as f:
                items = [(k, self.path) for k in range(h5jpk.frame_count(f)) if self._wanted(k)]
        else:
            found = [n for n in files.names(self.path) if n.lower().endswith(".jpk")]
            items = [(k, files.inside(self.path, n)) for k, n in enumerate(found) if self._wanted(k)]
        # not one partition of None, which would be read
        return [Frames(items[k : k + self.size]) for k in range(0, len(items), self.size)] or [Frames([])]

    def _asked(self, name: str) -> bool:
        return self.channel is None or name == self.channel

    def _rows(self, items: list[tuple[int, str]]) -> Iterator[tuple]:
        if items and items[0][1].lower().endswith(".h5-jpk"):
            yield from self._of_one_file(items)
            return
        for k, url in items:
            known = []
            for name, shape, size, rate, image in jpk.channels(files.read(url)):
                known.append(name)
                if self._asked(name):
                    yield k, name, *shape, size, rate, url, image(self.flip).ravel() if self.pixels else None
            if self.channel is not None and self.channel not in known:
                raise ValueError(f"no channel {self.channel!r}; there are {', '.join(known) or 'none'}")

    def _of_one_file(self, items: list[tuple[int, str]]) -> Iterator[tuple]:
        numbers = [k for k, _ in items]
        with h5jpk.opened(self.path) as f:
            if self.channel is not None:
                h5jpk.find(f, self.channel)
            for name in filter(self._asked, h5jpk.channels(f)):
                shape, size, rate, scale = h5jpk.facts(f, name)
                z = h5jpk.images(f, name, numbers[0], numbers[-1] + 1, self.flip) * scale if self.pixels else None
                for k in numbers:
                    yield k, name, *shape, size, rate, self.path, z[k - numbers[0]].ravel() if self.pixels else None

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        many = 0
        for row in self._rows(partition.items):
            held.append(row)
            many += row[2] * row[3]
            if many >= BATCH:
                yield self._batch(held)
                held, many = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        *facts, pixels = zip(*rows, strict=True)
        columns = [[self.path] * len(rows), *facts]
        out = [pa.array(c, t) for c, t in zip(columns, _ARROW.types[:-1], strict=True)]
        if not self.pixels:
            return pa.RecordBatch.from_arrays([*out, pa.nulls(len(rows), _ARROW.types[-1])], schema=_ARROW)
        stops = np.append(0, np.cumsum([len(p) for p in pixels])).astype(np.int32)
        return pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(pixels)))], schema=_ARROW)


class StackWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        if overwrite:
            raise ValueError("frames are added to a folder: write with mode append")
        lacking = {"frame_idx", "height", "width", "pixels"} - set(names)
        if lacking:
            raise ValueError(f"frames to write need {', '.join(sorted(lacking))}")
        self.folder = options["path"]
        self.channel, self.size, self.rate = options.get("channel", "height_trace"), float(options.get("pixelSizeNm", 1.0)), float(options.get("lineRate", 0.0))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, path = files.at(self.folder)
        where.create_dir(path)
        for b in batches:
            cols = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                k, h, w = (cols[c][i].as_py() for c in ("frame_idx", "height", "width"))
                z = np.asarray(cols["pixels"][i].values.to_numpy(zero_copy_only=False), float).reshape(h, w)
                # numbers of equal width keep the order of the names
                files.write(files.inside(self.folder, f"frame_{k:010d}.jpk"), jpk.encode(z, self.channel, self.size, self.rate))
        return WriterCommitMessage()


class StackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StackReader:
        return StackReader(self.options)

    def writer(self, schema, overwrite: bool) -> StackWriter:
        return StackWriter(self.options, schema.names, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session."""
    spark.dataSource.register(StackSource)
    return spark


def local_scratch(spark: SparkSession) -> str:
    """A new folder in the session's shared folder; a temporary one only where everything runs on this machine."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/stackloom-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="stackloom-"), "frames")

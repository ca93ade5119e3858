"""Data model: stacks of 2-D scalar frames as DataFrames, in frame form or pixel form.

Frame form has one row for each frame with its pixels as an array (place p = y * width + x);
pixel form has one row for each pixel.  Both are lazy, and a stack never has to fit anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FRAMES = T.StructType(
    [
        T.StructField("stack_id", T.StringType()),
        T.StructField("frame_idx", T.IntegerType()),
        T.StructField("timestamp_s", T.DoubleType()),
        T.StructField("line_rate", T.DoubleType()),
        T.StructField("channel", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("pixel_size_nm", T.DoubleType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("pixels", T.ArrayType(T.DoubleType())),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
FRAME_KEY = ["stack_id", "frame_idx"]
PIXEL_COLUMNS = [*FRAME_KEY, "y", "x", "z"]



def by_frame():
    """Window over a frame; made when a session is there."""
    return Window.partitionBy(*FRAME_KEY)


def by_row():
    return Window.partitionBy(*FRAME_KEY, "y")


def explode_frames(frames: DataFrame) -> DataFrame:
    """Frame form to pixel form, with the mask if there is one; width comes from each row."""
    carried = ["left"] if "left" in frames.columns else []
    if "mask" in frames.columns:
        p = frames.select(*FRAME_KEY, "width", *carried, F.posexplode(F.arrays_zip("pixels", "mask")).alias("p", "c"))
        value = [F.col("c.pixels").cast("double").alias("z"), F.col("c.mask").alias("mask")]
    else:
        p = frames.select(*FRAME_KEY, "width", *carried, F.posexplode("pixels").alias("p", "z"))
        value = [F.col("z").cast("double").alias("z")]
    return p.select(*FRAME_KEY, F.expr("p div width").cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), *value, *carried)


def assemble_frames(pixels: DataFrame, value: str = "z", name: str = "pixels") -> DataFrame:
    """Pixel form to (stack_id, frame_idx, height, width, pixels), and mask if there is one."""
    masked, carried = "mask" in pixels.columns, ["left"] if "left" in pixels.columns else []
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v"), *(["mask"] if masked else []))))
    rows = pixels.groupBy(*FRAME_KEY).agg(cells.alias("c"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), *[F.first(c).alias(c) for c in carried])
    masks = [F.transform("c", lambda c: c["mask"]).alias("mask")] if masked else []
    return rows.select(*FRAME_KEY, "height", "width", F.transform("c", lambda c: c["v"]).alias(name), *masks, *carried)


def rasterize(rows: DataFrame, stack: Column, frame: Column, y: Column, x: Column, value: Column, height: int, width: int, empty: float = 0.0) -> DataFrame:
    """Any table as complete frames: values are summed by cell, cells without rows get `empty`.

    Rows outside the grid or without a key are left out.  Values are pre-aggregated before the
    shuffle, and the grid is generated after it, frame by frame.
    """
    cells = rows.select(stack.cast("string").alias("stack_id"), frame.cast("int").alias("frame_idx"), y.cast("int").alias("y"), x.cast("int").alias("x"), value.cast("double").alias("z"))
    cells = cells.where(F.col("stack_id").isNotNull() & F.col("frame_idx").isNotNull() & F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    sums = cells.groupBy(*FRAME_KEY, "y", "x").agg(F.sum("z").alias("z"))
    at = (F.col("y") * width + F.col("x")).alias("p")
    known = sums.groupBy(*FRAME_KEY).agg(F.array_sort(F.collect_list(F.struct(at, "z"))).alias("c"))
    # gaps before each known cell and after the last one, filled by runs: no cell is looked up
    last = height * width
    gap = lambda n: F.array_repeat(F.lit(float(empty)), n.cast("int"))
    runs = F.transform("c", lambda c, i: F.concat(gap(c["p"] - F.when(i > 0, F.get("c", i - 1)["p"] + 1).otherwise(0)), F.array(c["z"])))
    dense = known.select(*FRAME_KEY, F.posexplode(F.concat(F.flatten(runs), gap(last - 1 - F.element_at("c", -1)["p"]))).alias("p", "z"))
    return dense.select(*FRAME_KEY, F.expr(f"p div {width}").cast("int").alias("y"), (F.col("p") % width).cast("int").alias("x"), "z")


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def flip_vertical(pixels: DataFrame, height: int) -> DataFrame:
    return pixels.withColumn("y", F.lit(height - 1) - F.col("y"))


def generate_timestamps(frames: DataFrame) -> DataFrame:
    """timestamp_s = frame_idx * height / line_rate; null where the line rate is null or 0."""
    return frames.withColumn("timestamp_s", F.col("frame_idx") * F.try_divide(F.col("height").cast("double"), F.col("line_rate")))


#: Frames whose numbers fall into one range are placed together.
RANGE = 4096


def frame_places(frames: DataFrame) -> DataFrame:
    """For each stack and range of frame numbers: `present` (its frames in order), `first` (frames before them) and `total`.

    Distributed numbering in two phases: counts by range, summed up along a stack's ranges, and
    places inside a range.  Only keys are read; a window sees one row for each RANGE numbers.
    """
    ranges = frames.select("stack_id", "frame_idx", _range().alias("__range")).groupBy("stack_id", "__range").agg(F.array_sort(F.collect_list("frame_idx")).alias("present"))
    by = Window.partitionBy("stack_id")
    size = F.size("present").cast("bigint")
    return ranges.withColumns({"first": F.sum(size).over(by.orderBy("__range")) - size, "total": F.sum(size).over(by)})


def _range() -> Column:
    return F.floor(F.col("frame_idx") / RANGE)


def slice_frames(frames: DataFrame, start: int | None, stop: int | None, step: int | None = 1) -> DataFrame:
    """Frames start:stop:step of every stack by frame order, renumbered from 0.

    Negative bounds count from the stack's end; a step below 1 isn't allowed.  Frames meet a row
    for their range of numbers, so their pixels are never sorted, and ranges outside of the slice
    are left out before.
    """
    step = 1 if step is None else step
    if step < 1:
        raise ValueError("a slice of frames needs a step of 1 or more")
    n = F.col("total")
    clip = lambda v, none: none if v is None else (F.least(F.lit(v), n) if v >= 0 else F.greatest(F.lit(0), n + v))
    places = frame_places(frames).withColumns({"__a": clip(start, F.lit(0)), "__z": clip(stop, n)})
    places = places.where((F.col("first") < F.col("__z")) & (F.col("first") + F.size("present") > F.col("__a")))
    places = places.select("stack_id", "__range", F.col("present").alias("__present"), F.col("first").alias("__first"), "__a", "__z")
    rows = frames.withColumn("__range", _range()).join(places.hint("shuffle_hash"), ["stack_id", "__range"])
    # every number below ours in the range stands before us
    rows = rows.withColumn("__at", F.col("__first") + F.array_position("__present", F.col("frame_idx")) - 1 - F.col("__a"))
    rows = rows.where((F.col("__at") >= 0) & (F.col("__at") < F.col("__z") - F.col("__a")) & (F.col("__at") % step == 0))
    number = F.expr(f"__at div {step}").cast("int")
    return rows.select(*[number.alias(c) if c == "frame_idx" else F.col(f"`{c}`") for c in frames.columns])


def attach_metadata(frames: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of per-frame metadata on the frame key; frames without any keep nulls.

    More metadata than frames is an error, raised when the rows are computed.
    """
    known = frames.select(*FRAME_KEY, F.lit(True).alias("__known"))
    joined = known.join(metadata, FRAME_KEY, "full")
    ok = F.when(F.col("__known").isNull(), F.raise_error("metadata for a frame that the stack doesn't have")).otherwise(F.lit(True))
    return frames.join(joined.where(ok).drop("__known"), FRAME_KEY, "left")

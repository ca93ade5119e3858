"""Mask generators on pixel form: each gives a boolean Column, true for foreground.

NaN compares as the greatest number in SQL; every comparison here is guarded so that NaN is
never foreground.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackloom.model import FRAME_KEY, by_frame, finite


def threshold_above(pixels: DataFrame, threshold: float = 0.0) -> tuple[DataFrame, Column]:
    return pixels, (F.col("z") > threshold) & finite(F.col("z"))


def threshold_below(pixels: DataFrame, threshold: float = 0.0) -> tuple[DataFrame, Column]:
    return pixels, (F.col("z") < threshold) & finite(F.col("z"))


def above_mean(pixels: DataFrame, factor: float = 1.0) -> tuple[DataFrame, Column]:
    """More than `factor` population standard deviations above the frame's mean."""
    z = F.col("z")
    return pixels, ~F.isnan(z) & (z - F.avg(z).over(by_frame()) > F.stddev_pop(z).over(by_frame()) * factor)


def above_tile_mean(pixels: DataFrame, block_size: int = 15, offset: float = 0.0) -> tuple[DataFrame, Column]:
    """Above the mean of its block_size x block_size tile, plus offset; tiles at the edge are smaller."""
    tile = Window.partitionBy(*FRAME_KEY, F.expr(f"y div {int(block_size)}"), F.expr(f"x div {int(block_size)}"))
    z = F.col("z")
    return pixels, ~F.isnan(z) & (z > F.avg(z).over(tile) + offset)


def closed_magnitude(pixels: DataFrame, threshold: float, structure_size: int = 3) -> tuple[DataFrame, Column]:
    """|z| over the threshold, closed with a square of structure_size; outside of the frame is background.

    Dilation and erosion by a square are each a pass along x and one along y.  What a block prefix
    and suffix maximum would give, a pass has from the nearest marked pixel on either side, so it
    costs the same for every size.  The passes along y follow each other and share a sort.
    """
    s = int(structure_size)
    back, ahead = s // 2, (s - 1) // 2

    def nearest(axis: str, other: str) -> tuple[Column, Column]:
        """Places of the pixels with __m next to each pixel, itself included."""
        line = Window.partitionBy(*FRAME_KEY, other).orderBy(axis)
        at = F.when(F.col("__m"), F.col(axis))
        before = F.max(at).over(line.rowsBetween(Window.unboundedPreceding, 0))
        # the next one is looked for once a gap, not once a pixel
        after = F.coalesce(at, F.expr(f"lead(CASE WHEN __m THEN {axis} END, 1) IGNORE NULLS OVER (PARTITION BY stack_id, frame_idx, {other} ORDER BY {axis})"))
        return before, after

    def dilated(rows: DataFrame, axis: str, other: str) -> DataFrame:
        before, after = nearest(axis, other)
        return rows.withColumn("__m", F.col("__b")).withColumns({"__l": before, "__r": after}).withColumn("__b", F.coalesce(F.col(axis) - F.col("__l") <= ahead, F.lit(False)) | F.coalesce(F.col("__r") - F.col(axis) <= back, F.lit(False)))

    def eroded(rows: DataFrame, axis: str, other: str) -> DataFrame:
        before, after = nearest(axis, other)
        end = F.max(axis).over(Window.partitionBy(*FRAME_KEY, other)) + 1
        rows = rows.withColumn("__m", ~F.col("__b")).withColumns({"__l": F.coalesce(before, F.lit(-1)), "__r": F.coalesce(after, end)})
        return rows.withColumn("__b", (F.col(axis) - F.col("__l") > back) & (F.col("__r") - F.col(axis) > ahead))

    z = F.col("z")
    rows = pixels.withColumn("__b", (F.abs(z) > threshold) & ~F.isnan(z))
    rows = eroded(eroded(dilated(dilated(rows, "x", "y"), "y", "x"), "y", "x"), "x", "y")
    return rows, F.col("__b")

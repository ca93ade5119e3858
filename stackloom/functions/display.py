"""Rendering as columns: 8-bit grey, padding, resizing, heat colours, scale bar and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.model import FRAME_KEY, by_frame, finite

BAR_HEIGHT, BAR_LEFT, BAR_UP = 5, 10, 20


def grey(pixels: DataFrame) -> DataFrame:
    """g in 0..255: each frame stretched from its least to its greatest value, cut to whole numbers.

    What isn't finite counts as 0; a constant frame is 0.
    """
    z = F.when(finite(F.col("z")), F.col("z")).otherwise(0.0)
    low, high = F.min(z).over(by_frame()), F.max(z).over(by_frame())
    rows = pixels.withColumns({"__z": z, "__lo": low, "__s": F.when(high - low < 2.220446049250313e-16, 0.0).otherwise(F.try_divide(F.lit(255.0), high - low))})
    g = F.when(F.col("__s") == 0.0, 0).otherwise(F.floor(F.col("__z") * F.col("__s") - F.col("__lo") * F.col("__s") + 1e-9))
    return rows.withColumn("g", F.greatest(F.lit(0), F.least(F.lit(255), g)).cast("int")).drop("__z", "__lo", "__s")


def placed(pixels: DataFrame, height: int, width: int, to_height: int, to_width: int, values: dict[str, float | int]) -> DataFrame:
    """Frames centred in a larger canvas; the first border is the smaller one.  `values`: the columns and what borders have.

    Each frame makes its own border cells, so there is no grid to join: shifted pixels and border
    cells are put together by a union.
    """
    down, right = (to_height - height) // 2, (to_width - width) // 2
    moved = pixels.select(*FRAME_KEY, (F.col("y") + down).cast("int").alias("y"), (F.col("x") + right).cast("int").alias("x"), *values)
    # the frame's first pixel stands for it; a complete grid has exactly one
    corner = pixels.where((F.col("y") == 0) & (F.col("x") == 0)).select(*FRAME_KEY, F.explode(F.sequence(F.lit(0), F.lit(to_height * to_width - 1))).alias("p"))
    cells = corner.select(*FRAME_KEY, F.expr(f"p div {to_width}").cast("int").alias("y"), (F.col("p") % to_width).cast("int").alias("x"), *[F.lit(v).cast(pixels.schema[c].dataType).alias(c) for c, v in values.items()])
    return moved.unionAll(cells.where(~(F.col("y").between(down, down + height - 1) & F.col("x").between(right, right + width - 1))))


def pad_square(pixels: DataFrame, height: int, width: int, border: float = 0.0) -> DataFrame:
    """Frames centred in a square of the longer side."""
    side = max(height, width)
    return placed(pixels, height, width, side, side, {"z": float(border)})


def fitting(height: int, width: int, to_height: int, to_width: int) -> tuple[int, int]:
    """The largest size of the same aspect inside of a window."""
    scale = min(to_width / width, to_height / height)
    return int(height * scale), int(width * scale)


def _overlap(target: Column, source: Column, n: int, to: int) -> Column:
    """How much of a target cell a source cell covers, in whole parts of 1 / n of the target."""
    return F.least((target + 1) * n, (source + 1) * to) - F.greatest(target * n, source * to)


def resize(pixels: DataFrame, height: int, width: int, to_height: int, to_width: int, values: list[str]) -> DataFrame:
    """Resampling by area, up or down: each new pixel is the mean of what it covers, weighted by the overlap.

    Separable: lines are arrays, resampled along x inside of the array; then each line goes to the
    new lines that it touches, and these add theirs up.  Overlaps are whole numbers, so no weight
    is rounded.
    """
    span = lambda k, n, to: F.sequence(F.floor(k * n / to).cast("int"), F.floor(((k + 1) * n - 1) / to).cast("int"))
    cells = F.array_sort(F.collect_list(F.struct("x", *[F.col(v).cast("double").alias(v) for v in values])))
    lines = pixels.groupBy(*FRAME_KEY, "y").agg(cells.alias("c"))

    def along(v: str) -> Column:
        one = lambda x: F.aggregate(span(x, width, to_width), F.lit(0.0), lambda a, k: a + F.get("c", k)[v] * _overlap(x, k, width, to_width)) / width
        return F.transform(F.sequence(F.lit(0), F.lit(to_width - 1)), one).alias(v)

    # a line without any new line doesn't exist: every source touches one at least
    dealt = lines.select(*FRAME_KEY, "y", F.struct(*[along(v) for v in values]).alias("line")).select(*FRAME_KEY, "y", "line", F.explode(span(F.col("y"), to_height, height)).alias("to"))
    parts = dealt.groupBy(*FRAME_KEY, "to").agg(F.array_sort(F.collect_list(F.struct("y", _overlap(F.col("to"), F.col("y"), height, to_height).alias("w"), "line"))).alias("p"))
    mean = lambda v, x: (F.aggregate("p", F.lit(0.0), lambda a, q: a + F.get(q["line"][v], x) * q["w"]) / height).alias(v)
    out = parts.select(*FRAME_KEY, F.col("to").cast("int").alias("y"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(to_width - 1)), lambda x: F.struct(x.alias("x"), *[mean(v, x) for v in values]))).alias("q"))
    return out.select(*FRAME_KEY, "y", "q.x", *[f"q.{v}" for v in values])


def in_window(coloured: DataFrame, height: int, width: int, to_height: int, to_width: int, values: list[str], border: int = 0) -> DataFrame:
    """Whole numbers of 0 to 255 resized to fit into a window, and letterboxed."""
    h, w = fitting(height, width, to_height, to_width)
    if h < 1 or w < 1:
        raise ValueError(f"a window of {to_height} x {to_width} has no room for frames of {height} x {width}")
    small = resize(coloured, height, width, h, w, values)
    small = small.select(*FRAME_KEY, "y", "x", *[F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col(v) + 0.5))).cast("int").alias(v) for v in values])
    return placed(small, h, w, to_height, to_width, dict.fromkeys(values, border))


def heat(grey_value: Column) -> Column:
    """struct<r, g, b> of the black-red-yellow-white scale of 256 colours."""
    k = grey_value.cast("int")
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("int")
    return F.struct(clip(2 * k).alias("r"), clip(2 * k - 128).alias("g"), clip(2 * k - 255).alias("b"))


def bar_pixels(bar_nm: float, pixel_size_nm: float, scale: float = 1.0) -> int:
    return int(bar_nm / pixel_size_nm * scale) if bar_nm > 0 else 0


def on_scale_bar(height: int, bar_nm: float, pixel_size_nm: float, scale: float = 1.0) -> Column:
    """Whether a pixel is part of the scale bar near the lower left corner; never without a bar."""
    n = bar_pixels(bar_nm, pixel_size_nm, scale)
    top = height - BAR_UP
    return F.col("y").between(top, top + BAR_HEIGHT) & F.col("x").between(BAR_LEFT, BAR_LEFT + n) if n > 0 else F.lit(False)


def with_scale_bar(coloured: DataFrame, height: int, bar_nm: float, pixel_size_nm: float, scale: float = 1.0) -> DataFrame:
    """rgb white on the bar."""
    white = F.struct(F.lit(255).alias("r"), F.lit(255).alias("g"), F.lit(255).alias("b"))
    return coloured.withColumn("rgb", F.when(on_scale_bar(height, bar_nm, pixel_size_nm, scale), white).otherwise(F.col("rgb")))


#: A 3 x 5 bitmap font, rows from the top: fixed values.
FONT = {
    "0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71122", "8": "75757", "9": "75717",
    ".": "00002", ":": "02020", "-": "00700", " ": "00000", "T": "72222", "i": "20222", "m": "00775", "e": "02764", "s": "03262", "n": "00655",
}


def on_text(text: Column, top: int, left: int, size: int = 1) -> Column:
    """Whether a pixel is part of a text that starts at (top, left); unknown characters look like a dash.

    The glyphs are a literal table; only pixels in the band of the text look into it.
    """
    glyphs = F.create_map(*[F.lit(v) for item in FONT.items() for v in item])
    line, column = F.floor((F.col("y") - top) / size), F.floor((F.col("x") - left) / size)
    letter = F.substring(text, (F.floor(column / 4) + 1).cast("int"), F.lit(1))
    bits = F.substring(F.coalesce(F.try_element_at(glyphs, letter), F.lit(FONT["-"])), (line + 1).cast("int"), F.lit(1)).cast("int")
    lit = F.floor(bits / F.pow(F.lit(2), 2 - column % 4)) % 2 == 1
    return F.when((line >= 0) & (line < 5) & (column >= 0) & (column % 4 < 3) & (letter != ""), lit).otherwise(F.lit(False))


def with_text(coloured: DataFrame, text: Column, top: int, left: int, size: int = 1) -> DataFrame:
    """rgb white on the text."""
    return coloured.withColumn("rgb", F.when(on_text(text, top, left, size), F.struct(*[F.lit(255).alias(c) for c in "rgb"])).otherwise(F.col("rgb")))


def time_text(seconds: Column) -> Column:
    return F.format_string("Time: %.2f s", seconds)


def frames_per_second(line_rate: Column, height: Column) -> Column:
    return F.coalesce(F.try_divide(line_rate, height), F.lit(1.0))

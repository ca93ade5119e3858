"""Flattening filters on pixel form.

Medians and means are windows over rows and frames; surfaces are fitted by moments, which are
aggregated, solved in the plan and joined back; smoothing exchanges borders of tiles.  Each takes
the pixels, whether they carry a ``mask`` (true: left out of the fit) and parameters, and replaces
z.  A frame on which a filter isn't defined keeps its values, and has FAILED true if that column is
there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.model import FRAME_KEY, by_frame, by_row, finite

NAN = float("nan")
FAILED = "__failed"


def _fitted(masked: bool, value: Column) -> Column:
    """value on pixels that take part in a fit, null elsewhere."""
    return F.when(~F.col("mask"), value) if masked else value


def row_median(pixels: DataFrame, masked: bool = False) -> DataFrame:
    """z minus its row's median (of the background, 0 for rows without any); NaN in a row spreads over it."""
    z = F.col("z")
    middle = F.coalesce(F.median(_fitted(masked, z)).over(by_row()), F.lit(0.0))
    spoilt = F.max(_fitted(masked, F.isnan(z).cast("int"))).over(by_row()) == 1
    return pixels.withColumn("z", z - F.when(spoilt, F.lit(NAN)).otherwise(middle))


def centre(pixels: DataFrame, masked: bool = False) -> DataFrame:
    """z minus the frame's mean, or that of its background; without background nothing changes."""
    z = F.col("z")
    mean = F.avg(_fitted(masked, z)).over(by_frame())
    rows = pixels.withColumn(FAILED, mean.isNull()) if masked else pixels
    return rows.withColumn("z", z - F.coalesce(mean, F.lit(0.0)))


def gram(n: int, degree: int) -> list[np.ndarray]:
    """Coefficients (lowest first, of the centred and scaled coordinate) of orthonormal polynomials on 0..n-1."""
    t = (np.arange(n) - (n - 1) / 2) / max((n - 1) / 2, 1)
    out: list[np.ndarray] = []
    for d in range(degree + 1):
        c = np.zeros(degree + 1)
        c[d] = 1
        for _ in range(2):  # twice is enough
            v = np.polynomial.polynomial.polyval(t, c)
            for b in out:
                c = c - (v @ np.polynomial.polynomial.polyval(t, b)) * b
                v = np.polynomial.polynomial.polyval(t, c)
        size = math.sqrt(float(v @ v))
        if size > 1e-9 * math.sqrt(n):
            out.append(c / size)
    return out


def _horner(t: Column, coefficients: list[Column]) -> Column:
    out = coefficients[-1]
    for c in coefficients[-2::-1]:
        out = out * t + c
    return out


def _scaled(axis: str, n: int) -> Column:
    """The coordinate from -1 to 1, as ``gram`` has it."""
    return (F.col(axis) - (n - 1) / 2) / max((n - 1) / 2, 1)


def solved(rows: Column, n: int) -> Column:
    """Solution of n normal equations, given as rows of n coefficients and a right-hand side.

    Elimination inside the plan.  What is left of a member is measured against 1, its square over
    the whole grid: a member that the ones before it make up on the background gets 0.
    """

    def eliminate(m: Column, k: Column) -> Column:
        pivot = F.get(m, k)
        p = F.get(pivot, k)
        cleared = F.transform(m, lambda row, i: F.when(i == k, F.transform(pivot, lambda v: v / p)).otherwise(F.zip_with(row, pivot, lambda a, b: a - F.get(row, k) / p * b)))
        without = F.transform(m, lambda row, i: F.when(i == k, F.transform(row, lambda v: F.lit(0.0))).otherwise(row))
        return F.when(p > 1e-12, cleared).otherwise(without)

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, eliminate), lambda row: F.get(row, n))


def detrend(pixels: DataFrame, height: int, width: int, order: int, masked: bool = False, least: int = 0, spoilt_unchanged: bool = True) -> DataFrame:
    """z minus its least-squares polynomial of total degree `order`, fitted by moments.

    Sums of products of orthonormal polynomials in x, and of z with them, are aggregated row by row
    and then frame by frame; the small system of each frame is solved in the plan, and its
    coefficients are joined back to the pixels, so nothing holds a frame.  Without a mask the system
    is its own solution.  Frames with fewer than `least` background pixels stay; so do those with a
    value in the fit that isn't finite, or they become NaN.
    """
    z, tx, ty = F.col("z"), _scaled("x", width), _scaled("y", height)
    px, py = gram(width, order), gram(height, order)
    members = [(i, d - i) for d in range(order + 1) for i in range(d, -1, -1) if i < len(px) and d - i < len(py)]
    n = len(members)
    at_x = [_horner(tx, [F.lit(float(v)) for v in c]) for c in px]
    at_y = [_horner(ty, [F.lit(float(v)) for v in c]) for c in py]
    sums = {f"z{i}": F.sum(_fitted(masked, z * v)) for i, v in enumerate(at_x)}
    if masked:
        sums |= {f"g{i}_{j}": F.sum(_fitted(True, at_x[i] * at_x[j])) for i in range(len(px)) for j in range(i, len(px))}
    facts = {"n": F.count(_fitted(masked, F.lit(1))), "bad": F.max(_fitted(masked, (~finite(z)).cast("int")))}
    by_line = pixels.groupBy(*FRAME_KEY, "y").agg(*[c.alias(k) for k, c in (sums | facts).items()])
    total = {"n": F.sum("n"), "bad": F.coalesce(F.max("bad"), F.lit(0))}
    total |= {f"r{k}": F.sum(F.col(f"z{i}") * at_y[j]) for k, (i, j) in enumerate(members)}
    if masked:
        total |= {f"m{k}_{m}": F.sum(F.col(f"g{min(i, a)}_{max(i, a)}") * at_y[j] * at_y[b]) for k, (i, j) in enumerate(members) for m, (a, b) in enumerate(members) if m >= k}
    by_frame_ = by_line.groupBy(*FRAME_KEY).agg(*[F.coalesce(c, F.lit(0.0 if k[0] in "rm" else 0)).alias(k) for k, c in total.items()])
    if masked:
        system = F.array(*[F.array(*[F.col(f"m{min(k, m)}_{max(k, m)}") for m in range(n)], F.col(f"r{k}")) for k in range(n)])
        found = by_frame_.withColumn("c", solved(system, n))
        weight = [F.get("c", k) for k in range(n)]
    else:
        found, weight = by_frame_, [F.col(f"r{k}") for k in range(n)]
    # the same surface as powers of the scaled coordinates, so that a pixel needs a multiplication for each
    power = {}
    for a in range(len(px[0])):
        for b in range(len(py[0])):
            terms = [w * float(px[i][a] * py[j][b]) for w, (i, j) in zip(weight, members, strict=True) if px[i][a] * py[j][b] != 0]
            if terms:
                power[a, b] = sum(terms[1:], terms[0]).alias(f"__p{a}_{b}")
    fits = found.select(*FRAME_KEY, *power.values(), F.col("n").alias("__n"), (F.col("bad") == 1).alias("__bad"))
    # one row for a frame: its side is hashed, so pixels aren't sorted
    rows = pixels.join(fits.hint("shuffle_hash"), FRAME_KEY)
    lines = [_horner(tx, [F.col(f"__p{a}_{b}") if (a, b) in power else F.lit(0.0) for a in range(len(px[0]))]) for b in range(len(py[0]))]
    few = F.col("__n") < least if masked else F.lit(False)
    value = F.when(few, z).when(F.col("__bad"), z if spoilt_unchanged else F.lit(NAN)).otherwise(z - _horner(ty, lines))
    return rows.select(*[value.alias("z") if c == "z" else F.col(c) for c in pixels.columns], (few | F.col("__bad") if spoilt_unchanged else few).alias(FAILED))


def plane(pixels: DataFrame, height: int, width: int, masked: bool = False) -> DataFrame:
    return detrend(pixels, height, width, 1, masked, least=3)


def polynomial(pixels: DataFrame, height: int, width: int, masked: bool = False, order: int = 2) -> DataFrame:
    if not isinstance(order, int) or isinstance(order, bool) or order < 1:
        return pixels.withColumn(FAILED, F.lit(True))  # not defined: every frame keeps its values
    return detrend(pixels, height, width, order, masked, least=(order + 1) * (order + 2) // 2, spoilt_unchanged=False)


def gaussian_weights(sigma: float) -> np.ndarray:
    """Normalised weights up to 4 sigma to either side."""
    r = int(4.0 * float(sigma) + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if r else np.ones(1)
    return w / w.sum()


def mirrored(i: Column, n: int) -> Column:
    """The place on an axis of n that i stands for; beyond an end the axis is mirrored, ends repeated."""
    m = F.pmod(i, F.lit(2 * n))
    return F.least(m, F.lit(2 * n - 1) - m)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once: inside of lambdas an expression would be made anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _weighted(values: list[Column]) -> Column:
    """Their sum as a balanced tree, which stays shallow for wide kernels."""
    while len(values) > 1:
        values = [values[k] + values[k + 1] if k + 1 < len(values) else values[k] for k in range(0, len(values), 2)]
    return values[0]


def tiles(pixels: DataFrame, height: int, width: int, tile: int, halo: int) -> DataFrame:
    """FRAME_KEY, tile, from (its first line), lines (arrays of cells): lines of a tile and of `halo` lines to either side.

    Only lines near a border go to two tiles (or more, if the halo is wider than a tile), so the
    one shuffle carries each pixel 1 + 2 * halo / tile times.  Cells are structs of x and the other
    columns.
    """
    many = -(-height // tile)
    own = [c for c in pixels.columns if c not in (*FRAME_KEY, "y")]
    low, high = F.greatest(F.lit(0), F.expr(f"(y - {halo}) div {tile}").cast("int")), F.least(F.lit(many - 1), F.expr(f"(y + {halo}) div {tile}").cast("int"))
    where = F.explode(F.sequence(low, high)) if many > 1 else F.lit(0)
    dealt = pixels.select("*", where.alias("__tile"))
    rows = dealt.groupBy(*FRAME_KEY, "__tile").agg(F.array_sort(F.collect_list(F.struct("y", "x", *[c for c in own if c != "x"]))).alias("__c"))
    line = F.sequence(F.lit(0), F.expr(f"int(size(__c) div {width}) - 1"))
    return rows.select(*FRAME_KEY, F.col("__tile").alias("tile"), F.get("__c", F.lit(0))["y"].alias("from"), F.transform(line, lambda k: F.slice("__c", k * width + 1, F.lit(width))).alias("lines"))


def smooth(pixels: DataFrame, height: int, width: int, sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing by halo exchange: tiles of lines with the borders of their neighbours, one shuffle.

    Lines are arrays, convolved along x and then across lines by array functions; a mask is
    carried, not used.  Frames are complete grids.
    """
    if sigma <= 0:
        return pixels
    w = gaussian_weights(sigma)
    r = len(w) // 2
    tile = max(64, 4 * r)
    t = tiles(pixels, height, width, tile, min(r, height))
    low = F.col("tile") * tile
    mine = F.sequence(low, F.least(low + tile, F.lit(height)) - 1)
    wide = lambda line: F.transform(F.sequence(F.lit(-r), F.lit(width + r - 1)), lambda i: F.get(line, mirrored(i, width))["z"])
    along = lambda line: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: _weighted([F.get(line, x + k) * float(v) for k, v in enumerate(w)]))

    def cells(lines: Column, across: Column, y: Column) -> Column:
        near = F.transform(F.sequence(y - r, y + r), lambda i: F.get(across, mirrored(i, height) - F.col("from")))
        value = lambda near, x: _weighted([F.get(F.get(near, F.lit(k)), x) * float(v) for k, v in enumerate(w)])
        return bound(near, lambda near: F.transform(F.get(lines, y - F.col("from")), lambda c, x: F.struct(c.alias("c"), value(near, x).alias("z"))))

    def tile_of(lines: Column) -> Column:
        across = F.transform(lines, lambda line: bound(wide(line), along))
        return bound(across, lambda across: F.flatten(F.transform(mine, lambda y: cells(lines, across, y))))

    out = t.select(*FRAME_KEY, F.explode(bound(F.col("lines"), tile_of)).alias("p"))
    new = {"z": F.col("p.z").alias("z")} | {k: F.col(k) for k in FRAME_KEY}
    return out.select(*[new.get(c, F.col(f"p.c.{c}")) for c in pixels.columns])

"""Plans of single steps: moments, halo tiles, closing by nearest pixels, numbering in two phases, rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom import model
from stackloom.functions import kernels
from stackloom.operators import filters, masks
from stackloom.stack import FrameStack

KEY = ["stack_id", "frame_idx"]


def pixels_of(spark, d, **more):
    rows = FrameStack.from_numpy(spark, np.asarray(d, float), 1.0, "c").pixels
    return rows.withColumns({k: v for k, v in more.items()})


def array_of(rows, shape, value="z"):
    out = np.full(shape, np.nan)
    for r in rows.select("frame_idx", "y", "x", F.col(value).cast("double").alias("v")).collect():
        out[r.frame_idx, r.y, r.x] = r.v
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shape,sigma", [((2, 150, 9), 1.0), ((2, 150, 5), 6.0), ((1, 3, 2), 5.0), ((3, 1, 1), 1.0), ((1, 70, 70), 0.1)])
def test_smoothing_over_tiles(spark, shape, sigma):
    d = np.random.default_rng(1).normal(size=shape)
    rows = pixels_of(spark, d, mask=F.col("z") > 0).repartition(3)
    out = filters.smooth(rows, *shape[1:], sigma)
    assert out.columns == rows.columns
    np.testing.assert_allclose(array_of(out, shape), kernels.smooth(d, sigma)[0], atol=1e-12)
    np.testing.assert_array_equal(array_of(out, shape, "mask"), d > 0)


def test_smoothing_is_one_shuffle(spark):
    rows = pixels_of(spark, np.zeros((1, 4, 4)))
    plan = plan_of(filters.smooth(rows, 4, 4, 2.0))
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 8, 40])
def test_closing_of_any_size(spark, size):
    d = np.random.default_rng(size).normal(size=(3, 11, 17))
    d[0, 4, 4], d[1] = np.nan, 5.0
    rows, mask = masks.closed_magnitude(pixels_of(spark, d), 1.2, size)
    got = array_of(rows.withColumn("m", mask), d.shape, "m")
    np.testing.assert_array_equal(got, kernels.closed_magnitude(d, 1.2, size)[0])
    # running frames only: no window looks at as many rows as the square is wide
    assert "RangeFrame, -" not in plan_of(rows.select("__b"))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_moments_of_any_background(spark, order):
    g = np.random.default_rng(order)
    d = g.normal(size=(7, 9, 12)) + np.arange(12) * 3 - np.arange(9)[:, None] ** 2
    m = g.random(d.shape) < 0.5
    m[1], m[2, 1:], m[3, :, 1:], m[4] = True, True, True, False
    m[5, ::2, ::2], d[6, 2, 2], m[6, 2, 2] = True, np.inf, False
    rows = pixels_of(spark, d).repartition(3)
    # the mask as rows of its own, so that it doesn't depend on z
    known = pixels_of(spark, m).select(*KEY, "y", "x", (F.col("z") > 0).alias("mask"))
    got = filters.detrend(rows.join(known, [*KEY, "y", "x"]), 9, 12, order, True, (order + 1) * (order + 2) // 2, False)
    want, ok = kernels.polynomial(d, m, order)
    want = np.where(ok[:, None, None], want, d)
    # a background of one line doesn't determine the surface away from it
    sure = ~m
    sure[[0, 1, 4, 5, 6]] = True
    np.testing.assert_allclose(array_of(got, d.shape)[sure], want[sure], atol=1e-6)
    failed = {r.frame_idx for r in got.where(filters.FAILED).select("frame_idx").distinct().collect()}
    assert failed == set(np.flatnonzero(~ok).tolist())
    np.testing.assert_allclose(array_of(filters.polynomial(rows, 9, 12, order=order), d.shape)[:6], kernels.polynomial(d, None, order)[0][:6], atol=1e-8)
    assert "Window" not in plan_of(got)


def test_raster_fills_gaps(spark):
    rows = spark.createDataFrame([("a", 0, 1, 1, 2.0), ("a", 0, 1, 1, 3.0), ("a", 0, 2, 3, 1.0), ("a", 1, 0, 0, 7.0), ("b", 0, 0, 2, 8.0), ("b", 0, 9, 0, 1.0), (None, 0, 0, 0, 1.0)], "s string, f int, y int, x int, v double")
    out = model.rasterize(rows, *(F.col(c) for c in "sfyxv"), 3, 4, -1.0)
    got = {(r.stack_id, r.frame_idx, r.y, r.x): r.z for r in out.collect()}
    known = {("a", 0, 1, 1): 5.0, ("a", 0, 2, 3): 1.0, ("a", 1, 0, 0): 7.0, ("b", 0, 0, 2): 8.0}
    assert got == {(s, f, y, x): known.get((s, f, y, x), -1.0) for s, f in (("a", 0), ("a", 1), ("b", 0)) for y in range(3) for x in range(4)}


@pytest.mark.parametrize("bounds", [(None, None, None), (3, -2, 4), (-3, None, 1), (0, 0, 1), (5, 500, 2), (-500, 2, 1), (7, 3, 1)])
def test_slices_across_ranges(spark, monkeypatch, bounds):
    monkeypatch.setattr(model, "RANGE", 5)
    numbers = {"a": [*range(0, 40, 3), 100, 1000], "b": [7], "c": list(range(12))}
    frames = spark.createDataFrame([(s, i, [float(i)], "x") for s, ns in numbers.items() for i in ns], "stack_id string, frame_idx int, pixels array<double>, total string")
    out = model.slice_frames(frames, *bounds)
    assert out.columns == frames.columns
    got = sorted((r.stack_id, r.frame_idx, r.pixels[0]) for r in out.collect())
    assert got == sorted((s, k, float(i)) for s, ns in numbers.items() for k, i in enumerate(ns[slice(*bounds)]))


def test_slices_sort_no_pixels(spark):
    frames = spark.createDataFrame([("a", 1, [1.0])], "stack_id string, frame_idx int, pixels array<double>")
    for line in plan_of(model.slice_frames(frames, 0, 1)).splitlines():
        assert not ("Sort [" in line and "pixels" in line) and not ("Window [" in line and "pixels" in line)
    with pytest.raises(ValueError):
        model.slice_frames(frames, 0, 1, 0)

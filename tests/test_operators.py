"""Operators on pixel form and frame form against known results and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.functions import kernels
from stackloom.model import attach_metadata, rasterize, slice_frames
from stackloom.plans.frameplan import run_arrays, run_frames
from stackloom.plans.pixelplan import run_pixels, without_dead_masks
from stackloom.plans.registry import Step, resolve
from stackloom.plans.steps import DEFAULT_STEPS, parse_steps
from stackloom.stack import FrameStack


def pixel_form(spark, data, steps, mask=None, combine="or"):
    """Run steps on pixel form; (data, mask or None)."""
    stack = FrameStack.from_numpy(spark, np.asarray(data, float), 1.0, "c")
    rows = stack.pixels
    if mask is not None:
        m = FrameStack.from_numpy(spark, np.asarray(mask, float), 1.0, "c").pixels
        rows = rows.join(m.select("frame_idx", "y", "x", (F.col("z") == 1).alias("mask")), ["frame_idx", "y", "x"])
    state = run_pixels(rows, stack.height, stack.width, steps, combine)
    got = state.pixels.toPandas().sort_values(["frame_idx", "y", "x"])
    shape = np.asarray(data).shape
    return got["z"].to_numpy(float).reshape(shape), got["mask"].to_numpy(bool).reshape(shape) if state.has_mask else None


def frame_form(data, steps, mask=None, combine="or"):
    out, m, _ = run_arrays(np.asarray(data, float), [(resolve(s.name), s.params) for s in steps], None if mask is None else np.asarray(mask, bool), combine)
    return out, m


def both(spark, data, text, mask=None):
    steps = parse_steps(text)
    a, b = pixel_form(spark, data, steps, mask), frame_form(data, steps, mask)
    np.testing.assert_allclose(a[0], b[0], atol=1e-8)
    if a[1] is not None:
        np.testing.assert_array_equal(a[1], b[1])
    return a


def grid(h, w):
    return np.mgrid[0:h, 0:w].astype(float)


def test_row_medians(spark):
    z, _ = both(spark, [[[1, 2, 3], [4, 5, 6]]], "row_median_align")
    np.testing.assert_allclose(z, [[[-1, 0, 1], [-1, 0, 1]]])
    z, _ = both(spark, [[[1, 2, 3], [4, 5, 6], [7, 8, 9]]], "row_median_align", [[[0, 1, 0]] * 3])
    np.testing.assert_allclose(z, [[[-1, 0, 1]] * 3])
    z, _ = both(spark, [[[1, 2], [3, 4]]], "row_median_align", [[[1, 1], [0, 0]]])
    np.testing.assert_allclose(z, [[[1, 2], [-0.5, 0.5]]])


def test_nan_spreads_over_its_row(spark):
    z, _ = both(spark, [[[1, np.nan, 3], [4, 5, 6]]], "row_median_align")
    assert np.isnan(z[0, 0]).all() and not np.isnan(z[0, 1]).any()


def test_plane(spark):
    y, x = grid(5, 7)
    z, _ = both(spark, [2 * x + 3 * y + 5, x - y], "remove_plane")
    np.testing.assert_allclose(z, 0, atol=1e-9)
    m = np.zeros((2, 5, 7))
    m[:, 2, 2] = 1
    data = np.stack([2 * x + 3 * y + 5] * 2)
    data[:, 2, 2] += 9
    z, _ = both(spark, data, "remove_plane", m)
    np.testing.assert_allclose(z, 9 * m, atol=1e-9)


def test_plane_needs_three_background_pixels(spark):
    m = np.ones((1, 4, 4))
    m[0, 0, :2] = 0
    data = np.arange(16.0).reshape(1, 4, 4)
    z, _ = both(spark, data, "remove_plane", m)
    np.testing.assert_allclose(z, data)


def test_plane_with_infinite_value_stays(spark):
    data = np.arange(16.0).reshape(1, 4, 4)
    data[0, 1, 1] = np.inf
    z, _ = both(spark, data, "remove_plane")
    np.testing.assert_array_equal(z, data)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_polynomials(spark, order):
    y, x = grid(9, 8)
    f = 3 + 2 * x + 5 * y
    if order > 1:
        f = f + 1.5 * x**2 - 0.5 * x * y + 2 * y**2
    if order > 2:
        f = f + 0.1 * x**3 - 0.2 * x**2 * y + 0.3 * x * y**2 - 0.4 * y**3
    z, _ = both(spark, f[None], f"polynomial_flatten:order={order}")
    np.testing.assert_allclose(z, 0, atol=1e-7)


@pytest.mark.parametrize("order", ["0", "-1", "2.0"])
def test_invalid_order_changes_nothing(spark, order):
    y, x = grid(4, 4)
    z, _ = both(spark, (x * y)[None], f"polynomial_flatten:order={order}")
    np.testing.assert_allclose(z[0], x * y)


def test_masked_polynomial_is_least_squares(spark):
    g = np.random.default_rng(1)
    data, mask = g.normal(size=(3, 6, 7)), g.random((3, 6, 7)) < 0.3
    z, _ = both(spark, data, "polynomial_flatten:order=2", mask)
    y, x = (v.ravel() for v in grid(6, 7))
    a = np.stack([x**i * y**j for i in range(3) for j in range(3 - i)], 1)
    for k in range(3):
        keep = ~mask[k].ravel()
        c = np.linalg.lstsq(a[keep], data[k].ravel()[keep], rcond=None)[0]
        np.testing.assert_allclose(z[k].ravel(), data[k].ravel() - a @ c, atol=1e-8)


def test_degenerate_frames(spark):
    for shape in ((1, 1, 1), (1, 1, 5), (1, 5, 1)):
        both(spark, np.arange(np.prod(shape), dtype=float).reshape(shape) ** 2, "polynomial_flatten:order=2")


def test_zero_mean(spark):
    z, _ = both(spark, [[[1, 2], [3, 4]]], "zero_mean")
    assert abs(z.mean()) < 1e-12
    z, _ = both(spark, [[[1, 2], [3, 4]]], "zero_mean", [[[0, 1], [0, 0]]])
    np.testing.assert_allclose(z, np.array([[[1, 2], [3, 4]]]) - 8 / 3)
    z, _ = both(spark, np.ones((1, 3, 3)), "zero_mean", np.ones((1, 3, 3)))
    np.testing.assert_allclose(z, 1)


def test_gaussian(spark):
    d = np.random.default_rng(0).normal(size=(1, 9, 5))
    z, _ = both(spark, d, "gaussian_filter:sigma=2.0")
    assert z.var() < d.var()
    np.testing.assert_allclose(both(spark, np.ones((1, 4, 3)), "gaussian_filter")[0], 1)


def test_threshold_masks(spark):
    d = [[[0.1, 0.5], [1.2, -1.5]]]
    np.testing.assert_array_equal(both(spark, d, "mask_threshold:threshold=1.0")[1], [[[0, 0], [1, 0]]])
    np.testing.assert_array_equal(both(spark, d, "mask_below_threshold:threshold=1.0")[1], [[[1, 1], [0, 1]]])
    odd = [[[np.nan, np.inf, -np.inf, 2.0]]]
    np.testing.assert_array_equal(both(spark, odd, "mask_threshold")[1], [[[0, 0, 0, 1]]])
    np.testing.assert_array_equal(both(spark, [[[0, 0, 0, 10]]], "mask_mean_offset:factor=1.0")[1], [[[0, 0, 0, 1]]])


def test_closing(spark):
    d = np.zeros((1, 3, 3))
    d[0, 0, 1], d[0, 1, 1] = 1.2, 1.3
    _, m = both(spark, d, "mask_morphological:threshold=1.0,structure_size=3")
    assert m[0, 1, 1] and m.sum() == 1
    d = np.full((1, 5, 5), 1.1)
    d[0, 1:4, 1:4] = 0
    d[0, 2, 2] = 1.1
    _, m = both(spark, d, "mask_morphological:threshold=1.0,structure_size=3")
    assert m[0, 1:4, 1:4].all() and m.sum() == 9
    both(spark, np.random.default_rng(2).normal(size=(2, 6, 9)), "mask_morphological:threshold=1.0,structure_size=2")


def test_mask_without_required_parameter_is_empty(spark):
    _, m = both(spark, np.ones((1, 3, 3)) * 5, "mask_morphological")
    assert not m.any()


def test_adaptive(spark):
    d = np.zeros((1, 10, 10))
    d[0, :5, :5] = np.random.default_rng(0).normal(10, 1, (5, 5))
    _, m = both(spark, d, "mask_adaptive:block_size=5,offset=1.0")
    assert m[0, :5, :5].any() and not m[0, 5:].any()
    both(spark, np.random.default_rng(3).normal(size=(1, 7, 5)), "mask_adaptive:block_size=3")


def test_masks_add_up_or_replace(spark):
    d = np.zeros((1, 4, 4))
    d[0, :2, :2], d[0, 2:, 2:] = 1, -1
    steps = parse_steps("mask_threshold:threshold=0.5;mask_below_threshold:threshold=-0.5")
    assert pixel_form(spark, d, steps)[1].sum() == 8
    assert pixel_form(spark, d, steps, combine="replace")[1].sum() == 4


def test_default_preset_in_both_forms(spark):
    both_steps = np.random.default_rng(5).normal(size=(4, 8, 6))
    a, b = pixel_form(spark, both_steps, DEFAULT_STEPS), frame_form(both_steps, DEFAULT_STEPS)
    np.testing.assert_allclose(a[0], b[0], atol=1e-9)
    np.testing.assert_array_equal(a[1], b[1])


def test_unknown_parameter_drops_all(spark):
    steps = [Step("polynomial_flatten", {"order": 3, "foo": 1})]
    d = np.random.default_rng(6).normal(size=(1, 6, 6))
    np.testing.assert_allclose(pixel_form(spark, d, steps)[0], frame_form(d, [Step("polynomial_flatten", {"order": 2})])[0], atol=1e-9)


def test_dead_masks():
    steps = parse_steps("mask_threshold;clear;zero_mean;mask_threshold")
    assert [s.name for s in without_dead_masks(steps)] == ["zero_mean"]


def test_default_preset_shuffles_once_a_fit(spark):
    """A fit is joined to the pixels it is of; both sides read one exchange, and windows add none."""
    stack = FrameStack.from_numpy(spark, np.zeros((2, 4, 4)), 1.0, "c")
    from stackloom.plans.pixelplan import spread

    rows = run_pixels(spread(stack.pixels), 4, 4, DEFAULT_STEPS).pixels
    rows.collect()
    final = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    fits = sum(s.name in ("remove_plane", "polynomial_flatten") for s in DEFAULT_STEPS)
    reused = final.count("ReusedExchange")
    assert final.count("Exchange hashpartitioning") - reused <= fits and reused >= fits - 1
    # in frame form, which pipelines choose for it, there is none
    assert "Exchange" not in run_frames(stack.frames(), DEFAULT_STEPS)._jdf.queryExecution().executedPlan().toString()


def test_rasterize_and_slice(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 0, 0, 0, 2.0), ("a", 3, 1, 1, 5.0), ("b", 1, 9, 0, 1.0), (None, 1, 0, 0, 1.0)], "s string, f int, y int, x int, v double")
    out = rasterize(rows, F.col("s"), F.col("f"), F.col("y"), F.col("x"), F.col("v"), 2, 2)
    got = {(r.frame_idx, r.y, r.x): r.z for r in out.collect()}
    assert len(got) == 8 and got[0, 0, 0] == 3 and got[3, 1, 1] == 5 and got[0, 1, 1] == 0
    frames = spark.createDataFrame([("a", i * 10) for i in range(7)], "stack_id string, frame_idx int")
    assert sorted(r.frame_idx for r in slice_frames(frames, -5, None, 2).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        slice_frames(frames, 0, 1, 0)


def test_metadata_join(spark):
    frames = spark.createDataFrame([("a", 0), ("a", 1)], "stack_id string, frame_idx int")
    meta = spark.createDataFrame([("a", 0, 2.5)], "stack_id string, frame_idx int, timestamp_s double")
    assert {r.frame_idx: r.timestamp_s for r in attach_metadata(frames, meta).collect()} == {0: 2.5, 1: None}
    more = spark.createDataFrame([("a", 7, 2.5)], "stack_id string, frame_idx int, timestamp_s double")
    with pytest.raises(Exception, match="doesn't have"):
        attach_metadata(frames, more).collect()


def test_kernels_leave_input_alone():
    d = np.arange(12.0).reshape(1, 3, 4)
    before = d.copy()
    for f in (kernels.row_median, kernels.centre, kernels.plane, kernels.polynomial, kernels.smooth):
        f(d)
    np.testing.assert_array_equal(d, before)

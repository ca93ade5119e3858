"""Chains that run partly on pixels and partly on frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom import model
from stackloom.plans import forms, registry
from stackloom.plans.forms import FRAME, PIXEL, State, choose, run_steps
from stackloom.plans.frameplan import run_arrays
from stackloom.plans.pipeline import Pipeline
from stackloom.plans.registry import Step, resolve
from stackloom.plans.steps import DEFAULT_STEPS
from stackloom.stack import FrameStack


@pytest.fixture
def own():
    def doubled(a, by=2.0):
        if a[0, 0] < 0:
            raise ValueError("negative corner")
        return a * by

    registry.register_filter("doubled", doubled)
    registry.register_mask("upper", lambda a: np.arange(len(a))[:, None] < np.full(a.shape, len(a) // 2))
    registry.register_mask("broken", lambda a: 1 / 0)
    yield
    registry.PLUGINS.clear()
    for name in ("upper", "broken"):
        registry.MASKS.pop(name)


def data(seed=1, n=6, h=5, w=7):
    d = np.random.default_rng(seed).normal(size=(n, h, w))
    d[:, 0, 0] = np.where(np.arange(n) % 2, 1.0, -1.0)
    return d


def arrays(d, steps):
    return run_arrays(d, [(resolve(s.name), s.params) for s in steps])


CHAIN = [Step("remove_plane"), Step("upper"), Step("row_median_align"), Step("doubled", {"by": 3.0}), Step("mask_threshold", {"threshold": 0.5}), Step("broken"), Step("polynomial_flatten", {"order": 2}), Step("clear"), Step("mask_morphological"), Step("gaussian_filter", {"sigma": 1.0}), Step("doubled", {"nothing": 1}), Step("zero_mean")]


def test_costs_choose(own):
    assert choose(DEFAULT_STEPS, FRAME, PIXEL, 64) == [FRAME] * 6
    assert choose([Step("mask_threshold")], PIXEL, PIXEL, 64) == [PIXEL]
    assert choose([Step("mask_threshold"), Step("doubled")], PIXEL, PIXEL, 64)[1] == FRAME
    # one window is cheaper than putting frames together, a chain of them isn't
    assert choose([Step("zero_mean")], PIXEL, PIXEL, 64) == [PIXEL]
    assert choose([Step("zero_mean")] * 4, PIXEL, PIXEL, 64) == [FRAME] * 4
    assert choose([], PIXEL, PIXEL, 64) == []
    # frames that don't fit into a row stay pixels, and users' steps can't have them
    assert choose(DEFAULT_STEPS, PIXEL, PIXEL, forms.FRAME_LIMIT + 1) == [PIXEL] * 6
    with pytest.raises(ValueError, match="whole frames"):
        choose([Step("doubled")], PIXEL, PIXEL, forms.FRAME_LIMIT + 1)


@pytest.mark.parametrize("start", [FRAME, PIXEL])
@pytest.mark.parametrize("all_frames", [True, False])
def test_mixed_chain_like_arrays(spark, own, monkeypatch, start, all_frames):
    if not all_frames:  # pixels wherever there is a pixel form: as many changes as possible
        monkeypatch.setattr(forms, "choose", lambda steps, *rest: [FRAME if s.name in ("doubled", "upper", "broken") else PIXEL for s in steps])
    d = data()
    stack = FrameStack.from_numpy(spark, d, 1.0, "c")
    if start == PIXEL:
        stack.pixels = stack.pixels
    Pipeline(stack).add(CHAIN).run()
    z, _, failed = arrays(d, CHAIN)
    np.testing.assert_allclose(stack.numpy(), z, atol=1e-9)
    assert stack.faults.get() == {f"step_{k}_{s.name}": int(f.sum()) for k, (s, f) in enumerate(zip(CHAIN, failed, strict=True), 1)}
    assert stack.faults.get()["step_6_broken"] == 6 and stack.faults.get()["step_9_mask_morphological"] == 6 and 0 < stack.faults.get()["step_4_doubled"] < 6
    # snapshots and masks of every step, by name
    assert list(stack.snapshots) == ["raw", *(f"step_{k}_{s.name}" for k, s in enumerate(CHAIN, 1) if s.name != "clear" and resolve(s.name).kind == "filter")]
    assert list(stack.masks) == ["step_2_upper", "step_5_upper_mask_threshold", "step_6_upper_mask_threshold_broken", "step_9_mask_morphological"]
    for k in (1, 4, 7):
        np.testing.assert_allclose(stack.numpy(stack.snapshots[f"step_{k}_{CHAIN[k - 1].name}"]), arrays(d, CHAIN[:k])[0], atol=1e-9)
    m = stack.masks["step_5_upper_mask_threshold"]
    assert m.columns == ["stack_id", "frame_idx", "y", "x", "mask"] and m.where("mask").count() == arrays(d, CHAIN[:5])[1].sum()


def test_pixel_form_knows_what_it_leaves(spark):
    d = data()
    d[0] = np.nan
    steps = [Step("mask_threshold", {"threshold": -9.0}), Step("zero_mean"), Step("remove_plane"), Step("polynomial_flatten", {"order": 2}), Step("clear"), Step("remove_plane"), Step("polynomial_flatten", {"order": 2.5})]
    rows = model.explode_frames(FrameStack.from_numpy(spark, d, 1.0, "c").frames())
    state = State(forms.counted(rows), PIXEL, 5, 7)
    for step in steps:
        one = forms.apply_step(forms.PixelState(state.rows, 5, 7, state.has_mask), step, "or", steps.index(step) if step.name != "clear" else 99)
        state = State(one.pixels, PIXEL, 5, 7, one.has_mask)
    _, _, failed = arrays(d, steps)
    left = {r.frame_idx: set(r.left) for r in state.rows.where("y = 0 AND x = 0").collect()}
    # equal steps have the number of the first
    numbers = [0, 1, 2, 3, None, 2, 6]
    assert left == {i: {n for n, f in zip(numbers, failed[:, i], strict=True) if f and n is not None} for i in range(6)}


def test_one_pass_over_frames(spark, own):
    frames = FrameStack.from_numpy(spark, data(), 1.0, "c").frames()
    end = run_steps(State(frames, FRAME, 5, 7), [*DEFAULT_STEPS, Step("doubled")], end=FRAME)[-1]
    plan = end.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    pixels = run_steps(State(model.explode_frames(frames), PIXEL, 5, 7), [Step("remove_plane")])[-1].rows
    assert "Window" not in pixels._jdf.queryExecution().executedPlan().toString()
    assert pixels.agg(F.count("*")).first()[0] == 6 * 35

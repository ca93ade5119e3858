"""Pipelines over a FrameStack: named lazy snapshots of every step."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from stackloom.plans.forms import PIXEL, Faults, counted, run_steps
from stackloom.plans.frameplan import run_frames
from stackloom.plans.registry import CLEAR, Step, resolve

if TYPE_CHECKING:
    from stackloom.stack import FrameStack


class LoadError(Exception):
    """The input of a run can't be loaded."""


class Pipeline:
    """Collects steps; run() builds the plan. Masks add up until they are cleared."""

    def __init__(self, stack: FrameStack):
        self.stack = stack
        self.steps: list[Step] = []

    def add_mask(self, name: str, **params: Any) -> Pipeline:
        self.steps.append(Step(name, params))
        return self

    add_filter = add_mask

    def add(self, steps: list[Step]) -> Pipeline:
        self.steps += steps
        return self

    def clear_mask(self) -> Pipeline:
        self.steps.append(Step(CLEAR))
        return self

    def run(self) -> DataFrame:
        """The stack's pixels after all steps, starting from its present ones and from no mask.

        Each step runs in the form that makes the chain cheapest; users' steps run on frames.  The
        stack keeps `raw` and `step_<k>_<name>` snapshots and the masks, all lazy, and `faults`:
        how many frames each step left as they were.
        """
        stack = self.stack
        stack.keep_raw()
        names = [f"step_{k}_{s.name}" for k, s in enumerate(self.steps, 1)]
        start = replace(stack.state, rows=counted(stack.state.rows))
        states = run_steps(start, self.steps)
        had_mask, last_mask = False, None
        for s, name, state in zip(self.steps, names, states, strict=True):
            op = resolve(s.name)
            rows = lambda *more, state=state: state.to(PIXEL).rows.select(*stack.key, "y", "x", *more)
            if op is None:
                last_mask = None
            elif op.kind == "mask":
                if had_mask and last_mask:
                    name = f"{'_'.join(name.split('_')[:2])}_{'_'.join(last_mask.split('_')[2:])}_{s.name}"
                last_mask = name
                stack.masks[name] = rows("mask")
            else:
                stack.snapshots[name] = rows("z")
            had_mask = state.has_mask
        stack.faults = Faults(names)
        end = states[-1] if states else start
        stack.state = replace(end, rows=stack.faults.observed(end).drop("mask"), has_mask=False)
        return stack.pixels

    def run_frame_form(self) -> DataFrame:
        """The same steps in one pass over frames, for throughput and for users' functions; without snapshots."""
        self.stack.keep_raw()
        out = run_frames(self.stack.frames(), self.steps)
        self.stack.set_frames(out)
        return out


def apply_steps(stack: FrameStack, names: list[str], **params: Any) -> DataFrame:
    """Steps by name with shared parameters; here a new mask replaces the one before it."""
    stack.keep_raw()
    steps = [Step(name, dict(params) if resolve(name) else {}) for name in names]
    states = run_steps(stack.state, steps, "replace")
    for step, state in zip(steps, states, strict=True):
        op = resolve(step.name)
        if op is not None and op.kind == "filter":
            stack.snapshots[step.name] = state.to(PIXEL).rows.drop("mask")
    if states:
        stack.state = replace(states[-1], rows=states[-1].rows.drop("mask"), has_mask=False)
    return stack.pixels


def process_stack(spark, path: str | Path, channel: str, steps: list[Step]) -> FrameStack:
    from stackloom.stack import FrameStack

    try:
        stack = FrameStack.load(spark, path, channel)
    except Exception as e:
        raise LoadError(f"can't load {path}: {e}") from e
    Pipeline(stack).add(steps).run()
    return stack

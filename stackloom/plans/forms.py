"""Chains of steps whose parts run in pixel form or in frame form, whichever costs less.

A user's function of one array has only a frame form; a frame of more than FRAME_LIMIT pixels is
never put into one row.  Everything else has both, so the least sum of step and conversion costs
decides.  Each run of steps of one form is one part of the plan: a narrow pass over frames, or
windows and aggregates over pixels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stackloom.model import assemble_frames, explode_frames
from stackloom.plans.frameplan import run_frames
from stackloom.plans.pixelplan import PixelState, apply_step
from stackloom.plans.registry import Step, resolve

PIXEL, FRAME = "pixel", "frame"
#: Nanoseconds a pixel: arrays to rows, and rows to arrays (a shuffle and a sort of every pixel).
EXPLODE, ASSEMBLE = 60.0, 1500.0
FRAME_LIMIT = 1 << 26


@dataclass(frozen=True)
class State:
    """Rows of one form, with a column `mask` if has_mask and `left` if steps are counted."""

    rows: DataFrame
    form: str
    height: int
    width: int
    has_mask: bool = False
    fitted: bool = False

    def to(self, form: str) -> State:
        if form == self.form:
            return self
        rows = assemble_frames(self.rows) if form == FRAME else explode_frames(self.rows)
        return State(rows, form, self.height, self.width, self.has_mask, self.fitted)


def choose(steps: list[Step], start: str, end: str, size: int) -> list[str]:
    """The form of each step: the cheapest way from the first form to the last, step by step."""
    turn = {(PIXEL, FRAME): ASSEMBLE, (FRAME, PIXEL): EXPLODE}
    best: dict[str, tuple[float, list[str]]] = {start: (0.0, [])}
    for s in steps:
        op = resolve(s.name)
        costs = dict(zip((PIXEL, FRAME), op.cost if op else (0.0, 0.0), strict=True))
        if size > FRAME_LIMIT:
            costs[FRAME] = math.inf
        now = {}
        for form, own in costs.items():
            ways = [(cost + turn.get((before, form), 0.0) + own, [*path, form]) for before, (cost, path) in best.items()]
            now[form] = min(ways, key=lambda w: w[0])
        best = {f: w for f, w in now.items() if w[0] < math.inf}
        if not best:
            raise ValueError(f"{s.name!r} needs whole frames in memory, and these have {size} pixels")
    return min(((cost + turn.get((form, end), 0.0), path) for form, (cost, path) in best.items()), key=lambda w: w[0])[1]


def run_steps(state: State, steps: list[Step], combine: str = "or", end: str = PIXEL) -> list[State]:
    """The state after each step, all lazy; the last one is what the chain gives."""
    forms = choose(steps, state.form, end, state.height * state.width)
    counted = "left" in state.rows.columns
    out: list[State] = []
    base, part = state, []  # where the run of frame steps began, and its steps
    for k, (s, form) in enumerate(zip(steps, forms, strict=True)):
        op = resolve(s.name)
        now = out[-1] if out else state
        has_mask = False if op is None else now.has_mask or op.kind == "mask"
        if form == PIXEL:
            now, part = now.to(PIXEL), []
            p = apply_step(PixelState(now.rows, now.height, now.width, now.has_mask, now.fitted), s, combine, k if counted else None)
            out.append(State(p.pixels, PIXEL, p.height, p.width, p.has_mask, p.fitted))
            continue
        if not part:
            base, first = now.to(FRAME), k
        part = [*part, s]
        # every state of the run starts from its beginning: one pass, however many steps
        rows = run_frames(base.rows, part, combine, has_mask, first if counted else None)
        out.append(State(rows if counted else rows.drop("errors"), FRAME, state.height, state.width, has_mask))
    return out


class Faults:
    """How many frames each step left as they were; observed while the rows are computed."""

    def __init__(self, names: list[str]):
        self.names, self.seen = names, Observation()
        self.rows: DataFrame | None = None

    def observed(self, state: State) -> DataFrame:
        """The rows without their `left`, counted while they pass."""
        one = (F.col("y") == 0) & (F.col("x") == 0) if state.form == PIXEL else F.lit(True)
        counts = [F.count_if(one & F.array_contains("left", F.lit(k))).alias(n) for k, n in enumerate(self.names)]
        self.rows = (state.rows.observe(self.seen, *counts) if counts else state.rows).drop("left")
        return self.rows

    def get(self) -> dict[str, int]:
        """What an action on the rows has seen, or else what one of its own sees: it never waits for another's."""
        if self.rows is None or not self.names:
            return {}
        if self.seen._jo.getRowOrEmpty().isEmpty():
            self.rows.write.format("noop").mode("overwrite").save()
        return dict(self.seen.get)


def counted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("left", F.array().cast("array<int>"))

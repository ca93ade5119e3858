"""Steps as one lazy plan on pixel form."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.model import FRAME_KEY
from stackloom.operators.filters import FAILED
from stackloom.plans.registry import CLEAR, Step, resolve

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class PixelState:
    """Pixels, with a column `mask` if has_mask; the plan never models "no mask" as null.

    fitted: some step before joined a fit to the pixels.
    """

    pixels: DataFrame
    height: int
    width: int
    has_mask: bool = False
    fitted: bool = False


def spread(pixels: DataFrame) -> DataFrame:
    """One shuffle by frame; all windows of all steps reuse it."""
    return pixels.repartition(*FRAME_KEY)


def apply_step(state: PixelState, step: Step, combine: str = "or", number: int | None = None) -> PixelState:
    """The next state.  combine: `or` adds a mask to the one before it, `replace` puts it in its place.

    `number`: the step's, for chains whose pixels carry the steps that left their frame as it was (`left`).
    """
    op = resolve(step.name)
    if op is None:
        return replace(state, pixels=state.pixels.drop("mask"), has_mask=False)
    if op.pixel_form is None:
        raise ValueError(f"{step.name!r} works on arrays; run it in frame form or let a pipeline choose")
    masked = state.has_mask and op.masked
    params = op.usable(step.params, masked)
    if op.missing(params):
        log.error("%s lacks a parameter; it leaves every frame as it is", op.name)
        rows, new = state.pixels.withColumn(FAILED, F.lit(True)), F.lit(False)
    elif op.kind == "mask":
        rows, new = op.pixel_form(state.pixels, **params)
    else:
        # a fit is joined to the pixels it is of: where they are the result of one already, they are dealt out once for both
        pixels = spread(state.pixels) if op.sized and state.fitted else state.pixels
        rows = op.pixel_form(pixels, *((state.height, state.width) if op.sized else ()), **params, **({"masked": masked} if op.masked else {}))
    columns = [c for c in state.pixels.columns if c not in ("mask", "left")]
    out = [F.col(c) for c in columns]
    if op.kind == "mask":
        out.append((F.col("mask") | new if state.has_mask and combine == "or" else new).alias("mask"))
    elif state.has_mask:
        out.append(F.col("mask"))
    if "left" in state.pixels.columns:
        failed = FAILED in rows.columns and number is not None
        out.append(F.when(F.col(FAILED), F.concat("left", F.array(F.lit(number)))).otherwise(F.col("left")).alias("left") if failed else F.col("left"))
    return PixelState(rows.select(*out), state.height, state.width, state.has_mask or op.kind == "mask", state.fitted or (op.kind == "filter" and op.sized))


def without_dead_masks(steps: list[Step]) -> list[Step]:
    """Steps without masks that no later step can see; for plans that don't keep the history of masks."""
    out: list[Step] = []
    live = False
    for s in reversed(steps):
        op = resolve(s.name)
        if op is None:
            live = False
        elif op.kind == "mask":
            if not live:
                continue
        elif op.masked:
            live = True
        out.append(s)
    return [s for k, s in enumerate(out[::-1]) if s.name != CLEAR or k]


def run_pixels(pixels: DataFrame, height: int, width: int, steps: list[Step], combine: str = "or") -> PixelState:
    state = PixelState(pixels, height, width, "mask" in pixels.columns)
    for s in steps:
        state = apply_step(state, s, combine)
    return state

"""Steps in frame form: one narrow pass over frames, whatever their number, without a shuffle.

Frames of an Arrow batch with one shape are worked on together.  A user's function gets one 2-D
array at a time; if it fails, the frame stays as it is (or its mask is empty) and `errors` counts it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stackloom.plans.registry import Operator, Step, resolve

log = logging.getLogger(__name__)


def _one_by_one(function: Callable, data: np.ndarray, params: dict, kind: type) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(data.shape, kind)
    ok = np.zeros(len(data), bool)
    why: Exception | None = None
    for i, frame in enumerate(data):
        for kw in (params, {}):
            try:
                out[i] = function(frame, **kw)
                ok[i] = True
                break
            except TypeError as e:  # once more without any parameter
                why = e
            except Exception as e:
                why = e
                break
    if why is not None:
        log.error("%d of %d frames stay as they are or ran without parameters; the last reason: %s", int((~ok).sum()), len(ok), why)
    return out, ok


def run_arrays(data: np.ndarray, plan: list[tuple[Operator | None, dict]], mask: np.ndarray | None = None, combine: str = "or") -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(data, mask, failed) after all steps on (frames, height, width); failed[k] tells the frames that step k left as they were."""
    failed = np.zeros((len(plan), len(data)), bool)
    for k, (op, params) in enumerate(plan):
        if op is None:
            mask = None
            continue
        masked = op.kind == "filter" and mask is not None and op.masked
        kind = bool if op.kind == "mask" else float
        if op.user:
            out, ok = _one_by_one(op.frame_form, data, params, kind)
        else:
            usable = op.usable(params, masked)
            if op.missing(usable):
                out, ok = np.zeros(data.shape, kind), np.zeros(len(data), bool)
            else:
                out, ok = op.frame_form(data, **usable, **({"mask": mask} if masked else {}))
        failed[k] = ~ok
        if op.kind == "mask":
            new = out & ok[:, None, None]
            mask = new if mask is None or combine == "replace" else mask | new
        else:
            data = np.where(ok[:, None, None], out, data)
    return data, mask, failed


def run_frames(frames: DataFrame, steps: list[Step], combine: str = "or", with_mask: bool = False, first: int | None = None) -> DataFrame:
    """frames (height, width, pixels and any more columns) with pixels replaced, and `errors`; `mask` on request.

    A column `mask` of frames is the mask to start from.  `first`: the number of the first step, for
    chains whose frames carry the numbers of the steps that left them as they were (`left`) instead
    of counting `errors`.
    """
    plan = [(resolve(s.name), s.params) for s in steps]
    names = frames.columns
    h, w, p = (names.index(c) for c in ("height", "width", "pixels"))
    before = names.index("mask") if "mask" in names else None
    old = names.index("left") if first is not None else None
    kept = [k for k, c in enumerate(names) if k != before]
    schema = T.StructType([T.StructField("pixels", T.ArrayType(T.DoubleType())) if k == p else frames.schema[k] for k in kept])
    if old is None:
        schema = schema.add("errors", T.IntegerType())
    if with_mask:
        schema = schema.add("mask", T.ArrayType(T.BooleanType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shape = np.stack([b.column(h).to_numpy(zero_copy_only=False), b.column(w).to_numpy(zero_copy_only=False)], 1)
            for hw in np.unique(shape, axis=0):
                part = b.take(pa.array(np.flatnonzero((shape == hw).all(1))))
                n, size = part.num_rows, int(hw[0]) * int(hw[1])
                if (np.diff(part.column(p).offsets.to_numpy()) != size).any():
                    raise ValueError(f"a frame of {hw[0]} x {hw[1]} needs {size} pixels")
                flat = part.column(p).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                mask = None if before is None else part.column(before).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(n, *hw)
                data, mask, failed = run_arrays(flat.reshape(n, *hw), plan, mask, combine)
                offsets = pa.array(np.arange(n + 1) * size, pa.int32())
                cols = part.columns
                cols[p] = pa.ListArray.from_arrays(offsets, pa.array(data.ravel()))
                if old is not None:
                    cols[old] = pa.array([[*was, *(first + np.flatnonzero(f)).tolist()] for was, f in zip(cols[old].to_pylist(), failed.T, strict=True)], pa.list_(pa.int32()))
                cols = [cols[k] for k in kept]
                if old is None:
                    cols.append(pa.array(failed.sum(0).astype(np.int32)))
                if with_mask:
                    cols.append(pa.nulls(n, pa.list_(pa.bool_())) if mask is None else pa.ListArray.from_arrays(offsets, pa.array(mask.ravel())))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return frames.mapInArrow(run, schema)

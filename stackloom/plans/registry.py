"""Steps by name: masks, filters, and those that users register.

A step has a pixel form (DataFrame functions) and a frame form (numpy over batches).  User steps
are functions of one 2-D array and run in frame form; user columns work on pixel form.
"""

from __future__ import annotations

import inspect
import logging
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any

from stackloom.functions import kernels
from stackloom.operators import filters, masks

log = logging.getLogger(__name__)

CLEAR = "clear"
ENTRY_POINTS = "stackloom.filters"


@dataclass(frozen=True)
class Step:
    name: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Operator:
    """kind: mask or filter; masked: whether there is a variant that leaves out a mask."""

    name: str
    kind: str
    frame_form: Callable
    pixel_form: Callable | None = None
    masked: bool = False
    sized: bool = False
    user: bool = False
    #: Nanoseconds for a pixel in pixel form and in frame form; they only choose between the forms.
    cost: tuple[float, float] = (math.inf, 200.0)

    def usable(self, params: dict[str, Any], with_mask: bool) -> dict[str, Any]:
        """The parameters if the operator takes all of them, else none of them (and a warning).

        A required parameter that is missing makes the step undefined: ``None`` is returned for
        the parameter set and every frame keeps its values or gets an empty mask.
        """
        known = inspect.signature(self.frame_form).parameters
        if any(p.kind is p.VAR_KEYWORD for p in known.values()):
            return params
        own = list(known)[1:]
        if self.masked and self.name == "zero_mean" and with_mask:
            own = []
        bad = [k for k in params if k not in own or k == "mask"]
        if bad:
            log.warning("%s doesn't take %s; it runs with its defaults", self.name, ", ".join(bad))
            return {}
        return params

    def missing(self, params: dict[str, Any]) -> bool:
        known = list(inspect.signature(self.frame_form).parameters.values())[1:]
        return any(p.default is p.empty and p.name not in params and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) for p in known)


#: Costs by what a step does in pixel form: only its own pixel, windows over frame or row, sorts along both axes.
NARROW, WINDOW, SORTS = (20.0, 10.0), (700.0, 30.0), (3000.0, 60.0)


def _masks() -> dict[str, Operator]:
    rows = [("mask_threshold", "threshold_above", NARROW), ("mask_below_threshold", "threshold_below", NARROW), ("mask_mean_offset", "above_mean", WINDOW), ("mask_morphological", "closed_magnitude", SORTS), ("mask_adaptive", "above_tile_mean", WINDOW)]
    return {name: Operator(name, "mask", getattr(kernels, f), getattr(masks, f), cost=cost) for name, f, cost in rows}


def _filters() -> dict[str, Operator]:
    rows = [("remove_plane", "plane", True, True, WINDOW), ("row_median_align", "row_median", True, False, WINDOW), ("zero_mean", "centre", True, False, WINDOW), ("polynomial_flatten", "polynomial", True, True, WINDOW), ("gaussian_filter", "smooth", False, True, SORTS)]
    return {name: Operator(name, "filter", getattr(kernels, f), getattr(filters, f), masked, sized, cost=cost) for name, f, masked, sized, cost in rows}


MASKS: dict[str, Operator] = _masks()
FILTERS: dict[str, Operator] = _filters()
PLUGINS: dict[str, Operator] = {}


def register_filter(name: str, function: Callable) -> None:
    """A filter of one 2-D array (and keywords); it goes before a built-in of the same name."""
    PLUGINS[name] = Operator(name, "filter", function, user=True)


def register_mask(name: str, function: Callable) -> None:
    """A mask generator: from one 2-D array to one of booleans."""
    MASKS[name] = Operator(name, "mask", function, user=True)


def load_plugin(name: str) -> Operator:
    for e in entry_points(group=ENTRY_POINTS):
        if e.name == name:
            log.debug("plugin %s from %s", name, e.value)
            return Operator(name, "filter", e.load(), user=True)
    raise ValueError(f"no plugin is called {name!r}")


def is_step(name: str) -> bool:
    return name == CLEAR or name in MASKS or name in PLUGINS or name in FILTERS or any(e.name == name for e in entry_points(group=ENTRY_POINTS))


def resolve(name: str) -> Operator | None:
    """None for clear; masks come first, then plugins, then filters; ValueError for anything else."""
    if name == CLEAR:
        return None
    for known in (MASKS, PLUGINS):
        if name in known:
            return known[name]
    if any(e.name == name for e in entry_points(group=ENTRY_POINTS)):
        return load_plugin(name)
    if name in FILTERS:
        return FILTERS[name]
    raise ValueError(f"{name!r} is no step")

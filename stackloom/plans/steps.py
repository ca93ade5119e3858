"""Text form of steps: ``name:key=value,key=value;name`` or a YAML or JSON file."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from stackloom.plans.registry import Step, is_step


def literal(text: str) -> Any:
    """true and false, numbers, else the text; a whole number without point or exponent is an int."""
    text = text.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def parse_steps(text: str) -> list[Step]:
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, _, rest = part.partition(":")
        name = name.strip()
        if not is_step(name):
            raise ValueError(f"{name!r} is no step")
        params = {}
        for item in filter(None, (p.strip() for p in rest.split(","))):
            key, eq, value = item.partition("=")
            if not eq:
                raise ValueError(f"{item!r} in step {name!r} should be key=value")
            params[key.strip()] = literal(value)
        out.append(Step(name, params))
    return out


def load_steps(path: str | Path) -> list[Step]:
    """Steps of a file whose `filters` lists dicts with a name; other keys are parameters."""
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(f"no file of steps at {path}")
    text = path.read_text(encoding="utf-8")
    try:
        import yaml

        data = yaml.safe_load(text)
    except Exception:
        try:
            data = json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError(f"{path} is neither YAML nor JSON") from e
    if not isinstance(data, dict) or "filters" not in data:
        raise ValueError(f"{path} has no key 'filters'")
    if not isinstance(data["filters"], list):
        raise ValueError("'filters' must be a list")
    out = []
    for entry in data["filters"]:
        if not isinstance(entry, dict) or "name" not in entry:
            raise ValueError(f"a step without name: {entry!r}")
        if not is_step(entry["name"]):
            raise ValueError(f"{entry['name']!r} is no step")
        out.append(Step(entry["name"], {k: v for k, v in entry.items() if k != "name"}))
    return out


def dump_steps(steps: list[Step]) -> str:
    import yaml

    return yaml.safe_dump({"filters": [{"name": s.name, **s.params} for s in steps]}, sort_keys=False)


#: The preset of the viewer: fixed values.
DEFAULT_STEPS = [
    Step("remove_plane"),
    Step("polynomial_flatten", {"order": 2}),
    Step("mask_mean_offset", {"factor": 0.5}),
    Step("row_median_align"),
    Step("polynomial_flatten", {"order": 2}),
    Step("zero_mean"),
]

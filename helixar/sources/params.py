"""Cost parameters: defaults, JSON files with validation, and their content key."""

from __future__ import annotations

import hashlib
import json

# The default cost parameters.
DEFAULTS = {
    "global_time_cost": 10.0,
    "global_material_modifier": 1.0,
    "primer_min_anneal": 16,
    "_primer_min_span": -300,
    "primer_efficiency": {
        "columns": ["min", "max", "efficiency"],
        "data": [[0, 10, 0.0], [10, 15, 0.3], [15, 20, 0.6], [20, 30, 0.8], [30, 40, 0.9], [40, 45, 0.9], [45, 50, 0.8], [50, 100, 0.75], [100, 120, 0.5], [120, 150, 0.3], [150, 250, 0.1], [250, 300, 0.0]],
    },
    "primer_cost": {
        "columns": ["name", "min", "max", "base cost", "cost per bp", "time (days)"],
        "data": [["IDTPrimer", 16.0, 60.0, 0.0, 0.15, 1.5], ["IDTUltramer", 45.0, 200.0, 0.0, 0.40, 1.5]],
    },
    "synthesis_cost": {
        "columns": ["min", "max", "base", "time"],
        "data": [[0, 1, 0, 0], [1, 100, "inf", "inf"], [100, 500, 89.0, 3.0], [500, 750, 129.0, 3.0], [750, 1000, 149.0, 4.0], [1000, 1250, 209.0, 7.0], [1250, 1500, 249.0, 7.0], [1500, 1750, 289.0, 7.0], [1750, 2000, 329.0, 7.0], [2000, 2250, 399.0, 7.0]],
    },
    "_synthesis_step_size": 10,
    "_synthesis_left_span_range": [-500, 500],
}


class ParameterError(ValueError):
    """Parameters that do not follow the schema."""


def validate(params: dict) -> dict:
    """The parameters, if they have exactly the known properties of the right kinds."""
    extra, lacking = set(params) - set(DEFAULTS), set(DEFAULTS) - set(params)
    if extra or lacking:
        raise ParameterError(f"unknown: {sorted(extra)}; missing: {sorted(lacking)}")
    for name, default in DEFAULTS.items():
        value = params[name]
        if isinstance(default, dict):
            if not isinstance(value, dict) or value.get("columns") != default["columns"] or not isinstance(value.get("data"), list):
                raise ParameterError(f"{name}: columns must be {default['columns']}")
            for row in value["data"]:
                if len(row) != len(default["columns"]):
                    raise ParameterError(f"{name}: {row}")
                for cell, like in zip(row, default["data"][0], strict=True):
                    if isinstance(like, str) != (isinstance(cell, str) and cell != "inf"):
                        raise ParameterError(f"{name}: {cell!r}")
        elif isinstance(default, list):
            if not isinstance(value, list) or len(value) != 2 or not all(isinstance(x, int | float) for x in value):
                raise ParameterError(f"{name}: {value!r}")
        elif isinstance(value, bool) or not isinstance(value, int | float):
            raise ParameterError(f"{name}: {value!r}")
    return params


def load(path: str | None = None) -> dict:
    if path is None:
        return DEFAULTS
    with open(path, encoding="utf-8") as f:
        return validate(json.load(f))


def key(params: dict) -> str:
    """Content key under which tables made from the parameters are kept."""
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]

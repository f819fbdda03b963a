"""Configurations: nested dictionaries with defaults, overrides and checks. Plain Python on the driver."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterable
from typing import Any


def merged(base: dict, other: dict) -> dict:
    """A deep merge: nested dictionaries are merged, everything else is replaced. Neither argument changes."""
    out = copy.deepcopy(base)
    for k, v in other.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def with_overrides(base: dict, overrides: dict[str, Any]) -> dict:
    """Dotted names reach into nested dictionaries; a name on the way that holds no dictionary is an error."""
    out = copy.deepcopy(base)
    for name, v in overrides.items():
        *way, last = name.split(".")
        d = out
        for k in way:
            d = d.setdefault(k, {})
            if not isinstance(d, dict):
                raise ValueError(f"{name}: {k} holds no settings")
        d[last] = merged(d[last], v) if isinstance(v, dict) and isinstance(d.get(last), dict) else v
    return out


def get(config: dict, name: str, default: Any = None) -> Any:
    for k in name.split("."):
        if not isinstance(config, dict) or k not in config:
            return default
        config = config[k]
    return config


def load(path: str, defaults: dict | None = None, overrides: dict[str, Any] | None = None) -> dict:
    """A JSON file, or a YAML file where a YAML library is installed, over defaults and under overrides."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no settings")
    return with_overrides(merged(defaults or {}, data), overrides or {})


def problems(config: dict, rules: Iterable[tuple[str, Callable[[Any], bool], str]]) -> list[str]:
    """Every rule that does not hold, as ``name: text``. A rule is (dotted name, test of its value, text); a test that fails with an error does not hold."""
    out = []
    for name, test, text in rules:
        try:
            ok = bool(test(get(config, name)))
        except (TypeError, ValueError, AttributeError):
            ok = False
        if not ok:
            out.append(f"{name}: {text}")
    return out

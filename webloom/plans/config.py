"""Settings as JSON: dataclasses written as {"type", "params"} and read back, defaults left out."""

from __future__ import annotations

import dataclasses
import json
from typing import Any

KNOWN: dict[str, type] = {}


def setting(cls: type) -> type:
    """Make a dataclass known by its name."""
    KNOWN[cls.__name__] = cls
    return cls


def to_plain(value: Any) -> Any:
    """What JSON can hold: known dataclasses by type and the parameters that differ from their defaults, mappings marked as such, sequences as lists."""
    if dataclasses.is_dataclass(value) and type(value).__name__ in KNOWN:
        params = {}
        for f in dataclasses.fields(value):
            v = getattr(value, f.name)
            default = f.default if f.default is not dataclasses.MISSING else f.default_factory() if f.default_factory is not dataclasses.MISSING else dataclasses.MISSING
            if v != default:
                params[f.name] = to_plain(v)
        return {"type": type(value).__name__, "params": params}
    if isinstance(value, dict):
        return {"type": "dict", "value": {k: to_plain(v) for k, v in value.items()}}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [to_plain(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise TypeError(f"{type(value).__name__} isn't a known setting")


def from_plain(value: Any) -> Any:
    """The settings that to_plain() wrote; unknown types and parameters are errors. Lists stay lists unless the field's default is a tuple."""
    if isinstance(value, list):
        return [from_plain(v) for v in value]
    if not isinstance(value, dict):
        return value
    if value["type"] == "dict":
        return {k: from_plain(v) for k, v in value["value"].items()}
    cls = KNOWN.get(value["type"])
    if cls is None:
        raise ValueError(f"unknown type {value['type']!r}")
    params = {k: from_plain(v) for k, v in value["params"].items()}
    tuples = {f.name for f in dataclasses.fields(cls) if isinstance(f.default, tuple)}
    return cls(**{k: tuple(v) if k in tuples else v for k, v in params.items()})


def dumps(value: Any) -> str:
    return json.dumps(to_plain(value), ensure_ascii=False, sort_keys=True)


def loads(text: str) -> Any:
    return from_plain(json.loads(text))

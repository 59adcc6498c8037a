"""Settings in layers: the command line over a file over defaults."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import fields, is_dataclass, replace
from pathlib import Path
from typing import TypeVar

T = TypeVar("T")


def merged(parent: Mapping, child: Mapping) -> dict:
    """``parent`` with the entries of ``child`` over it, nested mappings merged; null entries of the child don't count."""
    out = dict(parent)
    for k, v in child.items():
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = v
    return out


def load(path: str) -> dict:
    """The mapping in a JSON file, or in a YAML file where a YAML reader is installed."""
    text = Path(path).read_text()
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"reading {path} needs a YAML reader") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def build(defaults: T, path: str | None = None, overrides: Mapping | None = None) -> T:
    """A dataclass instance with its values replaced by the file's, then by the overrides; unknown names are errors."""
    if not is_dataclass(defaults):
        raise TypeError("defaults must be a dataclass instance")
    values = merged(load(path) if path else {}, overrides or {})
    unknown = values.keys() - {f.name for f in fields(defaults)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(defaults, **values)

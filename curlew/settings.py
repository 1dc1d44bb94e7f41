"""Settings of a run: nested dicts from JSON files, merged, overridden and filled in; and
functions by their dotted names."""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable


def named(path: str) -> Callable:
    """The function of a dotted name, as ``package.module.function``."""
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; dicts are merged, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def overridden(settings: dict, options: dict[str, object]) -> dict:
    """With values set by dotted names: ``{"a.b": 1}``."""
    out = settings
    for name, value in options.items():
        *path, last = name.split(".")
        over: dict = {last: value}
        for p in reversed(path):
            over = {p: over}
        out = merged(out, over)
    return out


def filled(settings: dict) -> dict:
    """``${a.b}`` in strings replaced by that setting; a string that is one reference keeps its type."""

    def get(name: str):
        at = settings
        for p in name.split("."):
            at = at[p]
        return at

    def walk(x):
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        if isinstance(x, str):
            whole = re.fullmatch(r"\$\{([^}]+)\}", x)
            return walk(get(whole[1])) if whole else re.sub(r"\$\{([^}]+)\}", lambda m: str(walk(get(m[1]))), x)
        return x

    return walk(settings)


def load(path: str, options: dict[str, object] | None = None) -> dict:
    """A JSON file (over the file that it names as ``_base_``), overridden and filled in."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    base = own.pop("_base_", None)
    out = merged(load(base), own) if base else own
    return filled(overridden(out, options or {}))

"""Layered settings: later layers win, dotted names reach inside, a name that ends in + appends to a list."""

from __future__ import annotations

import copy


def layered(*layers: dict) -> dict:
    out: dict = {}
    for layer in layers:
        _merge(out, layer or {})
    return out


def _merge(into: dict, layer: dict) -> None:
    for name, value in layer.items():
        if name.endswith("+"):
            have = into.get(name[:-1])
            into[name[:-1]] = [*(have if isinstance(have, list) else [] if have is None else [have]), *(value if isinstance(value, list) else [value])]
        elif isinstance(value, dict) and isinstance(into.get(name), dict):
            _merge(into[name], value)
        else:
            into[name] = {} if isinstance(value, dict) else copy.deepcopy(value)
            if isinstance(value, dict):
                _merge(into[name], value)


def assigned(text: str) -> dict:
    """A layer of one `a.b.c=value`; numbers and true/false are read as such."""
    name, _, raw = text.partition("=")
    value = {"true": True, "false": False}.get(raw, raw)
    if isinstance(value, str):
        for kind in (int, float):
            try:
                value = kind(raw)
                break
            except ValueError:
                continue
    out: dict = {}
    at = out
    parts = name.split(".")
    for p in parts[:-1]:
        at = at.setdefault(p, {})
    at[parts[-1]] = value
    return out

"""Settings as nested dictionaries."""

from __future__ import annotations


def merged(defaults: dict, own: dict) -> dict:
    """The defaults with one's own values over them, level by level; unknown keys stay."""
    out = dict(defaults)
    for key, value in own.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out

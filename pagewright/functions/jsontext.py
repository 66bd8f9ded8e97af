"""Decoding of JSON text as it lies in the tables: null, empty, cut off, or JSON text inside a JSON string."""

from __future__ import annotations

import json
from typing import Any


def decode(text: str | None, unwrap: bool = False) -> Any:
    """The decoded value, or None for null, empty or broken text. With `unwrap` a JSON string that holds JSON text is decoded again."""
    if not text:
        return None
    try:
        value = json.loads(text)
        while unwrap and isinstance(value, str):
            value = json.loads(value)
    except (ValueError, RecursionError):
        return None
    return value


def kind(value: Any) -> str | None:
    """JSON type name; None for a JSON null, whose type isn't known."""
    if value is None:
        return None
    if isinstance(value, str):
        return "string"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "array" if isinstance(value, list) else "object"


def leaves(value: dict, prefix: str = "") -> dict[str, Any]:
    """Dotted path -> value of the values inside objects; arrays and empty objects are values themselves."""
    out: dict[str, Any] = {}
    stack = [(prefix, value)]
    while stack:
        at, obj = stack.pop()
        for k, v in obj.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict) and v:
                stack.append((path, v))
            else:
                out[path] = v
    return out

"""Small helpers on values and records."""

from __future__ import annotations

import json
import re
import time

from sheaf.errors import SheafError

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")


def now_ts() -> int:
    """Seconds since the epoch."""
    return int(time.time())


def clamp(value, low, high):
    return low if value < low else high if value > high else value


def check_name(name: str) -> str:
    """A collection name, or ValueError."""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no valid name: a letter or underscore, then up to 63 letters, digits or underscores")
    return name


def is_valid_name(name: str) -> bool:
    return isinstance(name, str) and _NAME.fullmatch(name) is not None


def encode_line(record: dict) -> str:
    """Compact JSON on one line; NaN and infinities are refused, as VARIANT has no place for them."""
    try:
        return json.dumps(record, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except ValueError as e:
        raise SheafError(f"not storable as JSON: {e}") from e


def decode_line(line: str) -> dict | None:
    line = line.strip()
    return json.loads(line) if line else None


def deep_merge(base: dict, updates: dict) -> dict:
    """A new dict in which dicts on both sides merge and other values of ``updates`` win."""
    out = dict(base)
    for key, new in updates.items():
        old = out.get(key)
        out[key] = deep_merge(old, new) if isinstance(old, dict) and isinstance(new, dict) else new
    return out


def strip_internal_keys(record: dict) -> dict:
    return {k: v for k, v in record.items() if not k.startswith("_")}


def public_view(record: dict) -> dict:
    """Without the ``_`` keys, with ``id`` last."""
    out = strip_internal_keys(record)
    if "_id" in record:
        out.pop("id", None)
        out["id"] = record["_id"]
    return out

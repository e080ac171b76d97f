"""Settings: defaults, then a file of `key = value` lines, then the environment, then arguments."""

from __future__ import annotations

import os
import re

from readloom.errors import LoomError

UNITS = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}
DEFAULTS = {"thresholds": "1,10,20,30", "near_distance": "250", "memory_limit": "4GiB", "keep_failed": "false"}
_ESCAPES = {"\\": "\\", '"': '"', "n": "\n", "r": "\r", "t": "\t"}


def memory_size(text: str) -> int:
    m = re.fullmatch(r"([0-9]+)(B|KiB|MiB|GiB|TiB)", text)
    if not m or not 0 < int(m[1]) * UNITS[m[2]] < 2**63:
        raise LoomError("configuration", f"{text!r} is no memory size")
    return int(m[1]) * UNITS[m[2]]


def threshold_list(text: str) -> list[int]:
    parts = [p.strip() for p in text.split(",")]
    if not all(re.fullmatch("[0-9]+", p) and 0 < int(p) < 2**32 for p in parts):
        raise LoomError("configuration", f"{text!r} is no list of thresholds")
    return sorted({int(p) for p in parts})


def _value(text: str, line: int) -> str:
    if not text.startswith('"'):
        return text
    m = re.fullmatch(r'"((?:[^"\\]|\\["\\nrt])*)"', text)
    if not m:
        raise LoomError("configuration", f"line {line} has a bad quoted value")
    return re.sub(r"\\(.)", lambda e: _ESCAPES[e[1]], m[1])


def parse_settings(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, equals, value = (p.strip() for p in line.partition("="))
        if not equals or key in found or key not in {*DEFAULTS, "schema_version"}:
            raise LoomError("configuration", f"line {number} is malformed, repeated or unknown")
        found[key] = _value(value, number)
    if found.pop("schema_version", None) != "1":
        raise LoomError("configuration", "schema_version = 1 is required")
    return found


def resolve(file_text: str | None = None, arguments: dict[str, str] | None = None, environment=os.environ) -> dict:
    text = DEFAULTS | (parse_settings(file_text) if file_text is not None else {})
    text |= {k: environment[f"READLOOM_{k.upper()}"] for k in DEFAULTS if f"READLOOM_{k.upper()}" in environment}
    text |= {k: v for k, v in (arguments or {}).items() if v is not None}
    if not re.fullmatch("[0-9]+", text["near_distance"]) or text["keep_failed"] not in ("true", "false"):
        raise LoomError("configuration", "near_distance or keep_failed is malformed")
    return {"thresholds": threshold_list(text["thresholds"]), "near_distance": int(text["near_distance"]), "memory_limit": memory_size(text["memory_limit"]), "keep_failed": text["keep_failed"] == "true"}

"""Sizes, durations and times as text."""

from __future__ import annotations

import re

from ..errors import UsageError

# fixed values: unit names and their factors
SIZES = {"": 1, "B": 1, "KB": 1000, "MB": 1000**2, "GB": 1000**3, "TB": 1000**4, "KIB": 1024, "MIB": 1024**2, "GIB": 1024**3, "TIB": 1024**4}
DURATIONS = {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}


def parse_size(text: str) -> int:
    """128MB, 1GiB, 4096: decimal units by 1000, binary ones by 1024."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", str(text))
    if not m or m[2].upper() not in SIZES:
        raise UsageError(f"not a size: {text}")
    return int(float(m[1]) * SIZES[m[2].upper()])


def parse_duration(text: str) -> int:
    """Seconds of 7d, 12h, 30m, 90s or 90."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", str(text))
    if not m:
        raise UsageError(f"not a duration: {text}")
    return int(m[1]) * DURATIONS[m[2]]


def format_size(n: int, exact: bool = False) -> str:
    if exact or n < 1000:
        return f"{n} B"
    value, unit = float(n), "B"
    for unit in ("KB", "MB", "GB", "TB"):
        value /= 1000
        if value < 1000:
            break
    return f"{value:.1f} {unit}"


def shorten(text: str, width: int) -> str:
    return text if len(text) <= width else text[: max(0, width - 3)] + "..."

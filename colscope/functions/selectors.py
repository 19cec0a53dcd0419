"""Column selectors: `a,b`, `/regex/`, `!a`, `#3`, `#1-4`, `#-2`, in any mix.

A regex may hold commas. Positions start at zero; `#-n` means the last n columns. Without a positive part all
columns but the excluded ones are meant. Names that do not exist are passed over, or refused with strict. The result
has the table's order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..errors import UsageError


def parts(pattern: str) -> list[str]:
    out, rest = [], pattern.strip()
    while rest:
        m = re.match(r"\s*(/(?:\\.|[^/\\])*/|[^,]*)\s*(?:,|$)", rest)
        if not m:  # an open slash
            m = re.match(r"\s*([^,]*)\s*(?:,|$)", rest)
        if m[1].strip():
            out.append(m[1].strip())
        rest = rest[m.end() :]
    return out


def select_names(pattern: str | None, columns: Sequence[str], strict: bool = False) -> list[str]:
    if not pattern or pattern.strip() == "*":
        return list(columns)
    chosen, excluded, positive = set(), set(), False
    for p in parts(pattern):
        if p.startswith("!"):
            excluded.add(p[1:])
            continue
        positive = True
        if len(p) > 1 and p[0] == p[-1] == "/":
            try:
                rule = re.compile(p[1:-1])
            except re.error as e:
                raise UsageError(f"bad column pattern {p}: {e}") from None
            chosen |= {c for c in columns if rule.search(c)}
        elif m := re.fullmatch(r"#-(\d+)", p):
            chosen |= set(columns[max(0, len(columns) - int(m[1])) :])
        elif m := re.fullmatch(r"#(\d+)-(\d+)", p):
            chosen |= set(columns[int(m[1]) : int(m[2]) + 1])
        elif m := re.fullmatch(r"#(\d+)", p):
            chosen |= set(columns[int(m[1]) : int(m[1]) + 1])
        else:
            if strict and p not in columns:
                raise UsageError(f"no such column: {p}")
            chosen.add(p)
    return [c for c in columns if c not in excluded and (c in chosen or not positive)]


def select(df: DataFrame, pattern: str | None, strict: bool = False) -> DataFrame:
    return df.select(*[f"`{c.replace('`', '``')}`" for c in select_names(pattern, df.columns, strict)])

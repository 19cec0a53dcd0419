"""Rows as a table, JSON, JSON lines, CSV or TSV text."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame

from ..errors import UsageError
from .units import shorten

FORMATS = ("table", "json", "jsonl", "csv", "tsv")
ENDS = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "csv": "csv", "tsv": "tsv"}


def choose(asked: str | None, output: str | None, terminal: bool) -> str:
    """What is asked for, else what the output's name says, else a table on a terminal and JSON in a pipe."""
    if asked:
        if asked not in FORMATS:
            raise UsageError(f"no such format: {asked}; there are {', '.join(FORMATS)}")
        return asked
    if output:
        return ENDS.get(output.rsplit(".", 1)[-1].lower(), "json")
    return "table" if terminal else "json"


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if v is None or isinstance(v, (bool, int, float, str)) else v.isoformat() if hasattr(v, "isoformat") else str(v)


def text(v) -> str:
    v = plain(v)
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def table(columns: Sequence[str], rows: Iterable[Sequence], width: int = 60) -> Iterator[str]:
    cells = [[shorten(text(v).replace("\n", " "), width) for v in r] for r in rows]
    size = [max([len(c), *(len(r[k]) for r in cells)]) for k, c in enumerate(columns)]
    line = "+" + "+".join("-" * (n + 2) for n in size) + "+"
    put = lambda r: "|" + "|".join(f" {c:<{n}} " for c, n in zip(r, size)) + "|"
    yield from (line, put(columns), line, *(put(r) for r in cells), line)


def render(df: DataFrame, form: str, most: int = 1000) -> Iterator[str]:
    """Lines of text. A table shows at most `most` rows, which it must hold; the other forms come a row at a time."""
    columns = df.columns
    if form == "table":
        got = df.limit(most + 1).collect()
        yield from table(columns, got[:most])
        if len(got) > most:
            yield f"(the first {most} rows)"
        return
    rows = df.toLocalIterator()
    if form in ("csv", "tsv"):
        buffer = io.StringIO()
        out = csv.writer(buffer, delimiter="\t" if form == "tsv" else ",", lineterminator="")
        out.writerow(columns)
        yield buffer.getvalue()
        for r in rows:
            buffer.seek(0)
            buffer.truncate()
            out.writerow([text(v) for v in r])
            yield buffer.getvalue()
        return
    first = True
    if form == "json":
        yield "["
    for r in rows:
        one = json.dumps({c: plain(v) for c, v in zip(columns, r)}, ensure_ascii=False)
        if form == "jsonl":
            yield one
        else:
            yield ("  " if first else ", ") + one
        first = False
    if form == "json":
        yield "]"

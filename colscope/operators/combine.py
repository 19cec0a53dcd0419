"""Unions, joins and differences of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UsageError
from ..sources.resolve import Source
from .rows import FILE, ROW, ordered, scan


def cat(tables: Sequence[tuple[str, DataFrame]], by_name: bool = False, add_filename: bool = False, sort_by: str | None = None) -> DataFrame:
    """All rows of (name, table) pairs. Strictly, schemas must be equal; by name, missing columns are null, and a column's types must agree."""
    if not tables:
        raise UsageError("no input")
    first = tables[0][1]
    kinds: dict[str, tuple[str, str]] = {}
    for name, df in tables:
        if not by_name and [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in first.schema]:
            raise UsageError(f"{name}: its schema is not that of {tables[0][0]}; columns can be matched by name")
        for c, t in df.dtypes:
            if kinds.setdefault(c, (t, name))[0] != t:
                raise UsageError(f"{name}: column {c} is {t}, but {kinds[c][0]} in {kinds[c][1]}")
    dfs = [df.withColumn("_filename", F.lit(name)) if add_filename else df for name, df in tables]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs) if by_name else reduce(DataFrame.union, dfs)
    if add_filename:
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if c != "_filename"], "_filename")
    return ordered(out, sort_by) if sort_by else out


def cat_files(spark: SparkSession, sources: Sequence[Source], by_name: bool = False, add_filename: bool = False, sort_by: str | None = None) -> DataFrame:
    return cat([(s.name, spark.read.parquet(s.path)) for s in sources], by_name, add_filename, sort_by)


def _keys(text: str | Sequence[str]) -> list[str]:
    return [k.strip() for k in text.split(",") if k.strip()] if isinstance(text, str) else list(text)


def merge(left: DataFrame, right: DataFrame, key: str | Sequence[str], outer: bool = False) -> DataFrame:
    """Inner (or left outer) join on keys, null equal to null; all left columns, then right columns whose names the left does not have."""
    keys = _keys(key)
    for side, df in (("left", left), ("right", right)):
        if missing := [k for k in keys if k not in df.columns]:
            raise UsageError(f"no column {missing[0]} on the {side} side")
    new = [c for c in right.columns if c not in left.columns]
    r = right.select(*[F.col(f"`{c}`") for c in [*keys, *new]]).alias("r")
    joined = left.alias("l").join(r, [_eq(left, right, k) for k in keys], "left" if outer else "inner")
    return joined.select("l.*", *[F.col(f"r.`{c}`") for c in new])


def _eq(left: DataFrame, right: DataFrame, k: str) -> Column:
    """Null-safe equality; keys of different types are compared as text."""
    x, y = F.col(f"l.`{k}`"), F.col(f"r.`{k}`")
    if left.schema[k].dataType != right.schema[k].dataType:
        x, y = x.cast("string"), y.cast("string")
    return x.eqNullSafe(y)


def _unlike(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    return out


def _difference(a: DataFrame, b: DataFrame, on: list[Column], common: Sequence[str], there: str, keys: list[Column]) -> DataFrame:
    j = a.alias("a").join(b.alias("b"), on, "full_outer")
    status = F.when(F.col(f"a.{there}").isNull(), "added").when(F.col(f"b.{there}").isNull(), "removed").when(_unlike(common), "changed").otherwise("same")
    row = lambda x: F.when(F.col(f"{x}.{there}").isNotNull(), F.struct(*[F.col(f"{x}.`{c}`") for c in common]))
    return j.select(status.alias("status"), *keys, row("a").alias("row_a"), row("b").alias("row_b")).where("status <> 'same'")


def diff_keyed(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """status (added, removed, changed), the keys, row_a, row_b for rows that differ, by a full outer join on null-safe keys. Values are compared by type in columns of both sides. A key that repeats on a side pairs with each match."""
    keys = _keys(key)
    if missing := [k for k in keys if k not in a.columns or k not in b.columns]:
        raise UsageError(f"no column {missing[0]} on both sides")
    common = [c for c in a.columns if c in b.columns]
    on = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    out_keys = [F.when(F.col("a._there").isNull(), F.col(f"b.`{k}`")).otherwise(F.col(f"a.`{k}`")).alias(k) for k in keys]
    return _difference(a.withColumn("_there", F.lit(True)), b.withColumn("_there", F.lit(True)), on, common, "_there", out_keys)


def diff_positional(spark: SparkSession, a: Source, b: Source) -> DataFrame:
    """status, row (index), row_a, row_b for rows of two files that differ at the same place."""
    x, y = scan(spark, [a]).drop(FILE), scan(spark, [b]).drop(FILE)
    common = [c for c in x.columns if c in y.columns and c != ROW]
    return _difference(x, y, [F.col(f"a.{ROW}") == F.col(f"b.{ROW}")], common, ROW, [F.coalesce(f"a.{ROW}", f"b.{ROW}").alias("row")])


def diff_totals(diff: DataFrame) -> DataFrame:
    """total_added, total_removed, total_changed: of all differences, however many are shown."""
    return diff.agg(*[F.count_if(F.col("status") == s).alias(f"total_{s}") for s in ("added", "removed", "changed")])

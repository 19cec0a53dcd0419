"""Row access by place in the file: head, tail, exact samples, slices, row groups, pruning, splitting.

A row's place is (file, row index), which Spark's reader gives as metadata, so that "first", "last" and "row 17" mean
what they mean in the file and no sort or shuffle is needed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UsageError
from ..functions.dialect import shortened
from ..functions.selectors import select_names
from ..sources.footer import footer
from ..sources.resolve import Source

FILE, ROW = "_file", "_row"


def scan(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """Rows of the files with `_file` and `_row`. Folder names give no columns; all files must have the first one's columns."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(*[s.path for s in sources])
    return df.select("*", F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def shown(df: DataFrame, columns: str | None, place: bool) -> DataFrame:
    own = [c for c in df.columns if c not in (FILE, ROW)]
    return df.select(*[F.col(f"`{c}`") for c in [*select_names(columns, own), *([FILE, ROW] if place else [])]])


def head(spark: SparkSession, sources: Sequence[Source], n: int = 10, columns: str | None = None, place: bool = False) -> DataFrame:
    """The first n rows of each file."""
    return shown(scan(spark, sources).where(F.col(ROW) < n), columns, place)


def per_file(df: DataFrame, sources: Sequence[Source]) -> DataFrame:
    """A table with a row per file, to be broadcast unless there are very many files: rows then stay where they are, in order."""
    return F.broadcast(df) if len(sources) <= 100_000 else df


def _with_counts(df: DataFrame, spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    counts = footer(spark, sources, "files").select(F.col("file").alias(FILE), F.col("num_rows").alias("_rows"))
    return df.join(per_file(counts, sources), FILE)


def tail(spark: SparkSession, sources: Sequence[Source], n: int = 10, columns: str | None = None, place: bool = False) -> DataFrame:
    """The last n rows of each file; the number of rows comes from the footer."""
    df = _with_counts(scan(spark, sources), spark, sources)
    return shown(df.where(F.col(ROW) >= F.col("_rows") - n).drop("_rows"), columns, place)


def sample(spark: SparkSession, sources: Sequence[Source], n: int = 1000, seed: int = 0, columns: str | None = None, place: bool = False) -> DataFrame:
    """Exactly n rows of each file without replacement (all, if it has no more), in file order; equal seeds give equal rows however the data are partitioned.

    The n smallest hashes of (seed, row) are found among places alone, per file by a top-k; the rows follow by a join on the place.
    """
    from pyspark.sql import Window

    df = scan(spark, sources)
    order = Window.partitionBy(FILE).orderBy(F.xxhash64(F.lit(seed), F.col(ROW)), ROW)
    chosen = df.select(FILE, ROW).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).select(FILE, ROW)
    picked = df.join(chosen, [FILE, ROW], "left_semi")
    return shown(picked.orderBy(FILE, ROW), columns, place)


def parse_range(text: str) -> tuple[int, int | None]:
    """start:end, end exclusive; either may be left out."""
    m = re.fullmatch(r"\s*(\d*)\s*:\s*(\d*)\s*", text)
    if not m or (m[1] and m[2] and int(m[1]) > int(m[2])):
        raise UsageError(f"not a range of rows: {text}")
    return int(m[1] or 0), int(m[2]) if m[2] else None


def parse_list(text: str) -> list[int]:
    """0,2-5 -> 0, 2, 3, 4, 5"""
    out: list[int] = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", part)
        if not m:
            raise UsageError(f"not a list of row groups: {text}")
        out += range(int(m[1]), int(m[2] or m[1]) + 1)
    return sorted(set(out))


PREDICATE = re.compile(r"^\s*(.+?)\s*(>=|<=|>|<|=)\s*(.+?)\s*$")


def parse_predicate(text: str) -> tuple[str, str, str]:
    m = PREDICATE.match(text)
    if not m:
        raise UsageError(f"not a predicate of the form column op value: {text}")
    return m[1].strip(), m[2], m[3].strip().strip("'\"")


def _may_hold(lo: Column, hi: Column, op: str, value) -> Column:
    return {">": hi > value, ">=": hi >= value, "<": lo < value, "<=": lo <= value, "=": (lo <= value) & (hi >= value)}[op]


def groups(spark: SparkSession, sources: Sequence[Source], row_groups: str | None = None, prune: str | None = None) -> DataFrame:
    """_file, row_group, _from, _to (row indexes): the row groups that are listed and whose statistics do not rule the predicate out."""
    from pyspark.sql import Window

    chunks = footer(spark, sources, "chunks")
    every = chunks.groupBy(F.col("file").alias(FILE), "row_group").agg(F.max("rg_rows").alias("n"))
    before = F.sum("n").over(Window.partitionBy(FILE).orderBy("row_group"))
    every = every.withColumn("_to", before).withColumn("_from", F.col("_to") - F.col("n"))
    if row_groups is not None:
        every = every.where(F.col("row_group").isin(parse_list(row_groups)))
    if prune is not None:
        column, op, text = parse_predicate(prune)
        number = float(text) if re.fullmatch(r"[-+]?\d+(\.\d+)?([eE][-+]?\d+)?", text) else None
        col = chunks.where(F.col("path") == column)
        if col.isEmpty():
            raise UsageError(f"no such column: {column}")
        numeric = F.coalesce(F.col("min_num"), F.col("min_int").cast("double")).isNotNull()
        if number is None:
            holds = F.when(F.col("min_str").isNotNull(), _may_hold(F.col("min_str"), F.col("max_str"), op, text)).otherwise(True)
        else:
            by_number = _may_hold(F.coalesce("min_num", F.col("min_int").cast("double")), F.coalesce("max_num", F.col("max_int").cast("double")), op, number)
            holds = F.when(numeric, by_number).when(F.col("min_str").isNotNull(), _may_hold(F.col("min_str"), F.col("max_str"), op, text)).otherwise(True)
        every = every.join(col.where(holds).select(F.col("file").alias(FILE), "row_group"), [FILE, "row_group"])
    return every.select(FILE, "row_group", "_from", "_to")


def slice_rows(spark: SparkSession, sources: Sequence[Source], rows: str | None = None, row_groups: str | None = None, columns: str | None = None, prune: str | None = None, place: bool = False) -> DataFrame:
    """Rows that meet all that is given: a range of row indexes of each file, listed row groups, row groups that a predicate may hold in (their rows are not filtered)."""
    df = scan(spark, sources)
    if rows is not None:
        start, end = parse_range(rows)
        df = df.where(F.col(ROW) >= start)
        if end is not None:
            df = df.where(F.col(ROW) < end)
    if row_groups is not None or prune is not None:
        g = groups(spark, sources, row_groups, prune)
        held = g.groupBy(FILE).agg(F.array_sort(F.collect_list(F.struct("_from", "_to"))).alias("_g"))  # row groups of one file
        df = df.join(per_file(held, sources), FILE).where(F.exists("_g", lambda x: (F.col(ROW) >= x["_from"]) & (F.col(ROW) < x["_to"]))).drop("_g")
    return shown(df, columns, place)


def split_ids(spark: SparkSession, sources: Sequence[Source], parts: int) -> DataFrame:
    """Rows with `_part`: parts contiguous runs of ceil(rows / parts) rows over all files in order of name. Places come from footers; nothing is sorted."""
    if parts < 1:
        raise UsageError("the number of parts must be positive")
    counts = {r.file: r.num_rows for r in footer(spark, sources, "files").select("file", "num_rows").collect()}
    start, at = {}, 0
    for s in sources:
        start[s.name], at = at, at + (counts.get(s.name) or 0)
    size = max(1, -(-at // parts))
    offsets = spark.createDataFrame([(k, v) for k, v in start.items()], f"{FILE} string, _start long")
    return scan(spark, sources).join(per_file(offsets, sources), FILE).withColumn("_part", F.floor((F.col("_start") + F.col(ROW)) / F.lit(size)).cast("int")).drop("_start")


def split_row_groups(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """Rows with `_part`: one per row group, numbered on across files."""
    g = groups(spark, sources).orderBy(FILE, "row_group").collect()  # row groups, not rows
    numbered = spark.createDataFrame([(r[FILE], r._from, r._to, k) for k, r in enumerate(g)], f"{FILE} string, _from long, _to long, _part int")
    held = numbered.groupBy(FILE).agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_part"))).alias("_g"))
    df = scan(spark, sources).join(per_file(held, sources), FILE)
    own = F.filter("_g", lambda x: (F.col(ROW) >= x["_from"]) & (F.col(ROW) < x["_to"]))
    return df.withColumn("_part", own[0]["_part"]).drop("_g")


def display(df: DataFrame, width: int | None) -> DataFrame:
    """Texts cut to a width for showing; other types as they are."""
    return df if not width else df.select(*[shortened(F.col(f"`{c}`"), width).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def ordered(df: DataFrame, columns: str) -> DataFrame:
    """Sorted by columns, ascending, nulls first."""
    names = [c.strip() for c in columns.split(",") if c.strip()]
    if missing := [c for c in names if c not in df.columns]:
        raise UsageError(f"no such column: {missing[0]}")
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in names])

"""Rewriting data sets: splitting by value, compaction, re-encoding, conversion."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PartlyFailed, UsageError
from ..functions.units import parse_size
from ..sources import sinks
from ..sources.footer import footer
from ..sources.resolve import Source
from .combine import cat_files
from .footers import dominant_codec
from .rows import FILE, ROW, ordered, scan, split_ids, split_row_groups

NULL_LABEL = "__null__"


def split_labels(df: DataFrame, column: str) -> DataFrame:
    """Rows with `_label`, the column's value as text; null is __null__."""
    if column not in df.columns:
        raise UsageError(f"no such column: {column}")
    return df.withColumn("_label", F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(NULL_LABEL)))


def named(template: str, label: str) -> str:
    """{n} is the label's place; without it, _label goes before the extension."""
    safe = quote(label, safe=" ._-=+@")
    if "{n}" in template:
        return template.replace("{n}", safe)
    stem, dot, end = template.rpartition(".")
    return f"{stem}_{safe}{dot}{end}" if dot else f"{template}_{safe}"


def write_split(df: DataFrame, label: str, out: str, **parquet) -> list[str]:
    """One Parquet file per label, written in one pass. Rows are dealt out by label; the adaptive plan cuts a label of more than a partition's size, which then becomes a folder of files, so that a frequent value is not one task's work."""
    spark = df.sparkSession
    folder = f"{out}.split"
    drop = [c for c in (FILE, ROW) if c in df.columns]
    dealt = df.drop(*drop).withColumn("_dir", F.col(label).cast("string"))
    kept = dealt.drop(label) if label in ("_part", "_label") else dealt
    kept.hint("rebalance", "_dir").write.options(**sinks.parquet_options(**(parquet or {"compression": "zstd"}))).partitionBy("_dir").parquet(folder)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    made = []
    for s in sorted(fs.listStatus(root), key=lambda s: s.getPath().getName()):
        name = s.getPath().getName()
        if name.startswith("_dir="):
            value = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[5:])
            target = named(out, value)
            parts = [p.getPath() for p in fs.listStatus(s.getPath()) if p.getPath().getName().startswith("part-")]
            path = jvm.org.apache.hadoop.fs.Path(target)
            if path.getParent() is not None:
                fs.mkdirs(path.getParent())
            if fs.exists(path):
                fs.delete(path, True)
            fs.rename(parts[0] if len(parts) == 1 else s.getPath(), path)
            made.append(target)
    fs.delete(root, True)
    return made


def split_by(spark: SparkSession, sources: Sequence[Source], column: str, out: str, **parquet) -> list[str]:
    return write_split(split_labels(scan(spark, sources), column), "_label", out, **parquet)


def split_n(spark: SparkSession, sources: Sequence[Source], parts: int, out: str, **parquet) -> list[str]:
    return write_split(split_ids(spark, sources, parts), "_part", out, **parquet)


def split_groups(spark: SparkSession, sources: Sequence[Source], out: str, **parquet) -> list[str]:
    return write_split(split_row_groups(spark, sources), "_part", out, **parquet)


def plan_compaction(files: Sequence[tuple[str, int, int]], target: str | int = "128MB", min_file: str | int | None = None, by_folder: bool = False) -> list[dict]:
    """Groups of small files, filled in order until they reach the target: files (name, bytes, rows) -> [{files, total_bytes, total_rows}].

    Files of at least min_file (half the target) stay as they are, and so does a group of one.
    """
    goal = parse_size(target)
    least = parse_size(min_file) if min_file is not None else goal // 2
    folders: dict[str, list] = {}
    for name, size, rows in sorted(files):
        if size < least:
            folders.setdefault(name.rpartition("/")[0] if by_folder else "", []).append((name, size, rows))
    groups = []
    for members in folders.values():
        now, total = [], 0
        for m in members:
            now.append(m)
            total += m[1]
            if total >= goal:
                groups.append(now)
                now, total = [], 0
        if now:
            groups.append(now)
    return [{"files": [x[0] for x in g], "total_bytes": sum(x[1] for x in g), "total_rows": sum(x[2] for x in g)} for g in groups if len(g) > 1]


def compaction_files(spark: SparkSession, sources: Sequence[Source]) -> list[tuple[str, int, int]]:
    return [(r.file, r.size_bytes, r.num_rows) for r in footer(spark, sources, "files").where("error is null").select("file", "size_bytes", "num_rows").collect()]  # a row per file


def compact(spark: SparkSession, sources: Sequence[Source], out: str, target: str = "128MB", min_file: str | None = None, by_folder: bool = False, sort_by: str | None = None, in_place: bool = False, backup: str | None = None, dry_run: bool = False, **parquet) -> DataFrame:
    """Merge small files into compacted_0000.parquet and so on under `out`; group, files, total_bytes, total_rows, output.

    With in_place a group's inputs are deleted after its output has been read back with as many rows; `backup` gets
    copies first, at their full paths. A group that fails leaves its inputs alone; the others go on.
    """
    plan = plan_compaction(compaction_files(spark, sources), target, min_file, by_folder)
    by_name = {s.name: s for s in sources}
    rows, failed = [], []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for k, g in enumerate(plan):
        name = f"{out.rstrip('/')}/compacted_{k:04d}.parquet"
        rows.append((k, g["files"], g["total_bytes"], g["total_rows"], name))
        if dry_run:
            continue
        try:
            members = [by_name[f] for f in g["files"]]
            df = cat_files(spark, members)
            sinks.write(ordered(df.coalesce(1), sort_by) if sort_by else df, name, "parquet", **parquet)
            if spark.read.parquet(name).count() != g["total_rows"]:
                raise UsageError(f"{name} does not have {g['total_rows']} rows")
            for s in members if in_place else []:
                p = jvm.org.apache.hadoop.fs.Path(s.path)
                fs = p.getFileSystem(conf)
                if backup:
                    b = jvm.org.apache.hadoop.fs.Path(backup.rstrip("/") + "/" + re.sub(r"^[a-z0-9+]+:/+|^/+", "", s.name))
                    fs.mkdirs(b.getParent())
                    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, b.getFileSystem(conf), b, False, conf)
                fs.delete(p, False)
        except Exception as e:
            failed.append(f"group {k}: {e}")
    if failed:
        raise PartlyFailed("; ".join(failed))
    return spark.createDataFrame(rows, "`group` int, files array<string>, total_bytes long, total_rows long, output string")


def parse_kv(text: str | None) -> dict[str, str]:
    out = {}
    for part in (text or "").split(","):
        if part.strip():
            k, eq, v = part.partition("=")
            if not eq:
                raise UsageError(f"not of the form key=value: {part}")
            out[k.strip()] = v.strip()
    return out


def rewrite(spark: SparkSession, source: Source, out: str, compression: str | None = None, sort_by: str | None = None, strip_metadata: bool = False, strip_kv: str | None = None, set_kv: str | None = None, **parquet) -> None:
    """One file anew: codec (its own, unless another is given), row groups, order, dictionary, writer version, key-value metadata."""
    if compression is None:
        first = dominant_codec(footer(spark, [source], "chunks").where("error is null")).first()
        compression = {"UNCOMPRESSED": "none", "LZ4_RAW": "lz4"}.get(first.compression, first.compression.lower()) if first else "zstd"
    old = footer(spark, [source], "files").first().kv or {}
    kv = {} if strip_metadata else {k: v for k, v in old.items() if not k.startswith(("ARROW:", "org.apache.spark")) and k not in [x.strip() for x in (strip_kv or "").split(",")]}
    kv |= parse_kv(set_kv)
    df = spark.read.parquet(source.path)
    sinks.write(ordered(df.coalesce(1), sort_by) if sort_by else df, out, "parquet", kv=kv or None, compression=compression, **parquet)


def convert(spark: SparkSession, inputs: Sequence[str], out: str, header: bool = True, delimiter: str | None = None, infer_rows: int = 1000, schema: str | None = None, **parquet) -> list[str]:
    """CSV, TSV, JSON lines or Arrow to Parquet, and Parquet to these or to Parquet. Several inputs go into a folder; text becomes .parquet there, Parquet .csv."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[str] = []
    for text in inputs:
        p = jvm.org.apache.hadoop.fs.Path(text)
        hits = p.getFileSystem(conf).globStatus(p)
        if not hits:
            raise UsageError(f"{text}: no such file")
        found += sorted(re.sub(r"^file:/+", "/", s.getPath().toString()) for s in hits)
    made = []
    for path in found:
        if len(found) > 1 or out.endswith("/"):
            end = "csv" if sinks.kind_of(path) == "parquet" else "parquet"
            target = f"{out.rstrip('/')}/{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}.{end}"
        else:
            target = out
        df = sinks.read(spark, path, header, delimiter, infer_rows, schema)
        kind = sinks.kind_of(target)
        sinks.write(df, target, kind, header=header, delimiter=delimiter, **(parquet if kind == "parquet" else {}))
        made.append(target)
    return made

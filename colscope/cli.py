"""The command line: `python -m colscope COMMAND ...`; without a command, inspect."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from . import session
from .errors import CheckFailed, ColscopeError, UsageError
from .functions import config, render
from .functions.units import format_size
from .operators import check, combine, ddl, footers, reshape, rows
from .plans import sql
from .sources import sinks
from .sources.footer import arrow_schema, footer_trees
from .sources.resolve import cloud_conf, configure_cloud, is_parquet, resolve, spark_path

# fixed values: commands and their short names
ALIASES = {
    "inspect": ["i"], "schema": ["s", "sch"], "stats": ["st"], "head": ["h"], "tail": ["t"], "sample": ["sa"], "check": ["c", "validate"], "compact": ["cc"], "convert": ["cv"],
    "slice": ["sl"], "rewrite": ["rw"], "cat": [], "count": ["n"], "size": ["sz"], "diff": ["d"], "merge": ["m"], "sql": ["q", "query"],
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="colscope", description="Parquet rows and footers, by Spark.")
    both = argparse.ArgumentParser(add_help=False)
    for flags, kw in [
        (("-o", "--output"), {}), (("-f", "--format"), {}), (("-q", "--quiet"), {"action": "store_true"}), (("-v", "--verbose"), {"action": "store_true"}),
        (("--folder",), {"action": "store_true", "help": "write a folder with files of all tasks instead of one file"}),
        (("-j", "--jobs"), {"type": int}), (("--endpoint",), {}), (("--master",), {}), (("--config",), {}),
    ]:
        both.add_argument(*flags, **kw)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, files: str | None = "+") -> None:
        p = sub.add_parser(name, aliases=ALIASES[name], parents=[both])
        p.set_defaults(command=name)
        for flags, kw in args:
            p.add_argument(*flags.split(), **kw)
        if files:
            p.add_argument("files", nargs=files)

    yes, num = {"action": "store_true"}, {"type": int}
    parquet = [("--compression", {}), ("--compression-level", num), ("--row-group-size", num), ("--dictionary", yes)]
    add("inspect", ("--all", yes), ("--schema-only", yes), ("--meta-only", yes), ("--raw", yes), ("--sort", {}))
    add("schema", ("--expand", yes), ("--arrow", yes), ("--ddl", {}), ("--ref", {}), ("--changes-only", yes))
    add("stats", ("-c --columns", {}), ("-g --row-groups", yes), ("--pages", yes), ("--bloom", yes), ("--size-only", yes), ("--sort", {}), ("--scan", yes))
    for name in ("head", "tail"):
        add(name, ("-n", {"type": int, "default": 10}), ("-c --columns", {}), ("--wide", yes), ("--max-width", {"type": int, "default": 40}))
    add("sample", ("-n", {"type": int, "default": 1000}), ("--seed", {"type": int, "default": 0}), ("-c --columns", {}))
    add("check", ("--read-data", yes), ("--contract", {}))
    add("compact", ("--target-size", {"default": "128MB"}), ("--sort-by", {}), *parquet, ("--no-stats", yes), ("--dry-run", yes), ("--in-place", yes), ("--backup", {}), ("--min-file-size", {}), ("--preserve-partitions", yes))
    add("convert", *parquet, ("--infer-schema-rows", {"type": int, "default": 1000}), ("--schema", {}), ("--no-header", yes), ("--delimiter", {}))
    add("slice", ("--rows", {}), ("--row-groups", {}), ("-c --columns", {}), ("--prune", {}), ("--split", num), ("--split-row-groups", yes), ("--split-by", {}))
    add("rewrite", *parquet, ("--sort-by", {}), ("--strip-metadata", yes), ("--strip-kv", {}), ("--set-kv", {}), ("--version", num))
    add("cat", ("--union-by-name", yes), ("--add-filename", yes), ("--sort-by", {}))
    add("count", ("--total-only", yes))
    add("size", ("--sort", {}), ("--top", num), ("--bytes", yes))
    add("diff", ("--data", yes), ("--key", {}), ("--changes-only", yes))
    add("merge", ("--key", {"required": True}), ("--left", yes))
    add("sql", ("--from-file", {}), ("--as", {"dest": "aliases", "action": "append", "default": []}), ("--explain", yes), ("--analyze", yes), ("--batch-size", num), files="*")
    return top


def _parquet(a: argparse.Namespace) -> dict:
    out = {"compression": a.compression, "level": a.compression_level, "row_group_rows": a.row_group_size, "dictionary": a.dictionary or None}
    if getattr(a, "no_stats", False):
        out["stats"] = False
    if getattr(a, "version", None):
        out["version"] = a.version
    return {k: v for k, v in out.items() if v is not None}


def _needed(a: argparse.Namespace) -> str:
    if not a.output:
        raise UsageError(f"{a.command} needs -o")
    return a.output


def _two(files: list) -> list:
    if len(files) != 2:
        raise UsageError(f"two files are needed, not {len(files)}")
    return files


def _groups(rows_: list[dict], several: bool) -> list[dict]:
    """Rows of row_group_stats() by row group: row_group, rows, columns."""
    got: dict[tuple, dict] = {}
    for r in rows_:
        file = r.pop("file")
        g = got.setdefault((file, r["row_group"]), ({"file": file} if several else {}) | {"row_group": r["row_group"], "rows": r["rows"], "columns": []})
        g["columns"].append(r)
    return list(got.values())


def run(spark: SparkSession, a: argparse.Namespace, settings: config.Settings, out) -> None:
    """Do a command; rows and text go to `out` or to the output file."""

    def show(df: DataFrame) -> None:
        if settings.output and (is_parquet(settings.output) or a.folder):
            return sinks.write(df, settings.output, settings.format if a.folder and settings.format in ("csv", "tsv", "jsonl") else None, single=not a.folder)
        put(render.render(df, form()))

    def form() -> str:
        return render.choose(settings.format, settings.output, out.isatty())

    def put(lines) -> None:
        if settings.output:
            sinks.write_text(spark, spark_path(settings.output), lines)
        else:
            out.writelines(x + "\n" for x in lines)

    def document(shape) -> bool:
        """One JSON document, if that is the form asked for: `shape` gives it. Reports have a row per file, column or check."""
        if form() != "json" or settings.output and is_parquet(settings.output):
            return False
        put([json.dumps(shape(), indent=2, ensure_ascii=False)])
        return True

    def listed(df: DataFrame, *without: str) -> list[dict]:
        return [{k: render.plain(v) for k, v in r.asDict().items() if k not in without} for r in df.collect()]

    def by_file(df: DataFrame) -> dict[str, list[dict]]:
        got: dict[str, list[dict]] = {}
        for r in listed(df):
            got.setdefault(r.pop("file"), []).append(r)
        return got

    def one_or_all(found: list):
        return found[0] if len(found) == 1 else found

    say = lambda s: None if settings.quiet else print(s, file=sys.stderr)
    c = a.command
    if c == "sql":
        piped = None if sys.stdin is None or sys.stdin.isatty() or a.from_file or a.files else sys.stdin.read()
        text, inputs = sql.split_arguments(a.files, None if a.from_file == "-" else a.from_file, sys.stdin.read() if a.from_file == "-" else piped, bool(a.aliases))
        if a.explain:
            return print(sql.explain(spark, text, inputs, a.aliases), file=out)
        return show(sql.analyze(spark, text, inputs, a.aliases) if a.analyze else sql.query(spark, text, inputs, a.aliases, a.batch_size))
    if c == "convert":
        made = reshape.convert(spark, a.files, _needed(a), not a.no_header, a.delimiter, a.infer_schema_rows, a.schema, **_parquet(a))
        return say(f"{len(made)} files written")
    if c == "schema" and a.files[0] in ("diff", "extract", "show"):
        mode, a.files = a.files[0], a.files[1:]
    else:
        mode = "show"
    files = resolve(spark, a.files, keep_order=c in ("merge", "diff") or mode == "diff")
    if c == "inspect":
        if a.schema_only:
            return show(footers.schema_columns(spark, files, a.sort))
        df = footers.inspect_all(spark, files) if len(files) > 1 else footers.inspect(spark, files)

        def inspected() -> list[dict]:
            cols = by_file(footers.schema_columns(spark, files).select("file", "name", "type", "nullable", "encoding"))
            meta = [{k: v for k, v in r.items() if k != "key_value_metadata" or v} for r in listed(df)]
            return [r | ({} if a.meta_only else {"schema": cols.get(r["file"], [])}) for r in meta]

        if document(inspected):
            return
        show(df.drop("key_value_metadata") if not (a.meta_only or a.raw or a.verbose) else df)
        if a.all or a.verbose:
            show(footers.schema_columns(spark, files, a.sort))
    elif c == "schema":
        if mode == "diff":
            return show(footers.schema_diff(spark, *files, a.changes_only) if len(files) == 2 else footers.schema_diff_many(spark, files, a.ref))
        if a.ddl:
            print(ddl.ddl(files[0], a.ddl), file=out)
        elif a.arrow:
            print(arrow_schema(files[0]), file=out)
        elif a.expand or mode == "extract":
            print(json.dumps(footer_trees(files[:1])[0]["children"], indent=2), file=out)
        else:
            show(footers.schema_columns(spark, files))
    elif c == "stats":
        if a.row_groups and not a.pages and document(lambda: _groups(listed(footers.row_group_stats(spark, files, a.columns)), len(files) > 1)):
            return
        df = footers.page_stats(spark, files, a.columns) if a.pages else footers.bloom_stats(spark, files) if a.bloom else footers.row_group_stats(spark, files, a.columns) if a.row_groups else footers.scanned_stats(spark.read.parquet(*[f.path for f in files])) if a.scan else footers.stats(spark, files, a.columns, a.sort)
        show(df.select("file", "name", "compressed_bytes", "uncompressed_bytes") if a.size_only and "uncompressed_bytes" in df.columns else df)
    elif c in ("head", "tail"):
        df = (rows.head if c == "head" else rows.tail)(spark, files, a.n, a.columns)
        table = render.choose(settings.format, settings.output, out.isatty()) == "table"
        show(rows.display(df, a.max_width) if table and not a.wide else df)
    elif c == "sample":
        show(rows.sample(spark, files, a.n, a.seed, a.columns))
    elif c == "slice":
        if a.split:
            say("\n".join(reshape.split_n(spark, files, a.split, _needed(a))))
        elif a.split_row_groups:
            say("\n".join(reshape.split_groups(spark, files, _needed(a))))
        elif a.split_by:
            df = rows.slice_rows(spark, files, prune=a.prune, place=True) if a.prune else rows.scan(spark, files)
            say("\n".join(reshape.write_split(reshape.split_labels(df, a.split_by), "_label", _needed(a))))
        else:
            show(rows.slice_rows(spark, files, a.rows, a.row_groups, a.columns, a.prune))
    elif c == "check":
        df = check.structural(spark, files, a.read_data)
        if a.contract:
            df = df.unionByName(check.contract(spark, files, check.load_contract(a.contract), a.read_data))
        df = spark.createDataFrame(df.collect(), df.schema)  # a row per check

        def checked() -> list | dict:
            shape = lambda file, of: {"file": file, "passed": sum(x["passed"] for x in of), "failed": sum(not x["passed"] for x in of), "checks": [{k: v for k, v in x.items() if v is not None} for x in of]}
            return one_or_all([shape(file, of) for file, of in by_file(df).items()])

        if not document(checked):
            show(df)
        check.require(df)
    elif c == "compact":
        done = reshape.compact(spark, files, spark_path(a.output or "."), a.target_size, a.min_file_size, a.preserve_partitions, a.sort_by, a.in_place, a.backup, a.dry_run, **_parquet(a))
        settings = dataclasses.replace(settings, output=None)  # the folder of the files, not of the report

        def planned() -> dict:
            groups = listed(done)
            size = {s.name: s.size for s in files}
            return {"input_files": len(files), "input_size_bytes": sum(size.values()), "input_rows": footers.count(spark, files, total=True).first().total, "output_files": len(groups), "groups": [{"files": g["files"], "total_bytes": g["total_bytes"]} for g in groups]}

        if not document(planned):
            show(done)
    elif c == "rewrite":
        if len(files) != 1:
            raise UsageError("rewrite takes one file")
        options = _parquet(a)
        reshape.rewrite(spark, files[0], _needed(a), options.pop("compression", None), a.sort_by, a.strip_metadata, a.strip_kv, a.set_kv, **options)
    elif c == "cat":
        df = combine.cat_files(spark, files, a.union_by_name, a.add_filename, a.sort_by)
        sinks.write(df, _needed(a), "parquet" if is_parquet(a.output) else None, single=not a.folder)
    elif c == "count":
        if a.total_only or len(files) == 1:
            return put([str(footers.count(spark, files, total=True).first().total)])
        rows_of = footers.count(spark, files)
        if not document(lambda: {"files": (got := listed(rows_of)), "total": sum(r["rows"] for r in got)}):
            show(rows_of)
    elif c == "size":
        sizes = footers.column_sizes(spark, files, a.sort, a.top)

        def sized() -> list | dict:
            cols = by_file(sizes)
            return one_or_all([{"file": r["file"], "columns": cols.get(r["file"], [])} | {k: v for k, v in r.items() if k != "file"} for r in listed(footers.size_totals(spark, files))])

        if document(sized):
            return
        show(sizes)
        for r in footers.size_totals(spark, files).collect():
            say(f"{r.file}: data {format_size(r.data_compressed_bytes, a.bytes)}, footer {format_size(r.footer_bytes, a.bytes)}, file {format_size(r.file_size_bytes, a.bytes)}")
    elif c == "diff":
        x, y = _two(files)
        df = None
        if a.data:
            df = combine.diff_keyed(spark.read.parquet(x.path), spark.read.parquet(y.path), a.key) if a.key else combine.diff_positional(spark, x, y)

        def compared() -> dict:
            got = {"schema_diff": listed(footers.schema_diff(spark, x, y, a.changes_only)), "metadata_diff": listed(footers.metadata_diff(spark, x, y))[0]}
            if df is not None:
                some = listed(df.limit(1000))  # shown differences only; the totals are of all
                pick = lambda s: [{k: v for k, v in r.items() if k != "status"} for r in some if r["status"] == s]
                got["data_diff"] = {s: pick(s) for s in ("added", "removed", "changed")} | listed(combine.diff_totals(df))[0]
            return got

        if document(compared):
            return
        show(footers.schema_diff(spark, x, y, a.changes_only))
        show(footers.metadata_diff(spark, x, y))
        if df is not None:
            show(df.limit(1000))
            show(combine.diff_totals(df))
    elif c == "merge":
        x, y = _two(files)
        sinks.write(combine.merge(spark.read.parquet(x.path), spark.read.parquet(y.path), a.key, a.left), _needed(a), single=not a.folder)


def main(argv: Sequence[str] | None = None, out=None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    names = {n for k, v in ALIASES.items() for n in (k, *v)}
    if argv and argv[0] not in names and not argv[0].startswith("-"):
        argv = ["inspect", *argv]
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    try:
        settings = config.load(a.config, None, format=a.format, output=a.output, quiet=a.quiet, verbose=a.verbose, endpoint=a.endpoint, jobs=a.jobs, master=a.master)
        own = spark is None
        spark = spark or session.build(settings.master or f"local[{settings.jobs or '*'}]")
        session.apply_defaults(spark)
        configure_cloud(spark, cloud_conf(settings.endpoint, dict(os.environ)))
        run(spark, a, settings, out or sys.stdout)
        if own:
            spark.stop()
        return 0
    except CheckFailed as e:
        print(e, file=sys.stderr)
        return e.code
    except ColscopeError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code
    except Exception as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1

"""Parquet footers as DataFrames: one row per file, per leaf column, or per column chunk. Pages are never read.

`spark.read.format("parquet_footer")` is a Python data source whose partitions are runs of files, so that the footers
of many files are parsed by many tasks. A file that is no Parquet file gives a row with its error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .resolve import Source

FILES = "file string, size_bytes long, num_rows long, num_row_groups int, num_columns int, created_by string, format_version string, footer_bytes long, kv map<string,string>, error string"
COLUMNS = "file string, ordinal int, index string, path string, name string, top_level string, physical_type string, logical_type string, converted_type string, type string, repetition string, nullable boolean, max_def_level int, max_rep_level int, encodings array<string>, error string"
CHUNKS = (
    "file string, row_group int, rg_rows long, ordinal int, path string, physical_type string, type string, codec string, encodings array<string>, has_dictionary_page boolean, dictionary_page_offset long, "
    "data_page_offset long, compressed_bytes long, uncompressed_bytes long, num_values long, has_stats boolean, null_count long, distinct_count long, "
    "min_int long, max_int long, min_num double, max_num double, min_str string, max_str string, error string"
)
SCHEMAS = {"files": FILES, "columns": COLUMNS, "chunks": CHUNKS}
FILES_PER_TASK = 16

# fixed values: names shown for logical types
SHOWN = {"String": "VARCHAR", "Enum": "ENUM", "JSON": "JSON", "BSON": "BSON", "UUID": "UUID", "Date": "DATE", "Time": "TIME", "List": "LIST", "Map": "MAP", "Float16": "FLOAT16"}
UNITS = {"milliseconds": "MS", "microseconds": "US", "nanoseconds": "NS"}


def open_file(path: str):
    """The file and its size: local paths directly, other addresses by the file system that they name."""
    import pyarrow.fs as fs

    if re.match(r"[a-z0-9+]+://", path) and not path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    else:
        system, inner = fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return system.open_input_file(inner), system.get_file_info(inner).size


def logical(col) -> dict:
    kind = json.loads(col.logical_type.to_json())
    return {} if kind.get("Type") in (None, "None") else kind


def logical_text(kind: dict) -> str | None:
    if not kind:
        return None
    args = ", ".join(f"{k}={v}" for k, v in kind.items() if k not in ("Type", "is_from_converted_type", "force_set_converted_type"))
    return kind["Type"] + (f"({args})" if args else "")


def type_name(physical: str, kind: dict) -> str:
    """The type that reports show."""
    t = kind.get("Type")
    if t == "Int":
        return f"{'INT' if kind['isSigned'] else 'UINT'}{kind['bitWidth']}"
    if t == "Decimal":
        return f"DECIMAL({kind['precision']},{kind['scale']})"
    if t == "Timestamp":
        return f"TIMESTAMP_{UNITS[kind['timeUnit']]}"
    return SHOWN.get(t) or physical


NODE = re.compile(r"^(\s*)(required|optional|repeated) (\S+) (?:field_id=-?\d+ )?(.+?)(?: \(([^()]*(?:\([^)]*\))?[^()]*)\))?( \{|;)$")


def tree(schema) -> dict:
    """The schema's nodes: name, repetition, physical_type (None for groups), logical_type, children."""
    root = {"name": "schema", "repetition": "required", "physical_type": None, "logical_type": None, "children": []}
    stack = [root]
    for line in str(schema).splitlines():
        if line.strip() == "}":
            stack.pop()
            continue
        m = NODE.match(line)
        if not m or (len(stack) == 1 and m[3] == "group" and not m[1]):
            continue
        node = {"name": m[4], "repetition": m[2], "physical_type": None if m[3] == "group" else m[3].upper(), "logical_type": m[5], "children": []}
        stack[-1]["children"].append(node)
        if m[6] == " {":
            stack.append(node)
    return root


def leaves(node: dict, path: str = "", index: str = "", nullable: bool = False) -> Iterator[tuple[str, str, str, bool]]:
    """(path, index, repetition, nullable) of each leaf; a leaf below an optional or repeated group can be missing."""
    for k, child in enumerate(node["children"]):
        p, i = (f"{path}.{child['name']}" if path else child["name"]), (f"{index}.{k}" if index else str(k))
        n = nullable or child["repetition"] != "required"
        if child["children"]:
            yield from leaves(child, p, i, n)
        else:
            yield p, i, child["repetition"], n


def _plain(v):
    """(int, float, text) of a statistic, two of them None."""
    import datetime
    import decimal

    if v is None:
        return None, None, None
    if isinstance(v, bool):
        return int(v), None, None
    if isinstance(v, int):
        return v, None, None
    if isinstance(v, float):
        return None, (None if v != v else v), None
    if isinstance(v, decimal.Decimal):
        return None, float(v), None
    if isinstance(v, (datetime.datetime, datetime.date, datetime.time)):
        return None, None, v.isoformat(sep=" ") if isinstance(v, datetime.datetime) else v.isoformat()
    return None, None, v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


def rows(level: str, name: str, path: str) -> Iterator[tuple]:
    import pyarrow.parquet as pq

    width = SCHEMAS[level].count(", ") + 1
    try:
        f, size = open_file(path)
        with f:
            pf = pq.ParquetFile(f)
            m, schema = pf.metadata, pf.schema
            if level == "files":
                kv = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in (m.metadata or {}).items()}
                version = {"1.0": "v1"}.get(m.format_version, "v2")
                yield name, size, m.num_rows, m.num_row_groups, m.num_columns, m.created_by, version, m.serialized_size, kv, None
                return
            kinds = [logical(schema.column(i)) for i in range(m.num_columns)]
            if level == "columns":
                for i, (p, index, repetition, nullable) in enumerate(leaves(tree(schema))):
                    c = schema.column(i)
                    enc = list(m.row_group(0).column(i).encodings) if m.num_row_groups else []
                    yield name, i, index, c.path, c.name, c.path.split(".")[0], c.physical_type, logical_text(kinds[i]), (None if c.converted_type == "NONE" else c.converted_type), type_name(c.physical_type, kinds[i]), repetition, nullable, c.max_definition_level, c.max_repetition_level, enc, None
                return
            for g in range(m.num_row_groups):
                rg = m.row_group(g)
                for i in range(m.num_columns):
                    c, s = rg.column(i), None
                    s = c.statistics if c.is_stats_set else None
                    lo, hi = (_stat(s, "min"), _stat(s, "max")) if s is not None and s.has_min_max else ((None,) * 3,) * 2
                    yield (
                        name, g, rg.num_rows, i, c.path_in_schema, c.physical_type, type_name(c.physical_type, kinds[i]), c.compression, list(c.encodings), c.has_dictionary_page, c.dictionary_page_offset,
                        c.data_page_offset, c.total_compressed_size, c.total_uncompressed_size, c.num_values, s is not None, s.null_count if s is not None and s.has_null_count else None,
                        s.distinct_count if s is not None and s.has_distinct_count else None, lo[0], hi[0], lo[1], hi[1], lo[2], hi[2], None,
                    )
    except Exception as e:  # a broken file is a result, not a failure of the job
        yield (name, *[None] * (width - 2), f"{type(e).__name__}: {e}"[:500])


def _stat(s, which: str):
    try:
        return _plain(getattr(s, which))
    except Exception:  # a type that can't be shown decoded
        return _plain(getattr(s, which + "_raw", None))


class Files(InputPartition):
    def __init__(self, files):
        self.files = files


class FooterReader(DataSourceReader):
    def __init__(self, options):
        self.level, self.files = options.get("level", "chunks"), json.loads(options["files"])
        self.per_task = int(options.get("files_per_task", FILES_PER_TASK))

    def partitions(self):
        return [Files(self.files[i : i + self.per_task]) for i in range(0, len(self.files), self.per_task)] or [Files([])]

    def read(self, partition):
        for name, path in partition.files:
            yield from rows(self.level, name, path)


class FooterSource(DataSource):
    """Options: files (JSON list of [name, path]), level (files, columns or chunks), files_per_task."""

    @classmethod
    def name(cls):
        return "parquet_footer"

    def schema(self):
        return SCHEMAS[self.options.get("level", "chunks")]

    def reader(self, schema):
        return FooterReader(self.options)


def footer(spark: SparkSession, sources: Sequence[Source], level: str) -> DataFrame:
    spark.dataSource.register(FooterSource)
    return spark.read.format("parquet_footer").option("level", level).option("files", json.dumps([[s.name, s.path] for s in sources])).load()


def signatures(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """file, signature: a digest of the leaf columns' paths and types; null for files that can't be read."""
    from pyspark.sql import functions as F

    cols = footer(spark, sources, "columns")
    leaf = F.concat_ws(" ", "path", "type")
    return cols.groupBy("file").agg(F.when(F.count("error") == 0, F.sha1(F.array_join(F.array_sort(F.collect_list(leaf)), "\n").cast("binary"))).alias("signature"))


def bloom_filters(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """file, row_group, path, bloom_offset, bloom_length (-1: none), which PyArrow does not tell; read through the JVM's footer reader."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for s in sources:
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(s.path), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        try:
            blocks = reader.getFooter().getBlocks()
            for g in range(blocks.size()):
                cols = blocks.get(g).getColumns()
                for i in range(cols.size()):
                    c = cols.get(i)
                    found.append((s.name, g, c.getPath().toDotString(), int(c.getBloomFilterOffset()), int(c.getBloomFilterLength())))
        finally:
            reader.close()
    return spark.createDataFrame(found, "file string, row_group int, path string, bloom_offset long, bloom_length long")


def footer_trees(sources: Sequence[Source]) -> list[dict]:
    import pyarrow.parquet as pq

    out = []
    for s in sources:
        f, _ = open_file(s.path)
        with f:
            out.append(tree(pq.ParquetFile(f).schema))
    return out


def arrow_schema(source: Source):
    import pyarrow.parquet as pq

    f, _ = open_file(source.path)
    with f:
        return pq.ParquetFile(f).schema_arrow

"""Readers and writers: Parquet with all writer options, CSV, TSV, JSON lines, JSON arrays, Arrow files."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..errors import UsageError
from .resolve import spark_path

# fixed values: codec names, and Spark's for them
CODECS = {"none": "none", "uncompressed": "none", "snappy": "snappy", "gzip": "gzip", "zstd": "zstd", "lz4": "lz4_raw", "brotli": "brotli"}
LEVELS = {"gzip": range(10), "brotli": range(12), "zstd": range(1, 23)}
# fixed values: Hadoop's names of zlib's levels
ZLIB = ["NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION"]
FORMATS = {"csv": "csv", "tsv": "tsv", "json": "jsonl", "jsonl": "jsonl", "ndjson": "jsonl", "arrow": "arrow", "ipc": "arrow", "feather": "arrow", "parquet": "parquet", "parq": "parquet", "pq": "parquet"}


def codec(name: str) -> str:
    if name.lower() not in CODECS:
        raise UsageError(f"no such codec: {name}; there are {', '.join(CODECS)}")
    return CODECS[name.lower()]


def kind_of(path: str) -> str:
    end = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if end not in FORMATS:
        raise UsageError(f"{path}: can't tell the format from the name")
    return FORMATS[end]


def parquet_options(compression: str = "zstd", level: int | None = None, row_group_rows: int | None = None, dictionary: bool | None = None, stats: bool = True, version: int | None = None) -> dict[str, str]:
    """Options of Spark's Parquet writer."""
    out = {"compression": codec(compression)}
    if level is not None:
        kind = codec(compression)
        if kind not in LEVELS or level not in LEVELS[kind]:
            raise UsageError(f"{compression} has no level {level}; there are {', '.join(f'{k} {min(v)} to {max(v)}' for k, v in LEVELS.items())}")
        out |= {"zstd": {"parquet.compression.codec.zstd.level": str(level)}, "gzip": {"zlib.compress.level": ZLIB[level]}, "brotli": {}}[kind]
    if row_group_rows is not None:
        out["parquet.block.row.count.limit"] = str(row_group_rows)
    if dictionary is not None:
        out["parquet.enable.dictionary"] = str(dictionary).lower()
    if not stats:
        out["parquet.column.statistics.enabled"] = "false"
    if version is not None:
        if version not in (1, 2):
            raise UsageError("the writer version is 1 or 2")
        out["parquet.writer.version"] = f"v{version}"
    return out


def opened(path: str):
    """PyArrow's file system for a path as Spark names it, and the path there."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(re.sub(r"^s3a://", "s3://", path))


class ArrowFileWriter(DataSourceArrowWriter):
    """Writes Arrow or Parquet files with PyArrow: brotli, key-value metadata. Each task writes under a name of its own, and commit gives the files of the tasks that won their final names."""

    def __init__(self, options, schema):
        self.path, self.kind = options["path"], options.get("kind", "arrow")
        self.level = int(options["level"]) if options.get("level") else None
        self.compression, self.rows = options.get("compression", "zstd"), options.get("row_group_rows")
        self.kv = json.loads(options.get("kv", "{}"))

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.ipc as ipc
        import pyarrow.parquet as pq

        store, folder = opened(self.path)
        store.create_dir(folder)
        tmp, out = f"{folder}/.{uuid.uuid4().hex}.tmp", None
        for b in iterator:
            if out is None:
                schema = b.schema.with_metadata({**(b.schema.metadata or {}), **{k: v for k, v in self.kv.items()}}) if self.kv else b.schema
                sink = store.open_output_stream(tmp)
                out = pq.ParquetWriter(sink, schema, compression=self.compression, compression_level=self.level) if self.kind == "parquet" else ipc.new_file(sink, schema)
            if self.kind == "parquet":
                out.write_table(pa.Table.from_batches([b]).replace_schema_metadata(out.schema.metadata), **({"row_group_size": int(self.rows)} if self.rows else {}))
            else:
                out.write_batch(b)
        if out is not None:
            out.close()
            sink.close()
        return Written(tmp if out is not None else "")

    def commit(self, messages):
        store, folder = opened(self.path)
        for k, m in enumerate(x for x in messages if x is not None and x.tmp):
            store.move(m.tmp, f"{folder}/part-{k:05d}.{self.kind}")

    def abort(self, messages):
        for m in messages:
            if m is not None and m.tmp:
                opened(self.path)[0].delete_file(m.tmp)


class Written(WriterCommitMessage):
    def __init__(self, tmp):
        self.tmp = tmp


class ArrowPart(InputPartition):
    def __init__(self, path):
        self.path = path


class ArrowReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])

    def partitions(self):
        return [ArrowPart(p) for p in self.paths]

    def read(self, partition) -> Iterator:
        import pyarrow.ipc as ipc

        store, path = opened(partition.path)
        with store.open_input_file(path) as f:
            reader = ipc.open_file(f)
            for k in range(reader.num_record_batches):
                yield reader.get_batch(k)


class ArrowFiles(DataSource):
    """Arrow IPC files; reading option paths (JSON list), writing options path, kind, compression, kv."""

    @classmethod
    def name(cls):
        return "arrow_files"

    def schema(self):
        import pyarrow.ipc as ipc
        from pyspark.sql.pandas.types import from_arrow_schema

        store, path = opened(json.loads(self.options["paths"])[0])
        with store.open_input_file(path) as f:
            return from_arrow_schema(ipc.open_file(f).schema)

    def reader(self, schema):
        return ArrowReader(self.options)

    def writer(self, schema, overwrite):
        return ArrowFileWriter(self.options, schema)


def read_arrow(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrow_files").option("paths", json.dumps(list(paths))).load()


def arrow_files(df: DataFrame, path: str, kind: str = "arrow", compression: str = "zstd", kv: dict[str, str] | None = None, row_group_rows: int | None = None, level: int | None = None) -> None:
    df.sparkSession.dataSource.register(ArrowFiles)
    w = df.write.format("arrow_files").mode("append").option("path", path).option("kind", kind).option("compression", compression).option("kv", json.dumps(kv or {}))
    if level is not None:
        w = w.option("level", str(level))
    if row_group_rows:
        w = w.option("row_group_rows", str(row_group_rows))
    w.save()


def schema_from(spark: SparkSession, path: str) -> T.StructType:
    """The schema of a Parquet file, or of a JSON file of fields: Spark's own, or Arrow's {"fields": [{"name", "data_type", "nullable"}]}."""
    if kind_of(path) == "parquet":
        return spark.read.parquet(path).schema
    with open(path) as f:
        spec = json.load(f)
    if spec.get("type") == "struct":
        return T.StructType.fromJson(spec)
    return T.StructType([T.StructField(f["name"], _arrow_type(f.get("data_type") or f.get("type")), f.get("nullable", True)) for f in spec["fields"]])


# fixed values: Arrow type names
ARROW = {"Boolean": "boolean", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)", "Float32": "float", "Float64": "double", "Utf8": "string", "LargeUtf8": "string", "Utf8View": "string", "Binary": "binary", "LargeBinary": "binary", "Date32": "date", "Date64": "date"}


def _arrow_type(t) -> T.DataType:
    if isinstance(t, str) and t in ARROW:
        return T._parse_datatype_string(ARROW[t]) if ARROW[t] != "decimal(20,0)" else T.DecimalType(20, 0)
    if isinstance(t, dict) and "Timestamp" in t:
        return T.TimestampType() if t["Timestamp"][1] else T.TimestampNTZType()
    if isinstance(t, dict) and ("Decimal128" in t or "Decimal256" in t):
        return T.DecimalType(*next(iter(t.values())))
    raise UsageError(f"unknown type in the schema: {t}")


#: Standard quoting: quotes in quoted fields are doubled, blanks count. An empty field is read as null, quoted or not.
CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read(spark: SparkSession, path: str, header: bool = True, delimiter: str | None = None, infer_rows: int = 1000, schema: str | None = None) -> DataFrame:
    """A CSV, TSV, JSON-lines, Arrow or Parquet file as rows. Types of text files come from a schema, or from the first infer_rows rows; a later value that does not fit is an error."""
    kind = kind_of(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "arrow":
        return read_arrow(spark, path)
    if kind == "jsonl":
        first = [] if schema else [r.value for r in spark.read.text(path).limit(infer_rows).collect()]  # the head of the file, for inference only
        given = schema_from(spark, schema) if schema else spark.read.json(spark.sparkContext.parallelize(first, 1)).schema
        return spark.read.schema(given).option("mode", "FAILFAST").json(path)
    sep = delimiter or ("\t" if kind == "tsv" else ",")
    # quoted fields may hold line breaks, so that a file is one task's; many files are many tasks'
    text = lambda: spark.read.options(**CSV).option("sep", sep)
    if schema:
        given = schema_from(spark, schema)
    else:
        raw = text().option("header", header).option("multiLine", "true").csv(path)
        head = [r.line for r in raw.limit(infer_rows).select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in raw.columns]), CSV | {"sep": sep}).alias("line")).collect()]
        kinds = [f.dataType for f in text().option("inferSchema", "true").csv(spark.sparkContext.parallelize(head, 1)).schema] if head else [T.StringType()] * len(raw.columns)
        given = T.StructType([T.StructField(c if header else f"column_{k + 1}", t) for k, (c, t) in enumerate(zip(raw.columns, kinds))])
    return text().schema(given).option("header", header).option("multiLine", "true").option("mode", "FAILFAST").csv(path)


def single_file(spark: SparkSession, folder: str, out: str) -> None:
    """Move the one part file of a written folder to the name asked for; the folder goes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    src = jvm.org.apache.hadoop.fs.Path(folder)
    fs = src.getFileSystem(conf)
    parts = [s.getPath() for s in fs.listStatus(src) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise UsageError(f"{len(parts)} part files instead of one")
    target = jvm.org.apache.hadoop.fs.Path(out)
    if fs.exists(target):
        fs.delete(target, True)
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    fs.rename(parts[0], target)
    fs.delete(src, True)


def write(df: DataFrame, out: str, kind: str | None = None, single: bool = True, header: bool = True, delimiter: str | None = None, kv: dict[str, str] | None = None, **parquet) -> None:
    """Write rows as one file named `out`, or as a folder of files of all tasks (single=False), which is the way for large data."""
    kind, spark, out = kind or kind_of(out), df.sparkSession, spark_path(out)
    folder = f"{out}.{uuid.uuid4().hex}.parts" if single else out
    one = df.coalesce(1) if single else df
    if kind == "parquet":
        if kv or codec(parquet.get("compression", "zstd")) == "brotli":
            arrow_files(one, folder, "parquet", codec(parquet.get("compression", "zstd")), kv, parquet.get("row_group_rows"), parquet.get("level"))
        else:
            one.write.options(**parquet_options(**parquet)).parquet(folder)
    elif kind in ("csv", "tsv"):
        one.write.options(**CSV).option("header", header).option("sep", delimiter or ("\t" if kind == "tsv" else ",")).csv(folder)
    elif kind == "jsonl":
        one.write.json(folder)
    elif kind == "arrow":
        arrow_files(one, folder)
    else:
        raise UsageError(f"can't write {kind}")
    if single:
        if kind in ("parquet", "arrow") and df.limit(1).isEmpty() and (kind == "arrow" or kv):  # such a writer makes no file of no rows
            _empty(df, folder, kind)
        single_file(spark, folder, out)


def _empty(df: DataFrame, folder: str, kind: str) -> None:
    import pyarrow as pa
    import pyarrow.ipc as ipc
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    store, path = opened(folder)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/part-00000.{kind}") as f:
        if kind == "parquet":
            pq.write_table(schema.empty_table(), f)
        else:
            with ipc.new_file(f, schema) as w:
                w.write_table(pa.Table.from_batches([], schema))


def write_text(spark: SparkSession, out: str, lines: Iterable[str]) -> None:
    """Lines as a file of any store that Spark can write, a line at a time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        for line in lines:
            stream.write(bytearray((line + "\n").encode()))
    finally:
        stream.close()


def json_array(df: DataFrame) -> Iterator[str]:
    """The text of a JSON array, a row at a time, without holding the rows."""
    yield "["
    for k, r in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
        yield (",\n  " if k else "\n  ") + r.j
    yield "\n]"

"""Structural checks of files and data contracts. Each gives rows file, name, passed, detail."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CheckFailed, UsageError
from ..functions.units import parse_duration, parse_size
from ..sources.footer import footer, signatures
from ..sources.resolve import Source

# fixed values: physical types that an encoding may stand for; encodings that aren't listed fit all
FITS = [
    ("DELTA_BINARY_PACKED", ["INT32", "INT64"]),
    ("DELTA_LENGTH_BYTE_ARRAY", ["BYTE_ARRAY"]),
    ("DELTA_BYTE_ARRAY", ["BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"]),
    ("BYTE_STREAM_SPLIT", ["FLOAT", "DOUBLE", "INT32", "INT64", "FIXED_LEN_BYTE_ARRAY"]),
]
KNOWN_CODECS = ["UNCOMPRESSED", "SNAPPY", "GZIP", "BROTLI", "LZ4", "LZ4_RAW", "ZSTD", "LZO"]


def _result(df: DataFrame, name: str, bad: Column, detail: Column) -> DataFrame:
    """One row per file: it passes unless a row of it is bad; detail tells of a bad one."""
    return df.groupBy("file").agg((~F.coalesce(F.bool_or(bad), F.lit(False))).alias("passed"), F.min(F.when(bad, detail)).alias("detail")).select("file", F.lit(name).alias("name"), "passed", "detail")


def structural(spark: SparkSession, sources: Sequence[Source], read_data: bool = False) -> DataFrame:
    """Checks of the footer; with read_data also that every value can be read and that there are as many rows as the footer says."""
    files, chunks = footer(spark, sources, "files"), footer(spark, sources, "chunks")
    fine = chunks.where("error is null")
    groups = fine.groupBy("file", "row_group").agg(F.count(F.lit(1)).alias("n"), F.max("rg_rows").alias("rows"))
    sums = files.join(groups.groupBy("file").agg(F.sum("rows").alias("s")), "file", "left")
    want = groups.join(files.select("file", "num_columns"), "file")
    fits = spark.createDataFrame(FITS, "encoding string, types array<string>")
    encodings = fine.select("file", "path", "physical_type", F.explode("encodings").alias("encoding")).join(F.broadcast(fits), "encoding", "left")  # a table of four rows
    start = F.when(F.coalesce("dictionary_page_offset", F.lit(0)) > 0, F.least("dictionary_page_offset", "data_page_offset")).otherwise(F.col("data_page_offset"))
    offsets = fine.where("num_values > 0").groupBy("file", "row_group", start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
    lo_hi = (F.col("min_int") > F.col("max_int")) | (F.col("min_num") > F.col("max_num"))
    where = lambda text: F.concat(F.lit(text), F.coalesce("path", F.lit("")), F.lit(" in row group "), F.col("row_group").cast("string"))
    out = [
        _result(files, "footer", F.col("error").isNotNull(), F.col("error")),
        _result(sums, "row counts", F.col("error").isNull() & (F.coalesce("s", F.lit(0)) != F.col("num_rows")), F.concat(F.lit("row groups have "), F.col("s").cast("string"), F.lit(" rows, the footer "), F.col("num_rows").cast("string"))),
        _result(want, "schema consistent", F.col("n") != F.col("num_columns"), F.concat(F.lit("columns missing in row group "), F.col("row_group").cast("string"))),
        _result(fine, "statistics", F.coalesce(lo_hi, F.lit(False)), where("min above max: ")),
        _result(fine, "codec", ~F.col("codec").isin(KNOWN_CODECS), where("unknown codec: ")),
        _result(encodings, "encodings", F.col("types").isNotNull() & ~F.array_contains("types", F.col("physical_type")), F.concat_ws(" ", "encoding", F.lit("does not fit"), "path")),
        _result(offsets, "page offsets", F.col("n") > 1, F.concat(F.lit("columns share an offset in row group "), F.col("row_group").cast("string"))),
    ]
    if read_data:
        out.append(_read(spark, sources, files))
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every


def _read(spark: SparkSession, sources: Sequence[Source], files: DataFrame) -> DataFrame:
    """Every value of every file read, files of one schema together; a damaged file has fewer rows than its footer says."""
    kinds: dict[str, list[str]] = {}
    paths = {s.name: s.path for s in sources}
    for r in signatures(spark, sources).where("signature is not null").collect():  # a row per file
        kinds.setdefault(r.signature, []).append(paths[r.file])
    seen = spark.createDataFrame([], "file string, seen long")
    for group in kinds.values():
        df = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(*group)
        each = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]
        name = F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file")
        got = df.select(name, F.xxhash64(*each).alias("h")).groupBy("file").agg(F.count(F.lit(1)).alias("seen"), F.bit_xor("h").alias("h"))
        seen = seen.unionByName(got.where("h is not null or seen >= 0").select("file", "seen"))
    told = files.join(seen, "file", "left")
    differs = F.col("error").isNotNull() | (F.coalesce("seen", F.lit(0)) != F.coalesce("num_rows", F.lit(0)))
    return _result(told, "read data", differs, F.coalesce("error", F.concat(F.coalesce("seen", F.lit(0)).cast("string"), F.lit(" rows read, the footer says "), F.col("num_rows").cast("string"))))


def load_contract(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def contract(spark: SparkSession, sources: Sequence[Source], rules: dict, read_data: bool = False, now: str | None = None) -> DataFrame:
    """The rules of a contract: [file] min_rows, max_size, compression; [columns.X] type, nullable, min, max, allowed; [freshness] column, max_age.

    Bounds come from footer statistics, whose absence fails a rule; with read_data bounds and allowed values are
    tested on all rows. `now` (a timestamp) stands for the present.
    """
    unknown = set(rules) - {"file", "columns", "freshness"}
    if unknown:
        raise UsageError(f"unknown part of the contract: {sorted(unknown)[0]}")
    files, cols, chunks = footer(spark, sources, "files"), footer(spark, sources, "columns"), footer(spark, sources, "chunks").where("error is null")
    out: list[DataFrame] = []
    f = rules.get("file", {})
    if "min_rows" in f:
        out.append(_result(files, "file.min_rows", F.coalesce("num_rows", F.lit(0)) < int(f["min_rows"]), F.concat("num_rows", F.lit(f" rows, at least {f['min_rows']} wanted"))))
    if "max_size" in f:
        most = parse_size(f["max_size"])
        out.append(_result(files, "file.max_size", F.coalesce("size_bytes", F.lit(0)) > most, F.concat("size_bytes", F.lit(f" bytes, at most {most} wanted"))))
    if "compression" in f:
        allowed = [c.upper() for c in ([f["compression"]] if isinstance(f["compression"], str) else f["compression"])]
        out.append(_result(chunks, "file.compression", ~F.upper("codec").isin(allowed), F.col("codec")))
    stats = chunks.groupBy("file", "path").agg(
        F.min(F.coalesce("min_num", F.col("min_int").cast("double"))).alias("lo"), F.max(F.coalesce("max_num", F.col("max_int").cast("double"))).alias("hi"),
        F.min("min_str").alias("lo_s"), F.max("max_str").alias("hi_s"), F.min(F.col("min_int").cast("string")).alias("lo_i"), F.max(F.col("max_int").cast("string")).alias("hi_i"),
    )
    names = spark.createDataFrame([(s.name,) for s in sources], "file string")
    for c, r in rules.get("columns", {}).items():
        mine = names.join(cols.where(F.col("path") == c), "file", "left")
        out.append(_result(mine, f"{c}.exists", F.col("path").isNull(), F.lit("no such column")))
        if "type" in r:
            want = str(r["type"]).upper()
            is_ = F.array_contains(F.transform(F.array("physical_type", F.coalesce("logical_type", F.lit("")), F.coalesce("converted_type", F.lit("")), "type"), lambda x: F.upper(x)), want)
            out.append(_result(mine, f"{c}.type", ~F.coalesce(is_, F.lit(False)), F.concat(F.coalesce("type", F.lit("missing")), F.lit(f", wanted {want}"))))
        if "nullable" in r:
            out.append(_result(mine, f"{c}.nullable", ~F.col("nullable").eqNullSafe(F.lit(bool(r["nullable"]))), F.concat(F.lit("nullable is "), F.coalesce(F.col("nullable").cast("string"), F.lit("unknown")))))
        if read_data and ({"min", "max", "allowed"} & set(r)):
            rows = _rows(spark, sources, c)
            v = F.col("v")
            if "min" in r:
                out.append(_result(rows, f"{c}.min", F.coalesce(v.cast("double") < float(r["min"]), F.lit(False)), v.cast("string")))
            if "max" in r:
                out.append(_result(rows, f"{c}.max", F.coalesce(v.cast("double") > float(r["max"]), F.lit(False)), v.cast("string")))
            if "allowed" in r:
                out.append(_result(rows, f"{c}.allowed", F.coalesce(~v.cast("string").isin([str(x) for x in r["allowed"]]), F.lit(False)), v.cast("string")))
            continue
        s = names.join(stats.where(F.col("path") == c), "file", "left")
        if "min" in r:
            out.append(_result(s, f"{c}.min", F.coalesce(F.col("lo") < float(r["min"]), F.lit(True)), F.concat(F.lit("min is "), F.coalesce(F.col("lo").cast("string"), F.lit("not in the footer")))))
        if "max" in r:
            out.append(_result(s, f"{c}.max", F.coalesce(F.col("hi") > float(r["max"]), F.lit(True)), F.concat(F.lit("max is "), F.coalesce(F.col("hi").cast("string"), F.lit("not in the footer")))))
        if "allowed" in r:
            lo, hi = F.coalesce("lo_s", "lo_i"), F.coalesce("hi_s", "hi_i")
            fine = lo.isin([str(x) for x in r["allowed"]]) & hi.isin([str(x) for x in r["allowed"]])
            out.append(_result(s, f"{c}.allowed", ~F.coalesce(fine, F.lit(False)), F.concat_ws(" to ", lo, hi)))
    if "freshness" in rules:
        c, age = rules["freshness"]["column"], parse_duration(rules["freshness"]["max_age"])
        latest = _latest(spark, sources, c)
        at = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
        old = F.unix_timestamp(at.cast("timestamp")) - F.unix_timestamp(F.col("v").cast("timestamp"))
        out.append(_result(latest, "freshness", F.coalesce(old > age, F.lit(True)), F.concat(F.lit("latest is "), F.coalesce(F.col("v").cast("string"), F.lit("missing")))))
    if not out:
        raise UsageError("the contract has no rules")
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every


def _rows(spark: SparkSession, sources: Sequence[Source], column: str) -> DataFrame:
    df = spark.read.parquet(*[s.path for s in sources])
    v = F.col(f"`{column}`") if column in df.columns else F.lit(None).cast("string")
    return df.select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file"), v.alias("v"))


def _latest(spark: SparkSession, sources: Sequence[Source], column: str) -> DataFrame:
    """The latest time per file. Spark answers the maximum from a column chunk's pages with the unit that the file states; integers count as seconds since 1970."""
    df = _rows(spark, sources, column)
    kind = dict(df.dtypes)["v"]
    v = F.timestamp_seconds("v") if kind in ("bigint", "int") else F.col("v").cast("timestamp")
    return df.groupBy("file").agg(F.max(v).alias("v"))


def require(results: DataFrame) -> None:
    """Raise unless every check passed."""
    failed = results.where("not passed").count()
    if failed:
        raise CheckFailed(f"{failed} checks failed")

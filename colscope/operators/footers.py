"""Reports from footers: count, stats, size, inspect, schema and their comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import UsageError
from ..functions.selectors import select_names
from ..sources.footer import bloom_filters, footer
from ..sources.resolve import Source


def count(spark: SparkSession, sources: Sequence[Source], total: bool = False) -> DataFrame:
    """Rows of each file, or of all, from footers alone."""
    files = footer(spark, sources, "files")
    if total:
        return files.agg(F.coalesce(F.sum("num_rows"), F.lit(0)).alias("total"))
    return files.select("file", F.col("num_rows").alias("rows"))


def _shown(n: Column, x: Column, s: Column) -> Column:
    text = F.coalesce(n.cast("string"), F.when(x.isNotNull(), F.format_string("%.4f", x)), s)
    return F.when(F.length(text) > 40, F.concat(F.substring(text, 1, 37), F.lit("..."))).otherwise(text)


def _percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.when(whole > 0, part * 100.0 / whole), digits)


def _chosen(chunks: DataFrame, columns: str | None) -> DataFrame:
    if not columns:
        return chunks
    names = [r.path for r in chunks.groupBy("path").agg(F.min("ordinal").alias("o")).orderBy("o").collect()]
    tops = list(dict.fromkeys(n.split(".")[0] for n in names))
    keep = set(select_names(columns, names)) | set(select_names(columns, tops))
    return chunks.where(F.col("path").isin(list(keep)) | F.substring_index("path", ".", 1).isin(list(keep)))


STAT_ORDERS = {"name": [F.asc, "name"], "nulls": [F.desc, "null_percent"], "size": [F.desc, "compressed_bytes"], "ratio": [F.desc, "ratio"], "distinct": [F.desc, "distinct_count"]}


def stats(spark: SparkSession, sources: Sequence[Source], columns: str | None = None, sort: str | None = None) -> DataFrame:
    """A row per file and leaf column: null_percent, min, max (compared as the type orders them), distinct_count (sum over row groups, null where the writer left it out), bytes. Where a chunk has no statistics, null_percent is null."""
    chunks = _chosen(footer(spark, sources, "chunks"), columns)
    out = chunks.groupBy("file", F.col("path").alias("name"), "type").agg(
        F.min("ordinal").alias("_o"),
        _percent(F.when(F.count("null_count") == F.count(F.lit(1)), F.sum("null_count")), F.sum("rg_rows"), 1).alias("null_percent"),
        _shown(F.min("min_int"), F.min("min_num"), F.min("min_str")).alias("min"),
        _shown(F.max("max_int"), F.max("max_num"), F.max("max_str")).alias("max"),
        F.sum("distinct_count").alias("distinct_count"),
        F.sum("compressed_bytes").alias("compressed_bytes"),
        F.sum("uncompressed_bytes").alias("uncompressed_bytes"),
    )
    out = out.withColumn("ratio", F.round(F.col("uncompressed_bytes") / F.col("compressed_bytes"), 2))
    if sort:
        if sort not in STAT_ORDERS:
            raise UsageError(f"can't sort by {sort}: {', '.join(STAT_ORDERS)}")
        way, by = STAT_ORDERS[sort]
        return out.orderBy("file", way(by), "_o").drop("_o", "ratio")
    return out.orderBy("file", "_o").drop("_o", "ratio")


def scanned_stats(df: DataFrame) -> DataFrame:
    """The same from the rows themselves in one pass: name, null_percent, min, max, distinct_count (approximate)."""
    n = F.count(F.lit(1))
    each = [F.struct(F.lit(c).alias("name"), F.round(F.count_if(F.col(f"`{c}`").isNull()) * 100.0 / n, 1).alias("null_percent"), F.min(f"`{c}`").cast("string").alias("min"), F.max(f"`{c}`").cast("string").alias("max"), F.approx_count_distinct(f"`{c}`").alias("distinct_count")) for c, t in df.dtypes if not t.startswith("map")]
    return df.agg(F.array(*each).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def row_group_stats(spark: SparkSession, sources: Sequence[Source], columns: str | None = None) -> DataFrame:
    chunks = _chosen(footer(spark, sources, "chunks"), columns)
    return chunks.select(
        "file", "row_group", F.col("path").alias("name"), F.col("rg_rows").alias("rows"), _percent(F.col("null_count"), F.col("rg_rows"), 1).alias("null_percent"),
        _shown(F.col("min_int"), F.col("min_num"), F.col("min_str")).alias("min"), _shown(F.col("max_int"), F.col("max_num"), F.col("max_str")).alias("max"), "compressed_bytes", "uncompressed_bytes",
    )


def page_stats(spark: SparkSession, sources: Sequence[Source], columns: str | None = None) -> DataFrame:
    chunks = _chosen(footer(spark, sources, "chunks"), columns)
    return chunks.select("file", F.col("path").alias("column"), "row_group", F.col("has_dictionary_page").alias("dictionary_page"), "data_page_offset", F.col("compressed_bytes").alias("compressed_size"))


def bloom_stats(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    b = bloom_filters(spark, sources)
    has = F.bool_or(F.col("bloom_offset") >= 0)
    return b.groupBy("file", F.col("path").alias("column")).agg(has.alias("has_bloom_filter"), F.when(has, F.sum(F.greatest(F.col("bloom_length"), F.lit(0)))).alias("bloom_filter_size")).orderBy("file", "column")


SIZE_ORDERS = {"name": [F.asc, "name"], "compressed": [F.desc, "compressed_bytes"], "uncompressed": [F.desc, "uncompressed_bytes"], "ratio": [F.desc, "ratio"], "percent": [F.desc, "percent"]}


def column_sizes(spark: SparkSession, sources: Sequence[Source], sort: str | None = None, top: int | None = None) -> DataFrame:
    """file, name, compressed_bytes, uncompressed_bytes, ratio, percent of the file's data. With `top` the largest, which is a top-k plan."""
    if sort and sort not in SIZE_ORDERS:
        raise UsageError(f"can't sort by {sort}: {', '.join(SIZE_ORDERS)}")
    by = footer(spark, sources, "chunks").where("error is null").groupBy("file", F.col("path").alias("name")).agg(F.min("ordinal").alias("_o"), F.sum("compressed_bytes").alias("compressed_bytes"), F.sum("uncompressed_bytes").alias("uncompressed_bytes"))
    whole = F.sum("compressed_bytes").over(Window.partitionBy("file"))
    ratio = F.round(F.when(F.col("compressed_bytes") > 0, F.col("uncompressed_bytes") / F.col("compressed_bytes")), 2)
    out = by.withColumns({"ratio": ratio, "percent": _percent(F.col("compressed_bytes"), whole, 1)})
    if top is not None:
        sort = sort or "compressed"
        way, col = SIZE_ORDERS[sort]
        place = F.row_number().over(Window.partitionBy("file").orderBy(way(col), "_o"))
        return out.withColumn("_p", place).where(F.col("_p") <= top).orderBy("file", "_p").drop("_p", "_o")
    way, col = SIZE_ORDERS[sort] if sort else (F.asc, "_o")
    return out.orderBy("file", way(col), "_o").drop("_o")


def size_totals(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """file, data_compressed_bytes, data_uncompressed_bytes, footer_bytes (all that is no data), file_size_bytes."""
    data = footer(spark, sources, "chunks").groupBy("file").agg(F.sum("compressed_bytes").alias("data_compressed_bytes"), F.sum("uncompressed_bytes").alias("data_uncompressed_bytes"))
    files = footer(spark, sources, "files").select("file", F.col("size_bytes").alias("file_size_bytes"))
    out = files.join(data, "file", "left").fillna(0, ["data_compressed_bytes", "data_uncompressed_bytes"])
    return out.select("file", "data_compressed_bytes", "data_uncompressed_bytes", (F.col("file_size_bytes") - F.col("data_compressed_bytes")).alias("footer_bytes"), "file_size_bytes")


def dominant_codec(chunks: DataFrame) -> DataFrame:
    """file, compression: the codec of most chunks; of equally frequent ones the first by name."""
    n = chunks.groupBy("file", "codec").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("file").agg(F.min_by("codec", F.struct((-F.col("n")).alias("n"), "codec")).alias("compression"))


def inspect(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """A row per file: sizes, compression and its ratio, rows, columns, row groups, average rows of a group, writer, format version, encryption, metadata."""
    chunks = footer(spark, sources, "chunks").where("error is null").select("file", "codec", "uncompressed_bytes", "compressed_bytes")
    sums = chunks.groupBy("file").agg(F.sum("uncompressed_bytes").alias("uncompressed_bytes"), F.sum("compressed_bytes").alias("_c"))
    out = footer(spark, sources, "files").join(sums, "file", "left").join(dominant_codec(chunks), "file", "left")
    ratio = F.round(F.when(F.col("_c") > 0, F.col("uncompressed_bytes") / F.col("_c")), 2)
    return out.select(
        "file", "size_bytes", F.coalesce("uncompressed_bytes", F.lit(0)).alias("uncompressed_bytes"), "compression", ratio.alias("compression_ratio"), "num_rows", "num_columns", "num_row_groups",
        F.round(F.col("num_rows") / F.greatest("num_row_groups", F.lit(1)), 1).alias("avg_rows_per_group"), "created_by", "format_version", F.lit("none").alias("encryption"), F.col("kv").alias("key_value_metadata"), "error",
    )


def inspect_all(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """inspect() with `schema_differs`: the file's column names or types are not those of the first file."""
    cols = footer(spark, sources, "columns").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ordinal", "path", "type"))).alias("_s"))
    first = cols.agg(F.min_by("_s", "file").alias("_first"))
    return inspect(spark, sources).join(cols, "file", "left").crossJoin(F.broadcast(first)).withColumn("schema_differs", ~F.col("_s").eqNullSafe(F.col("_first"))).drop("_s", "_first")  # the right side is one row


def schema_columns(spark: SparkSession, sources: Sequence[Source], sort: str | None = None) -> DataFrame:
    out = footer(spark, sources, "columns").where("error is null").withColumn("encoding", F.array_join("encodings", ", "))
    orders = {None: ["ordinal"], "name": ["name", "ordinal"], "type": ["type", "ordinal"], "encoding": ["encoding", "ordinal"]}
    if sort not in orders:
        raise UsageError(f"can't sort by {sort}: name, type, encoding")
    return out.select("file", "index", F.col("path").alias("name"), "physical_type", "logical_type", "type", "repetition", "nullable", "max_def_level", "max_rep_level", "encoding", "ordinal").orderBy("file", *orders[sort]).drop("ordinal")


def schema_diff(spark: SparkSession, a: Source, b: Source, changes_only: bool = False) -> DataFrame:
    """column, file_a, file_b, status: same, type changed, nullability changed, removed, added; a's columns first, then b's new ones."""
    def side(s: Source, x: str) -> DataFrame:
        c = footer(spark, [s], "columns")
        shown = F.concat(F.col("type"), F.when(F.col("nullable"), "").otherwise(" NOT NULL"))
        return c.select(F.col("path").alias("column"), F.col("ordinal").alias(f"o_{x}"), F.col("type").alias(f"t_{x}"), F.col("nullable").alias(f"n_{x}"), shown.alias(f"file_{x}"))

    j = side(a, "a").join(side(b, "b"), "column", "full_outer")
    status = F.when(F.col("t_b").isNull(), "removed").when(F.col("t_a").isNull(), "added").when(F.col("t_a") != F.col("t_b"), "type changed").when(F.col("n_a") != F.col("n_b"), "nullability changed").otherwise("same")
    out = j.withColumn("status", status).orderBy(F.col("o_a").asc_nulls_last(), "o_b").select("column", "file_a", "file_b", "status")
    return out.where("status <> 'same'") if changes_only else out


def schema_diff_many(spark: SparkSession, sources: Sequence[Source], ref: str | None = None) -> DataFrame:
    """Each file against the reference (the first, or the one named): file, added, removed, changed, verdict."""
    base = next((s for s in sources if ref and (s.name == ref or s.name.endswith("/" + ref))), None if ref else sources[0])
    if base is None:
        raise UsageError(f"{ref} is not among the inputs")
    cols = footer(spark, sources, "columns").select("file", "path", "type", "nullable")
    mine = cols.where(F.col("file") == base.name).select("path", F.col("type").alias("t"), F.col("nullable").alias("n"))
    others = spark.createDataFrame([(s.name,) for s in sources if s.name != base.name], "file string")
    want = others.crossJoin(mine)  # files times the columns of one schema
    j = want.join(cols.where(F.col("file") != base.name), ["file", "path"], "full_outer")
    gone, new = F.col("type").isNull(), F.col("t").isNull()
    other = (F.col("type") != F.col("t")) | (F.col("nullable") != F.col("n"))
    out = j.groupBy("file").agg(F.count_if(new).alias("added"), F.count_if(gone).alias("removed"), F.count_if(other).alias("changed"))
    return out.withColumn("verdict", F.when(F.col("added") + F.col("removed") + F.col("changed") == 0, "identical").otherwise("differs")).orderBy("file")


def metadata_diff(spark: SparkSession, a: Source, b: Source) -> DataFrame:
    """One row: rows, size, row groups and codec of both files."""
    def side(s: Source, x: str) -> DataFrame:
        i = inspect(spark, [s])
        return i.select(F.col("num_rows").alias(f"rows_{x}"), F.col("size_bytes").alias(f"size_{x}"), F.col("num_row_groups").alias(f"row_groups_{x}"), F.col("compression").alias(f"compression_{x}"))

    return side(a, "a").crossJoin(side(b, "b"))  # one row by one row

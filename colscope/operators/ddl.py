"""CREATE TABLE statements in eight dialects from a footer's schema."""

from __future__ import annotations

import json

from ..errors import UsageError
from ..sources.footer import logical, open_file, tree
from ..sources.resolve import Source, is_identifier, table_name

ALIASES = {"ch": "clickhouse", "postgresql": "postgres", "pg": "postgres", "bq": "bigquery", "sf": "snowflake", "rs": "redshift"}
DIALECTS = ["duckdb", "spark", "clickhouse", "postgres", "bigquery", "snowflake", "redshift", "mysql"]

# fixed values: a line per Parquet type, a name per dialect in the order above; None falls back to the physical type
TYPES = {
    "String": ("VARCHAR", "StringType()", "String", "TEXT", "STRING", "VARCHAR", "VARCHAR(65535)", "TEXT"),
    "Int8": ("TINYINT", "ByteType()", "Int8", "SMALLINT", "INT64", "INTEGER", "SMALLINT", "TINYINT"),
    "Int16": ("SMALLINT", "ShortType()", "Int16", "SMALLINT", "INT64", "INTEGER", "SMALLINT", "SMALLINT"),
    "Int32": ("INTEGER", "IntegerType()", "Int32", "INTEGER", "INT64", "INTEGER", "INTEGER", "INT"),
    "Int64": ("BIGINT", "LongType()", "Int64", "BIGINT", "INT64", "BIGINT", "BIGINT", "BIGINT"),
    "UInt": ("BIGINT", "LongType()", "UInt{bits}", "BIGINT", "INT64", "BIGINT", "BIGINT", "BIGINT"),
    "Timestamp": ("TIMESTAMP", "TimestampType()", "DateTime64({digits})", "TIMESTAMP", "TIMESTAMP", "TIMESTAMP_NTZ", "TIMESTAMP", "DATETIME"),
    "Date": ("DATE", "DateType()", "Date32", "DATE", "DATE", "DATE", "DATE", "DATE"),
    "Time": ("TIME", None, "DateTime64(6)", "TIME", "TIME", "TIME", "VARCHAR(20)", "TIME"),
    "Decimal": ("DECIMAL({p}, {s})", "DecimalType({p}, {s})", "Decimal({p}, {s})", "NUMERIC({p}, {s})", "NUMERIC", "NUMBER({p}, {s})", "DECIMAL({p}, {s})", "DECIMAL({p}, {s})"),
    "UUID": ("UUID", None, "UUID", "UUID", "STRING", "VARCHAR", "VARCHAR(36)", "CHAR(36)"),
    "JSON": ("VARCHAR", "StringType()", "String", "JSONB", "JSON", "VARIANT", "VARCHAR(65535)", "JSON"),
    "BSON": ("BLOB", None, None, None, None, None, None, None),
    "Enum": ("VARCHAR", "StringType()", "String", None, None, None, None, None),
    "group": ("STRUCT", "StructType()", "Tuple()", "JSONB", "STRUCT", "OBJECT", "VARCHAR(65535)", "JSON"),
    "BOOLEAN": ("BOOLEAN", "BooleanType()", "Bool", "BOOLEAN", "BOOL", "BOOLEAN", "BOOLEAN", "TINYINT(1)"),
    "INT32": ("INTEGER", "IntegerType()", "Int32", "INTEGER", "INT64", "INTEGER", "INTEGER", "INT"),
    "INT64": ("BIGINT", "LongType()", "Int64", "BIGINT", "INT64", "BIGINT", "BIGINT", "BIGINT"),
    "INT96": ("TIMESTAMP", "TimestampType()", "DateTime64(9)", "TIMESTAMP", "TIMESTAMP", "TIMESTAMP_NTZ", "TIMESTAMP", "DATETIME"),
    "FLOAT": ("FLOAT", "FloatType()", "Float32", "REAL", "FLOAT64", "FLOAT", "REAL", "FLOAT"),
    "DOUBLE": ("DOUBLE", "DoubleType()", "Float64", "DOUBLE PRECISION", "FLOAT64", "DOUBLE", "DOUBLE PRECISION", "DOUBLE"),
    "BYTE_ARRAY": ("BLOB", "BinaryType()", "String", "BYTEA", "BYTES", "BINARY", "VARCHAR(65535)", "BLOB"),
    "FIXED_LEN_BYTE_ARRAY": ("BLOB", "BinaryType()", "FixedString({width})", "BYTEA", "BYTES", "BINARY", "VARCHAR(65535)", "BLOB"),
}
DIGITS = {"milliseconds": 3, "microseconds": 6, "nanoseconds": 9}


def _type(dialect: str, physical: str, kind: dict, width: int) -> str:
    at, t = DIALECTS.index(dialect), kind.get("Type")
    key = (f"Int{kind['bitWidth']}" if kind["isSigned"] else "UInt") if t == "Int" else t
    name = TYPES[key][at] if key in TYPES else None
    if name is None:
        name = TYPES[physical][at]
    return name.format(bits=kind.get("bitWidth"), digits=DIGITS.get(kind.get("timeUnit"), 6), p=kind.get("precision"), s=kind.get("scale"), width=width)


def quoted(dialect: str, name: str) -> str:
    if is_identifier(name):
        return name
    mark = "`" if dialect in ("bigquery", "mysql", "clickhouse") else '"'
    return mark + name.replace(mark, mark * 2) + mark


def ddl(source: Source, dialect: str) -> str:
    """The statement for a file's top-level columns; groups (lists, maps, structs) count as one column with their own nullability."""
    import pyarrow.parquet as pq

    dialect = ALIASES.get(dialect.lower(), dialect.lower())
    if dialect not in DIALECTS:
        raise UsageError(f"no such dialect: {dialect}; there are {', '.join(DIALECTS)}")
    f, _ = open_file(source.path)
    with f:
        schema = pq.ParquetFile(f).schema
    by_path = {schema.column(i).path: schema.column(i) for i in range(len(schema.names))}
    columns = []
    for node in tree(schema)["children"]:
        nullable = node["repetition"] != "required"
        if node["children"]:
            columns.append((node["name"], TYPES["group"][DIALECTS.index(dialect)], nullable))
        else:
            c = by_path[node["name"]]
            columns.append((node["name"], _type(dialect, c.physical_type, logical(c), max(0, c.length or 0)), nullable))
    name = table_name(source.name)
    if dialect == "spark":
        lines = [f"    StructField({json.dumps(n)}, {t}, {nullable})" for n, t, nullable in columns]
        return f"{name} = StructType([\n" + ",\n".join(lines) + "\n])"
    if dialect == "clickhouse":
        lines = [f"    {quoted(dialect, n)} {f'Nullable({t})' if nullable and t != 'Tuple()' else t}" for n, t, nullable in columns]
        end = ") ENGINE = MergeTree()\nORDER BY tuple();"
    else:
        lines = [f"    {quoted(dialect, n)} {t}{'' if nullable else ' NOT NULL'}" for n, t, nullable in columns]
        end = ") ENGINE=InnoDB;" if dialect == "mysql" else ");"
    return f"CREATE TABLE {quoted(dialect, name)} (\n" + ",\n".join(lines) + "\n" + end

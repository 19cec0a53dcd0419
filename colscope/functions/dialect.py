"""Functions that SQL engines name differently, over Spark's built-ins."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: SQL functions of every query: name, parameters, type, body. They are plain SQL, so that plans stay in generated code.
FUNCTIONS = [
    ("date_bin", "width INTERVAL DAY TO SECOND, t TIMESTAMP", "TIMESTAMP", "timestamp_micros(unix_micros(t) - pmod(unix_micros(t), unix_micros(timestamp_micros(0) + width)))"),
    ("date_bin_seconds", "width BIGINT, t TIMESTAMP", "TIMESTAMP", "timestamp_seconds(unix_seconds(t) - pmod(unix_seconds(t), width))"),
    ("strpos", "s STRING, part STRING", "INT", "locate(part, s)"),
    ("regexp_match", "s STRING, rule STRING", "ARRAY<STRING>", "CASE WHEN s RLIKE rule THEN array(regexp_extract(s, rule, CASE WHEN contains(rule, '(') THEN 1 ELSE 0 END)) END"),
    ("regexp_replace_first", "s STRING, rule STRING, by_ STRING", "STRING", "CASE WHEN regexp_instr(s, rule) = 0 THEN s ELSE concat(substr(s, 1, regexp_instr(s, rule) - 1), regexp_replace(regexp_substr(s, rule), rule, by_), substr(s, regexp_instr(s, rule) + length(regexp_substr(s, rule)))) END"),
    ("trunc_to", "x DOUBLE, n INT", "DOUBLE", "CASE WHEN x < 0 THEN ceil(x * pow(10, n)) ELSE floor(x * pow(10, n)) END / pow(10, n)"),
    ("int_div", "a BIGINT, b BIGINT", "BIGINT", "a div b"),
]


def register(spark: SparkSession) -> None:
    """The functions above as temporary SQL functions of the session, once."""
    if getattr(spark, "_colscope_functions", False):
        return
    for name, params, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    spark._colscope_functions = True


def date_bin(width_seconds: int, t: Column, origin: str = "1970-01-01") -> Column:
    """The start of the bin of that width, counted from origin, for a timestamp_ntz or timestamp."""
    start = F.unix_micros(F.to_timestamp(F.lit(origin)))
    at = F.unix_micros(t.cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at - start, F.lit(width_seconds * 1_000_000)))


def shortened(c: Column, width: int) -> Column:
    """Text of at most `width` characters; longer ones end in three dots."""
    s = c.cast("string")
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, max(0, width - 3)), F.lit("..."))).otherwise(s)

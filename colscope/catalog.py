"""The queries that show each operator at work, and DuckDB SQL for their rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dialect, selectors
from .operators import check, combine, ddl, footers, reshape, rows
from .plans import sql
from .session import apply_defaults
from .sources import sinks
from .sources.resolve import Source, resolve

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
#: Oracles of row places and footers name the files of the scale factor that results are compared at.
AT = "/root/testdata/sf0.01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose text both engines take, unless the oracle is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        return sql.query(spark, text, [f"{sf_dir}/{t}.parquet" for t in used])

    QUERIES[name], ORACLES[name] = run, oracle or text


def _query(name: str, oracle: str | None = None):
    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_defaults(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _src(spark: SparkSession, sf_dir: str, *names: str) -> list[Source]:
    return resolve(spark, [f"{sf_dir}/{n}.parquet" for n in names], keep_order=True)


def _base(c: str = "file") -> F.Column:
    return F.regexp_extract(c, r"([^/]+)\.parquet$", 1)


def _table(c: str = "file") -> F.Column:
    """The table whose file this is; a table may be a folder of files."""
    return F.regexp_extract(c, rf"/({'|'.join(TABLES)})\.parquet(?:/.*)?$", 1)


# A: scans and aggregates in SQL
_sql("sql_select_filter_order", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice BETWEEN 1000 AND 400000 ORDER BY o_orderkey")
_sql("sql_group_avg_topk", "SELECT o_orderpriority, CAST(ROUND(AVG(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS avg_price, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY avg_price DESC, o_orderpriority LIMIT 5",
     "SELECT o_orderpriority, CAST(ROUND(SUM(CAST(o_totalprice AS DECIMAL(18,2))) / COUNT(*), 2) AS DOUBLE) AS avg_price, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY avg_price DESC, o_orderpriority LIMIT 5")
_PRICING = """SELECT l_returnflag, l_linestatus, CAST(SUM(l_quantity) AS BIGINT) AS sum_qty, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents,
 CAST(SUM(CAST(ROUND(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS sum_disc_cents, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP{} '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""
_sql("sql_pricing_summary", _PRICING.format("_NTZ"), _PRICING.format(""))
_sql("sql_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
_sql("sql_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_sql("sql_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag")
_sql("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, CAST(GROUPING(o_orderstatus) AS BIGINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
_sql("sql_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("sql_rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("sql_agg_filter", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, CAST(SUM(o_custkey) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT) AS s FROM orders GROUP BY o_orderpriority")
_sql("sql_stat_aggs", "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(CORR(l_quantity, l_tax), 6) AS c, ROUND(COVAR_POP(l_quantity, l_discount), 6) AS cov, ROUND(REGR_SLOPE(l_quantity, l_discount), 6) AS slope, MEDIAN(l_quantity) AS med FROM lineitem GROUP BY l_returnflag")
_sql("sql_bool_bit_aggs", "SELECT o_orderpriority, BOOL_AND(o_totalprice > 0) AS a, BOOL_OR(o_totalprice > 400000) AS o, BIT_XOR(o_orderkey) AS x, MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi FROM orders GROUP BY o_orderpriority")
_sql("sql_string_agg", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_sql("sql_first_last_by", "SELECT user_id, min_by(event_type, struct(ts, event_id)) AS first_type, max_by(event_type, struct(ts, event_id)) AS last_type FROM events GROUP BY user_id", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
_sql("sql_exact_percentile", "SELECT l_returnflag, percentile(l_quantity, 0.25) AS p25, percentile(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
_sql("sql_approx_distinct", "SELECT approx_count_distinct(l_partkey) AS parts, percentile_approx(l_quantity, 0.5) AS med FROM lineitem")
del ORACLES["sql_approx_distinct"]

# B: joins, subqueries, set operations
_sql("sql_join_inner", "SELECT r_name, n_name, COUNT(*) AS n, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
_sql("sql_join_left", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
_sql("sql_join_right", "SELECT n_nationkey, COUNT(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_nationkey")
_sql("sql_join_full", "SELECT c.k AS ck, s.k AS sk, c.n AS cn, s.n AS sn FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier WHERE s_acctbal < 2000 GROUP BY 1) s ON c.k = s.k")
_sql("sql_join_cross", "SELECT r_name, p.k AS k FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority AS k FROM orders) p")
_sql("sql_join_using", "SELECT doc_id, toxic, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
_sql("sql_join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
# Spark plans NOT IN under OR as a nested loop; spelled out, with its rules for nulls and for an empty list, it is a join by key
_sql("sql_join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders) OR (c_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey IS NULL) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
     "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_sql("sql_join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_name < b.n_name AND a.n_regionkey <> b.n_regionkey")
_sql("sql_join_natural", "SELECT doc_id, lang, toxic FROM documents NATURAL JOIN labels")
_sql("sql_correlated", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_sql("sql_lateral", "SELECT n_nationkey, x.n AS n FROM nation, LATERAL (SELECT COUNT(*) AS n FROM supplier WHERE s_nationkey = n_nationkey) x")
_sql("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("sql_union_all", "SELECT k, COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
_sql("sql_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
_sql("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
_sql("sql_recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 25) SELECT CAST(n AS INT) AS n, n_name FROM t JOIN nation ON n_nationkey = n - 1")
_sql("sql_subquery_scalar", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT AVG(s_acctbal) FROM supplier)")

# C: windows and functions
_sql("sql_window_rank", "SELECT event_id, ROW_NUMBER() OVER w AS rn, RANK() OVER v AS rk, DENSE_RANK() OVER v AS dr, ROUND(PERCENT_RANK() OVER w, 9) AS pr, ROUND(CUME_DIST() OVER w, 9) AS cd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY event_type)",
     "SELECT event_id, CAST(ROW_NUMBER() OVER w AS INT) AS rn, CAST(RANK() OVER v AS INT) AS rk, CAST(DENSE_RANK() OVER v AS INT) AS dr, ROUND(PERCENT_RANK() OVER w, 9) AS pr, ROUND(CUME_DIST() OVER w, 9) AS cd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY event_type)")
_sql("sql_window_lag_lead", "SELECT event_id, LAG(value) OVER w AS before, LEAD(event_type, 2) OVER w AS after2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
_sql("sql_window_running_sum", "SELECT event_id, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM events")
_sql("sql_window_ntile", "SELECT o_orderkey, CAST(NTILE(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS INT) AS q FROM orders")
_sql("sql_window_first_last", "SELECT event_id, FIRST_VALUE(event_type) OVER w AS f, LAST_VALUE(event_type) OVER w AS l, NTH_VALUE(event_id, 2) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_sql("sql_window_range_frame", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS n FROM orders")
_sql("sql_window_groups_rewrite", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, DENSE_RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS g FROM events)",
     "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events")
_sql("sql_qualify_rewrite", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
     "SELECT user_id, event_id FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
_sql("sql_datetime_fns", "SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS m, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(DOW FROM o_orderdate) AS BIGINT) - 1 AS dow, date_format(o_orderdate, 'yyyy-MM-dd') AS d, CAST(datediff(o_orderdate, DATE'1992-01-01') AS BIGINT) AS days, make_date(1999, 12, 31) AS fixed FROM orders",
     "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(DOW FROM o_orderdate) AS BIGINT) AS dow, strftime(o_orderdate, '%Y-%m-%d') AS d, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, make_date(1999, 12, 31) AS fixed FROM orders")
_sql("sql_regex_fns", r"SELECT p_partkey, regexp_like(p_name, '[aeiou]{2}') AS l, regexp_replace(p_name, '[aeiou]', '*') AS r, regexp_extract(p_type, '([A-Za-z]+)$', 1) AS e, CAST(regexp_count(p_name, '[aeiou]') AS BIGINT) AS c FROM part",
     r"SELECT p_partkey, regexp_matches(p_name, '[aeiou]{2}') AS l, regexp_replace(p_name, '[aeiou]', '*', 'g') AS r, regexp_extract(p_type, '([A-Za-z]+)$', 1) AS e, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT) AS c FROM part")
_sql("sql_string_fns", "SELECT p_partkey, upper(p_name) AS u, substr(p_name, 2, 3) AS s, lpad(CAST(p_size AS STRING), 5, '0') AS p, replace(p_brand, 'Brand', 'B') AS r, concat(p_brand, '-', p_type) AS c, starts_with(p_type, 'S') AS w, split_part(p_type, ' ', 1) AS f, CAST(length(p_name) AS BIGINT) AS n, reverse(p_brand) AS b FROM part".replace("starts_with", "startswith"),
     "SELECT p_partkey, upper(p_name) AS u, substr(p_name, 2, 3) AS s, lpad(CAST(p_size AS VARCHAR), 5, '0') AS p, replace(p_brand, 'Brand', 'B') AS r, concat(p_brand, '-', p_type) AS c, starts_with(p_type, 'S') AS w, split_part(p_type, ' ', 1) AS f, length(p_name) AS n, reverse(p_brand) AS b FROM part")
_sql("sql_math_fns", "SELECT p_partkey, ROUND(SQRT(p_retailprice), 6) AS q, CAST(FLOOR(p_retailprice) AS BIGINT) AS f, CAST(CEIL(p_retailprice) AS BIGINT) AS c, ABS(p_size - 25) AS a, ROUND(LN(p_retailprice), 6) AS l, ROUND(POWER(p_size, 2), 2) AS p, p_size % 7 AS m, CAST(SIGN(p_size - 25) AS INT) AS s FROM part")
_sql("sql_dialect_names", "SELECT event_id, CAST(date_bin(INTERVAL '15' MINUTE, CAST(ts AS TIMESTAMP)) AS TIMESTAMP_NTZ) AS bin, strpos(event_type, 'c') AS at, regexp_match(event_type, '([aeiou]+)')[0] AS m, date_part('hour', ts) AS h FROM events",
     "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS bin, CAST(strpos(event_type, 'c') AS INTEGER) AS at, nullif(regexp_extract(event_type, '([aeiou]+)', 1), '') AS m, CAST(date_part('hour', ts) AS INTEGER) AS h FROM events")
_sql("sql_conditional", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS c, COALESCE(NULLIF(o_orderstatus, 'F'), 'done') AS s, GREATEST(o_orderkey, o_custkey) AS g, LEAST(o_orderkey, o_custkey) AS l, o_orderstatus IN ('F', 'O') AS i, o_orderpriority LIKE '%URGENT%' AS u FROM orders")


@_query("sql_date_bin", "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS bin FROM events")
def _(spark, d):
    return _t(spark, d, "events").select("event_id", dialect.date_bin(900, F.col("ts")).cast("timestamp_ntz").alias("bin"))


@_query("sql_compat_functions", "SELECT p_partkey, CAST(strpos(p_type, 'S') AS INTEGER) AS at, regexp_replace(p_name, '[aeiou]', '_') AS first, trunc(p_retailprice * 10) / 10 AS t, p_partkey // 7 AS d FROM part")
def _(spark, d):
    return sql.query(spark, "SELECT p_partkey, strpos(p_type, 'S') AS at, regexp_replace_first(p_name, '[aeiou]', '_') AS first, trunc_to(p_retailprice, 1) AS t, int_div(p_partkey, 7) AS d FROM part", [f"{d}/part.parquet"])


@_query("sql_explain_analyze")
def _(spark, d):
    return sql.analyze(spark, "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", [f"{d}/orders.parquet"])


# D: rows by place, column selectors, splits
@_query("head_rows", f"SELECT * EXCLUDE (file_row_number) FROM read_parquet('{AT}/lineitem.parquet', file_row_number=true) WHERE file_row_number < 25")
def _(spark, d):
    return rows.head(spark, _src(spark, d, "lineitem"), 25)


@_query("tail_rows", f"SELECT * EXCLUDE (file_row_number) FROM read_parquet('{AT}/lineitem.parquet', file_row_number=true) WHERE file_row_number >= (SELECT count(*) FROM lineitem) - 25")
def _(spark, d):
    return rows.tail(spark, _src(spark, d, "lineitem"), 25)


@_query("slice_rows", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, file_row_number AS row FROM read_parquet('{AT}/lineitem.parquet', file_row_number=true) WHERE file_row_number BETWEEN 1000 AND 1999")
def _(spark, d):
    return rows.slice_rows(spark, _src(spark, d, "lineitem"), "1000:2000", columns="/key$/,l_linenumber", place=True).drop(rows.FILE).withColumnRenamed(rows.ROW, "row")


def _grouped(spark: SparkSession, d: str, table: str, size: int, by: str) -> list[Source]:
    """The table written as one file in order of a key, in row groups of `size` rows."""
    out = f"{_tmp(spark)}/{table}.parquet"
    sinks.write(_t(spark, d, table).repartition(1).sortWithinPartitions(by), out, "parquet", row_group_rows=size)
    return resolve(spark, [out])


_IN_ORDER = "(SELECT *, CAST((row_number() OVER (ORDER BY {by}) - 1) // {size} AS INTEGER) AS g FROM {t})"


@_query("slice_row_groups", f"SELECT c_custkey FROM {_IN_ORDER.format(by='c_custkey', size=400, t='customer')} WHERE g IN (1, 3)")
def _(spark, d):
    return rows.slice_rows(spark, _grouped(spark, d, "customer", 400, "c_custkey"), row_groups="1,3", columns="c_custkey")


@_query("prune_row_groups", f"SELECT o_orderkey FROM {_IN_ORDER.format(by='o_orderkey', size=1000, t='orders')} WHERE g IN (SELECT g FROM {_IN_ORDER.format(by='o_orderkey', size=1000, t='orders')} GROUP BY g HAVING max(o_orderkey) >= 2500)")
def _(spark, d):
    return rows.slice_rows(spark, _grouped(spark, d, "orders", 1000, "o_orderkey"), prune="o_orderkey >= 2500", columns="o_orderkey")


for _name, _pattern, _cols in [
    ("exact", "c_name,c_custkey", "c_custkey, c_name"), ("regex", "/^c_(na|acct)/", "c_name, c_nationkey, c_acctbal"), ("exclude", "!c_name,!c_acctbal", "c_custkey, c_nationkey, c_mktsegment"),
    ("index", "#0,#2-3", "c_custkey, c_nationkey, c_acctbal"), ("last_n", "#-2", "c_acctbal, c_mktsegment"),
]:

    @_query(f"select_{_name}", f"SELECT {_cols} FROM customer")
    def _(spark, d, pattern=_pattern):
        return selectors.select(_t(spark, d, "customer"), pattern)


@_query("display_truncated", "SELECT doc_id, CASE WHEN length(text) > 20 THEN substr(text, 1, 17) || '...' ELSE text END AS text FROM documents")
def _(spark, d):
    return rows.display(_t(spark, d, "documents").select("doc_id", "text"), 20)


@_query("sample_exact", "SELECT least(100, count(*)) AS n, least(100, count(*)) AS different, least(100, count(*)) AS there FROM orders")
def _(spark, d):
    """Which rows are drawn is by hash; their number, and that they are different rows of the table, are compared."""
    got = rows.sample(spark, _src(spark, d, "orders"), 100, seed=42)
    there = _t(spark, d, "orders").withColumn("there", F.lit(1))
    return got.join(there, got.columns, "left").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different"), F.count("there").alias("there"))


@_query("split_n_counts", f"SELECT CAST(file_row_number // ((SELECT count(*) FROM orders) + 6) // 7 AS INTEGER) AS part, 0 AS n FROM read_parquet('{AT}/orders.parquet', file_row_number=true) WHERE false UNION ALL SELECT CAST(file_row_number // (((SELECT count(*) FROM orders) + 6) // 7) AS INTEGER), count(*) FROM read_parquet('{AT}/orders.parquet', file_row_number=true) GROUP BY 1")
def _(spark, d):
    return rows.split_ids(spark, _src(spark, d, "orders"), 7).groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@_query("split_row_groups", f"SELECT g AS part, count(*) AS n FROM {_IN_ORDER.format(by='c_custkey', size=400, t='customer')} GROUP BY g")
def _(spark, d):
    return rows.split_row_groups(spark, _grouped(spark, d, "customer", 400, "c_custkey")).groupBy(F.col("_part").cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@_query("footer_nulls", "SELECT 'status' AS name, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 1)::DOUBLE AS null_percent FROM orders UNION ALL SELECT 'o_orderkey', 0.0 FROM orders LIMIT 2")
def _(spark, d):
    out = f"{_tmp(spark)}/nulls.parquet"
    sinks.write(_t(spark, d, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') AS status"), out)
    return footers.stats(spark, resolve(spark, [out])).select("name", "null_percent")


@_query("split_by_counts", "SELECT coalesce(nullif(event_type, 'click'), '__null__') AS label, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    e = _t(spark, d, "events").withColumn("kind", F.nullif(F.col("event_type"), F.lit("click")))
    return reshape.split_labels(e, "kind").groupBy(F.col("_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# E: footers
@_query("count_files", " UNION ALL ".join(f"SELECT '{t}' AS file, count(*) AS rows FROM {t}" for t in TABLES))
def _(spark, d):
    return footers.count(spark, _src(spark, d, *TABLES)).groupBy(_table().alias("file")).agg(F.sum("rows").alias("rows"))


@_query("count_total", "SELECT CAST(sum(n) AS BIGINT) AS total FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in TABLES) + ")")
def _(spark, d):
    return footers.count(spark, _src(spark, d, *TABLES), total=True)


_META = "(" + " UNION ALL ".join(f"SELECT '{t}' AS file, * EXCLUDE (file_name) FROM parquet_metadata('{AT}/{t}.parquet')" for t in TABLES) + ")"
_PATH = "replace(path_in_schema, ', ', '.')"


@_query("footer_stats", f"SELECT file, {_PATH} AS name, round(100.0 * sum(stats_null_count) / sum(row_group_num_rows), 1)::DOUBLE AS null_percent, CAST(sum(total_compressed_size) AS BIGINT) AS compressed_bytes, CAST(sum(total_uncompressed_size) AS BIGINT) AS uncompressed_bytes FROM {_META} GROUP BY ALL")
def _(spark, d):
    parts = [replace(s, name=t) for t in TABLES for s in _src(spark, d, t)]  # files of one name count as one
    return footers.stats(spark, parts).select("file", "name", "null_percent", "compressed_bytes", "uncompressed_bytes")


@_query("footer_min_max", "SELECT 'o_orderkey' AS name, CAST(min(o_orderkey) AS VARCHAR) AS min, CAST(max(o_orderkey) AS VARCHAR) AS max FROM orders UNION ALL SELECT 'o_totalprice', format('{:.4f}', min(o_totalprice)), format('{:.4f}', max(o_totalprice)) FROM orders UNION ALL SELECT 'o_orderpriority', min(o_orderpriority), max(o_orderpriority) FROM orders")
def _(spark, d):
    return footers.stats(spark, _src(spark, d, "orders"), "o_orderkey,o_totalprice,o_orderpriority").select("name", "min", "max")


@_query("scanned_stats", "SELECT 'c_custkey' AS name, 0.0::DOUBLE AS null_percent, CAST(min(c_custkey) AS VARCHAR) AS min, CAST(max(c_custkey) AS VARCHAR) AS max FROM customer UNION ALL SELECT 'c_mktsegment', 0.0, min(c_mktsegment), max(c_mktsegment) FROM customer")
def _(spark, d):
    return footers.scanned_stats(_t(spark, d, "customer").select("c_custkey", "c_mktsegment")).drop("distinct_count")


@_query("column_sizes", f"SELECT file, {_PATH} AS name, CAST(sum(total_compressed_size) AS BIGINT) AS compressed_bytes, round(sum(total_uncompressed_size) / sum(total_compressed_size), 2)::DOUBLE AS ratio FROM {_META} WHERE file IN ('orders', 'lineitem') GROUP BY ALL")
def _(spark, d):
    return footers.column_sizes(spark, _src(spark, d, "orders", "lineitem")).select(_base().alias("file"), "name", "compressed_bytes", "ratio")


@_query("size_top_k", f"SELECT {_PATH} AS name, CAST(sum(total_compressed_size) AS BIGINT) AS compressed_bytes FROM {_META} WHERE file = 'lineitem' GROUP BY 1 ORDER BY 2 DESC LIMIT 3")
def _(spark, d):
    return footers.column_sizes(spark, _src(spark, d, "lineitem"), top=3).select("name", "compressed_bytes")


@_query("size_totals", f"SELECT file, CAST(sum(total_compressed_size) AS BIGINT) AS data_compressed_bytes, CAST(sum(total_uncompressed_size) AS BIGINT) AS data_uncompressed_bytes FROM {_META} GROUP BY file")
def _(spark, d):
    sums = [F.sum(c).alias(c) for c in ("data_compressed_bytes", "data_uncompressed_bytes")]
    return footers.size_totals(spark, _src(spark, d, *TABLES)).groupBy(_table().alias("file")).agg(*sums)


@_query("row_group_stats", f"SELECT file, CAST(row_group_id AS INTEGER) AS row_group, {_PATH} AS name, row_group_num_rows AS rows, total_compressed_size AS compressed_bytes FROM {_META}")
def _(spark, d):
    return footers.row_group_stats(spark, _src(spark, d, *TABLES)).select(_table().alias("file"), "row_group", "name", "rows", "compressed_bytes")


@_query("page_offsets", f"SELECT file, {_PATH} AS column, CAST(row_group_id AS INTEGER) AS row_group, data_page_offset, total_compressed_size AS compressed_size FROM {_META}")
def _(spark, d):
    return footers.page_stats(spark, _src(spark, d, *TABLES)).select(_table().alias("file"), "column", "row_group", "data_page_offset", "compressed_size")


@_query("inspect_files", f"SELECT file, any_value(n) AS num_rows, count(*) AS num_columns, CAST(sum(total_uncompressed_size) AS BIGINT) AS uncompressed_bytes, any_value(compression) AS compression FROM (SELECT *, row_group_num_rows AS n FROM {_META}) GROUP BY file")
def _(spark, d):
    """A table's rows and columns are those of all its files. The SQL takes any row group's rows and counts chunks, which is the same where a table is one file of one row group."""
    table = footers.inspect(spark, _src(spark, d, *TABLES)).groupBy(_table().alias("file"))
    return table.agg(F.sum("num_rows").alias("num_rows"), F.max("num_columns").cast("long").alias("num_columns"), F.sum("uncompressed_bytes").alias("uncompressed_bytes"), F.mode("compression", True).alias("compression"))


@_query("inspect_schema_differs", "SELECT * FROM (VALUES ('customer', false), ('orders', true)) t(file, schema_differs)")
def _(spark, d):
    return footers.inspect_all(spark, _src(spark, d, "customer", "orders")).select(_base().alias("file"), "schema_differs")


@_query("schema_columns", " UNION ALL ".join(f"SELECT '{t}' AS file, name, type AS physical_type FROM parquet_schema('{AT}/{t}.parquet') WHERE type IS NOT NULL AND num_children IS NULL" for t in ("orders", "lineitem", "events")))
def _(spark, d):
    return footers.schema_columns(spark, _src(spark, d, "orders", "lineitem", "events")).select(_base().alias("file"), "name", "physical_type")


@_query("schema_diff", "SELECT * FROM (VALUES ('c_custkey', 'removed'), ('c_name', 'removed'), ('c_nationkey', 'removed'), ('c_acctbal', 'removed'), ('c_mktsegment', 'removed'), ('s_suppkey', 'added'), ('s_name', 'added'), ('s_nationkey', 'added'), ('s_acctbal', 'added')) t(\"column\", status)")
def _(spark, d):
    return footers.schema_diff(spark, *_src(spark, d, "customer", "supplier")).select("column", "status")


@_query("schema_diff_many", "SELECT * FROM (VALUES ('customer', 5, 2, 0, 'differs'), ('nation', 3, 2, 0, 'differs')) t(file, added, removed, changed, verdict)")
def _(spark, d):
    return footers.schema_diff_many(spark, _src(spark, d, "region", "customer", "nation")).withColumn("file", _base()).select("file", *[F.col(c).cast("int") for c in ("added", "removed", "changed")], "verdict")


_FILE = "(SELECT count(*) FROM {0}) AS rows_{1}, (SELECT count(DISTINCT row_group_id) FROM parquet_metadata('{2}/{0}.parquet')) AS row_groups_{1}, (SELECT any_value(compression) FROM parquet_metadata('{2}/{0}.parquet')) AS compression_{1}, (SELECT size FROM read_blob('{2}/{0}.parquet')) AS size_{1}"


@_query("metadata_diff", f"SELECT {_FILE.format('orders', 'a', AT)}, {_FILE.format('lineitem', 'b', AT)}")
def _(spark, d):
    return footers.metadata_diff(spark, *_src(spark, d, "orders", "lineitem")).withColumns({f"{c}_{x}": F.col(f"{c}_{x}").cast("long") for c in ("rows", "row_groups", "size") for x in "ab"})


@_query("bloom_info", "SELECT * FROM (VALUES ('o_custkey', true), ('o_orderstatus', false)) t(\"column\", has_bloom_filter)")
def _(spark, d):
    out = f"{_tmp(spark)}/bloom"
    _t(spark, d, "orders").select("o_custkey", "o_orderstatus").write.option("parquet.bloom.filter.enabled#o_custkey", "true").option("parquet.enable.dictionary", "false").parquet(out)
    got = footers.bloom_stats(spark, resolve(spark, [out]))
    return got.groupBy("column").agg(F.bool_and((F.col("bloom_filter_size") > 0) & F.col("has_bloom_filter")).alias("all"), F.bool_or("has_bloom_filter").alias("any")).select("column", F.coalesce("all", "any").alias("has_bloom_filter"))


# fixed values: orders' types in each dialect: whole number, text, float, time
_DDL = {
    "duckdb": ("BIGINT", "VARCHAR", "DOUBLE", "TIMESTAMP"),
    "postgres": ("BIGINT", "TEXT", "DOUBLE PRECISION", "TIMESTAMP"),
    "bigquery": ("INT64", "STRING", "FLOAT64", "TIMESTAMP"),
    "snowflake": ("BIGINT", "VARCHAR", "DOUBLE", "TIMESTAMP_NTZ"),
    "redshift": ("BIGINT", "VARCHAR(65535)", "DOUBLE PRECISION", "TIMESTAMP"),
    "mysql": ("BIGINT", "TEXT", "DOUBLE", "DATETIME"),
    "clickhouse": ("Nullable(Int64)", "Nullable(String)", "Nullable(Float64)", "Nullable(DateTime64(6))"),
    "spark": ("LongType()", "StringType()", "DoubleType()", "TimestampType()"),
}


def _ddl_rows() -> str:
    """The statements as SQL values, from the types above."""
    found = []
    for name, (number, text, real, time) in _DDL.items():
        columns = {"o_orderkey": number, "o_custkey": number, "o_orderstatus": text, "o_totalprice": real, "o_orderdate": time, "o_orderpriority": text}
        if name == "spark":
            statement = "orders = StructType([\n" + ",\n".join(f'    StructField("{c}", {t}, True)' for c, t in columns.items()) + "\n])"
        else:
            end = {"mysql": ") ENGINE=InnoDB;", "clickhouse": ") ENGINE = MergeTree()\nORDER BY tuple();"}.get(name, ");")
            statement = "CREATE TABLE orders (\n" + ",\n".join(f"    {c} {t}" for c, t in columns.items()) + "\n" + end
        found.append(f"('{name}', '{statement}')")
    return f"SELECT * FROM (VALUES {', '.join(found)}) t(dialect, statement)"


@_query("ddl_all_dialects", _ddl_rows())
def _(spark, d):
    return spark.createDataFrame([(x, ddl.ddl(_src(spark, d, "orders")[0], x)) for x in ddl.DIALECTS], "dialect string, statement string")


# F: unions, joins, differences, order
@_query("union_all_strict", "SELECT * FROM orders WHERE o_orderkey < 5000 UNION ALL SELECT * FROM orders WHERE o_orderkey >= 5000")
def _(spark, d):
    o = _t(spark, d, "orders")
    return combine.cat([("a", o.where("o_orderkey < 5000")), ("b", o.where("o_orderkey >= 5000"))])


@_query("union_by_name", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg, NULL::INTEGER AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier")
def _(spark, d):
    c = _t(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS bal", "c_mktsegment AS seg")
    s = _t(spark, d, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS key", "s_name AS name", "s_acctbal AS bal")
    return combine.cat([("customer", c), ("supplier", s)], by_name=True)


@_query("union_with_filename", "SELECT n_nationkey AS k, 'n' AS _filename FROM nation UNION ALL SELECT r_regionkey, 'r' FROM region")
def _(spark, d):
    return combine.cat([("n", _t(spark, d, "nation").selectExpr("n_nationkey AS k")), ("r", _t(spark, d, "region").selectExpr("r_regionkey AS k"))], add_filename=True)


@_query("merge_inner", "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    return combine.merge(_t(spark, d, "documents").select("doc_id", "lang", "source"), _t(spark, d, "labels"), "doc_id")


@_query("merge_left", "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    return combine.merge(_t(spark, d, "documents").select("doc_id", "lang", "source"), _t(spark, d, "labels"), "doc_id", outer=True)


@_query("merge_null_keys", "SELECT c.k, c.id, n.name FROM (SELECT nullif(c_nationkey, 3) AS k, c_custkey AS id FROM customer) c JOIN (SELECT nullif(n_nationkey, 3) AS k, n_name AS name FROM nation) n ON c.k IS NOT DISTINCT FROM n.k")
def _(spark, d):
    return combine.merge(_t(spark, d, "customer").selectExpr("nullif(c_nationkey, 3) AS k", "c_custkey AS id"), _t(spark, d, "nation").selectExpr("nullif(n_nationkey, 3) AS k", "n_name AS name"), "k")


@_query("merge_name_collision", "SELECT c.k, c.name, n.r FROM (SELECT c_nationkey AS k, c_name AS name FROM customer) c JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS k, n_regionkey AS r FROM nation) n ON CAST(c.k AS VARCHAR) = n.k")
def _(spark, d):
    return combine.merge(_t(spark, d, "customer").selectExpr("c_nationkey AS k", "c_name AS name"), _t(spark, d, "nation").selectExpr("CAST(n_nationkey AS STRING) AS k", "n_name AS name", "n_regionkey AS r"), "k")


@_query("diff_keyed", "SELECT CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS status, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey FROM (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
def _(spark, d):
    o = _t(spark, d, "orders")
    b = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")))
    return combine.diff_keyed(o.where("o_orderkey % 10 <> 0"), b, "o_orderkey").select("status", "o_orderkey")


@_query("diff_totals", "SELECT count(*) FILTER (WHERE o_orderkey % 10 = 0 AND o_orderpriority <> '5-LOW') AS total_added, count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND o_orderpriority = '5-LOW') AS total_removed, count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND o_orderpriority <> '5-LOW' AND o_orderstatus = 'F') AS total_changed FROM orders")
def _(spark, d):
    o = _t(spark, d, "orders")
    b = o.where("o_orderpriority <> '5-LOW'").withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("F")))
    return combine.diff_totals(combine.diff_keyed(o.where("o_orderkey % 10 <> 0"), b, "o_orderkey"))


@_query("diff_positional", "SELECT CASE WHEN c_acctbal < 0 THEN 'changed' ELSE 'same' END AS status, row_number() OVER (ORDER BY c_custkey) - 1 AS row FROM customer QUALIFY status = 'changed' UNION ALL SELECT 'added', (SELECT count(*) FROM customer) + n FROM range(3) t(n)")
def _(spark, d):
    """Customers in order against a copy with some balances changed and three rows more."""
    c, tmp = _t(spark, d, "customer").repartition(1).sortWithinPartitions("c_custkey"), _tmp(spark)
    sinks.write(c, f"{tmp}/a.parquet")
    more = spark.range(3).select(F.lit(None).cast("long").alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("x").alias("c_mktsegment"))
    changed = c.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    sinks.write(changed.unionByName(more).repartition(1).sortWithinPartitions(F.col("c_custkey").asc_nulls_last()), f"{tmp}/b.parquet")
    return combine.diff_positional(spark, *resolve(spark, [f"{tmp}/a.parquet", f"{tmp}/b.parquet"], keep_order=True)).select("status", "row")


@_query("union_multi_file_table", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    """One SQL table over a folder of files."""
    tmp = _tmp(spark)
    _t(spark, d, "customer").repartition(4).write.parquet(f"{tmp}/people")
    return sql.query(spark, "SELECT c_mktsegment AS segment, count(*) AS n FROM people GROUP BY 1", [f"{tmp}/people/"])


@_query("sort_nulls_first", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') ASC NULLS FIRST, o_orderkey) AS INTEGER) AS place FROM orders")
def _(spark, d):
    o = _t(spark, d, "orders").withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("F")))
    # a place in the whole order: offsets of range partitions instead of one task's window
    placed = rows.ordered(o, "s,o_orderkey").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    placed = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("_m")))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(sizes, "_p").select("o_orderkey", (F.col("_k") + F.col("_before")).cast("int").alias("place"))


# G: checks and reshaping
@_query("check_damaged", "SELECT * FROM (VALUES ('good', true), ('bad', false)) t(file, passed)")
def _(spark, d):
    """A good file and one that is no Parquet file."""
    tmp = _tmp(spark)
    sinks.write(_t(spark, d, "region"), f"{tmp}/good.parquet")
    sinks.write_text(spark, f"{tmp}/bad.parquet", ["PAR1 but no more"])
    return check.structural(spark, resolve(spark, [tmp])).groupBy(_base().alias("file")).agg(F.bool_and("passed").alias("passed"))


@_query("check_structural", "SELECT f AS file, n AS name, true AS passed FROM (VALUES ('orders'), ('events')) a(f), (VALUES ('footer'), ('row counts'), ('schema consistent'), ('statistics'), ('codec'), ('encodings'), ('page offsets'), ('read data')) b(n)")
def _(spark, d):
    return check.structural(spark, _src(spark, d, "orders", "events"), read_data=True).select(_base().alias("file"), "name", "passed")


_RULES = {
    "file": {"min_rows": 1000, "max_size": "1GB", "compression": ["snappy"]},
    "columns": {"o_orderkey": {"type": "INT64", "min": 0, "max": 10}, "o_orderstatus": {"allowed": ["F", "O"], "nullable": True}, "nope": {}},
    "freshness": {"column": "o_orderdate", "max_age": "36500d"},
}
_WANT = "SELECT * FROM (VALUES ('file.min_rows', true), ('file.max_size', true), ('file.compression', true), ('o_orderkey.exists', true), ('o_orderkey.type', true), ('o_orderkey.min', (SELECT min(o_orderkey) >= 0 FROM orders)), ('o_orderkey.max', (SELECT max(o_orderkey) <= 10 FROM orders)), ('o_orderstatus.exists', true), ('o_orderstatus.nullable', true), ('o_orderstatus.allowed', (SELECT {} FROM orders)), ('nope.exists', false), ('freshness', true)) t(name, passed)"


@_query("check_contract_footer", _WANT.format("min(o_orderstatus) IN ('F', 'O') AND max(o_orderstatus) IN ('F', 'O')"))
def _(spark, d):
    return check.contract(spark, _src(spark, d, "orders"), _RULES, now="2020-01-01").select("name", "passed")


@_query("check_contract_rows", _WANT.format("bool_and(o_orderstatus IN ('F', 'O'))"))
def _(spark, d):
    return check.contract(spark, _src(spark, d, "orders"), _RULES, read_data=True, now="2020-01-01").select("name", "passed")


@_query("compact_plan", "SELECT * FROM (VALUES (0, 3, 600), (1, 3, 600), (2, 2, 400)) t(\"group\", files, total_rows)")
def _(spark, d):
    """Eight files of 200 rows, planned by their footers; a group is full at the bytes of two and a half files."""
    tmp = _tmp(spark)
    one = _t(spark, d, "region").crossJoin(spark.range(200 // 5)).select("r_name", "id").repartition(1)  # 5 rows by 40
    for k in range(8):
        sinks.write(one, f"{tmp}/f{k}.parquet")
    files = resolve(spark, [tmp])
    plan = reshape.compact(spark, files, f"{tmp}/out", target=str(int(2.5 * max(s.size for s in files))), dry_run=True)
    return plan.select("group", F.size("files").alias("files"), F.col("total_rows").cast("int").alias("total_rows"))


def _tmp(spark: SparkSession) -> str:
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='colscope-')}"
    return f"{re.sub('^file:/+', '/', base).rstrip('/')}/colscope-{uuid.uuid4().hex}"


for _name, _end in [("csv", "csv"), ("tsv", "tsv"), ("jsonl", "jsonl"), ("arrow", "arrow"), ("parquet", "parquet")]:

    @_query(f"convert_roundtrip_{_name}", "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY c_mktsegment")
    def _(spark, d, end=_end):
        tmp = _tmp(spark)
        reshape.convert(spark, [f"{d}/customer.parquet"], f"{tmp}/customer.{end}")
        reshape.convert(spark, [f"{tmp}/customer.{end}"], f"{tmp}/back/customer.parquet")
        return _t(spark, f"{tmp}/back", "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_custkey").cast("long")).alias("keys"))


@_query("convert_roundtrip_documents", "SELECT doc_id, md5(coalesce(text, '?')) AS text FROM documents")
def _(spark, d):
    """Texts with quotes, commas and line breaks by way of CSV."""
    tmp = _tmp(spark)
    reshape.convert(spark, [f"{d}/documents.parquet"], f"{tmp}/documents.csv")
    return sinks.read(spark, f"{tmp}/documents.csv").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("?"))).alias("text"))


@_query("rewrite_codec", "SELECT * FROM (VALUES ('BROTLI', 1500, 'me'), ('ZSTD', 1500, NULL)) t(compression, num_rows, owner)".replace("1500", "(SELECT count(*) FROM customer)"))
def _(spark, d):
    tmp, s = _tmp(spark), _src(spark, d, "customer")[0]
    reshape.rewrite(spark, s, f"{tmp}/a.parquet", compression="brotli", set_kv="owner=me")
    reshape.rewrite(spark, s, f"{tmp}/b.parquet", compression="zstd", sort_by="c_name", row_group_rows=500)
    return footers.inspect(spark, resolve(spark, [tmp])).select("compression", "num_rows", F.col("key_value_metadata")["owner"].alias("owner"))


@_query("split_by_files", "SELECT c_mktsegment AS label, count(*) AS rows FROM customer GROUP BY 1")
def _(spark, d):
    tmp = _tmp(spark)
    reshape.split_by(spark, _src(spark, d, "customer"), "c_mktsegment", f"{tmp}/seg.parquet")
    return footers.count(spark, resolve(spark, [tmp])).select(F.regexp_extract("file", r"seg_([^/]+)\.parquet$", 1).alias("label"), "rows")


@_query("compact_files", "SELECT CAST(0 AS INTEGER) AS \"group\", count(*) AS total_rows FROM customer")
def _(spark, d):
    tmp = _tmp(spark)
    _t(spark, d, "customer").repartition(5).write.parquet(f"{tmp}/in")
    return reshape.compact(spark, resolve(spark, [f"{tmp}/in"]), f"{tmp}/out").select("group", "total_rows")

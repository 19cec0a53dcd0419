"""Every query of the catalogue against DuckDB on the small tables; footers and row places name the files they are compared at."""

import datetime
import decimal
import math
import os

import duckdb
import pyarrow.parquet as pq
import pytest

from colscope import catalog

AT = catalog.AT


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{AT}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(AT), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, AT)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    rel = duck.sql(catalog.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(str([plain(r[k]) for k in at]) for r in rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("orders", ["(1, 'F'), (2, 'O'), (2, 'P')", "(1, 'F'), (NULL, 'F'), (2, NULL)", "(NULL, NULL)", "(1, 'F') LIMIT 0"])
def test_anti_join_follows_sql_on_nulls_without_a_nested_loop(spark, tmp_path, orders):
    con = duckdb.connect()
    con.sql("CREATE TABLE customer AS SELECT * FROM (VALUES (1::BIGINT), (2), (2), (3), (NULL)) t(c_custkey)")
    con.sql(f"CREATE TABLE orders AS SELECT o_custkey::BIGINT AS o_custkey, o_orderstatus::VARCHAR AS o_orderstatus FROM (VALUES {orders.replace(' LIMIT 0', '')}) t(o_custkey, o_orderstatus) {'LIMIT 0' if 'LIMIT' in orders else ''}")
    for t in ("customer", "orders"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = catalog.QUERIES["sql_join_anti"](spark, str(tmp_path))
    assert "NestedLoopJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(str(r[0]) for r in df.collect()) == sorted(str(r[0]) for r in con.sql(catalog.ORACLES["sql_join_anti"]).fetchall())


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The tables, of which documents and labels are folders of files, and one of these has two row groups."""
    at = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    for t in catalog.TABLES:
        if t in ("documents", "labels"):
            os.mkdir(at / f"{t}.parquet")
            rows = pq.read_table(f"{AT}/{t}.parquet")
            pq.write_table(rows.slice(0, 100), at / f"{t}.parquet" / "part-0.parquet", row_group_size=60)
            pq.write_table(rows.slice(100), at / f"{t}.parquet" / "part-1.parquet")
        else:
            os.symlink(f"{AT}/{t}.parquet", at / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet{'/*' if t in ('documents', 'labels') else ''}')")
    return str(at), con


#: Queries whose rows tell of tables, whatever files these have.
OF_TABLES = [
    "count_files",
    "page_offsets",
    "footer_stats",
    "row_group_stats",
    "size_totals",
]


@pytest.mark.parametrize("name", OF_TABLES)
def test_tables_of_several_files(spark, folders, name):
    at, con = folders
    df = catalog.QUERIES[name](spark, at)
    cols = sorted(df.columns)
    rel = con.sql(catalog.ORACLES[name].replace(AT, at))
    order = [rel.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[k] for k in order]) for r in rel.fetchall())


def test_inspected_tables_of_several_files(spark, folders):
    """Rows and columns of whole tables. The SQL takes any row group's rows, so that its num_rows differs from run to run here."""
    at, con = folders
    got = {r.file: r for r in catalog.QUERIES["inspect_files"](spark, at).collect()}
    assert sorted(got) == sorted(catalog.TABLES)
    for t, r in got.items():
        assert r.num_rows == con.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0]
        assert r.uncompressed_bytes == con.sql(f"SELECT sum(total_uncompressed_size) FROM parquet_metadata('{at}/{t}.parquet')").fetchall()[0][0]
    assert (got["documents"].num_columns, got["labels"].num_columns, got["documents"].compression) == (5, 3, "SNAPPY")

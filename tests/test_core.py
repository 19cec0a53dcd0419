import io
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from colscope import cli
from colscope.errors import CheckFailed, PartlyFailed, UsageError
from colscope.functions import config, render, selectors, units
from colscope.operators import check, combine, ddl, footers, reshape, rows
from colscope.plans import sql
from colscope.sources import footer, resolve, sinks


def write(path, rows_per_group=None, **cols):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(cols), path, row_group_size=rows_per_group)
    return str(path)


@pytest.fixture
def base(tmp_path):
    schema = pa.schema([pa.field("id", pa.int64(), False), ("plant", pa.string()), ("height", pa.float64()), ("edible", pa.bool_())])
    t = pa.table([[1, 2, 3, 4, 5], ["chard", "fern", "leek", "moss", "yew"], [40.5, 70.25, 30.0, 2.5, 900.0], [True, False, True, False, False]], schema=schema)
    pq.write_table(t, tmp_path / "base.parquet")
    return str(tmp_path / "base.parquet")


@pytest.fixture
def evolved(tmp_path):
    return write(tmp_path / "evolved.parquet", id=[6, 7, 8], plant=["ash", "kale", "sedge"], height=[1500.0, 55.5, 80.0], soil=["loam", "sand", "peat"])


@pytest.fixture
def groups(tmp_path):
    return write(tmp_path / "groups.parquet", 2, id=[1, 2, 9, 10, 5, 6], name=list("ABCDEF"))


def src(spark, *paths):
    return resolve.resolve(spark, paths, keep_order=True)


def values(df, *cols):
    return [tuple(r[c] for c in (cols or df.columns)) for r in df.collect()]


@pytest.mark.parametrize(
    "text,name",
    [("data/orders.parquet", "orders"), ("orders*.parquet", "orders"), ("data/year=2024/", "year_2024"), ("2024.parquet", "t_2024"), ("My File-1.pq", "my_file_1"), ("***", "t"), ("C:\\data\\Sales.parquet", "sales"), ("s3://b/x/*.parquet", "x")],
)
def test_table_name(text, name):
    assert resolve.table_name(text) == name


def test_unique_names_and_sql_words():
    assert resolve.unique_name("a", {"a", "a_2"}) == "a_3"
    assert resolve.looks_like_sql("select") and resolve.looks_like_sql("FROM x SELECT 1") and not resolve.looks_like_sql("orders.parquet")


def test_units():
    assert units.parse_size("128MB") == 128_000_000 and units.parse_size("1GiB") == 1 << 30 and units.parse_size("77") == 77
    assert units.parse_duration("7d") == 604800 and units.parse_duration("90") == 90
    for bad in ("x", "1 parsec"):
        with pytest.raises(UsageError):
            units.parse_size(bad)
    assert units.shorten("abcdefgh", 5) == "ab..."


@pytest.mark.parametrize(
    "pattern,want",
    [("b,a", "ab"), ("!c", "abde"), ("#1", "b"), ("#1-3", "bcd"), ("#-2", "de"), ("/[ae]/", "ae"), ("#9-12", ""), ("/^(a|b)$/,e", "abe"), ("nope", ""), (None, "abcde"), ("/a{1,2}/", "a")],
)
def test_selectors(pattern, want):
    assert selectors.select_names(pattern, list("abcde")) == list(want)


def test_resolve_inputs(spark, tmp_path, base):
    write(tmp_path / "in" / "k=1" / "x.pq", a=[1])
    write(tmp_path / "in" / "y.parq", a=[2])
    (tmp_path / "in" / "z.txt").write_text("no")
    names = lambda *a: [s.name.rsplit("/", 1)[1] for s in resolve.resolve(spark, a)]
    assert names(str(tmp_path / "in")) == ["x.pq", "y.parq"] == names(f"{tmp_path}/in/**/*.p*")
    assert names(f"{tmp_path}/in/*.parq", f"{tmp_path}/in/y.parq") == ["y.parq"]
    with pytest.raises(UsageError, match="base.parquet"):
        resolve.resolve(spark, [str(tmp_path / "bas.parquet")])
    (tmp_path / "empty").mkdir()
    with pytest.raises(UsageError):
        resolve.resolve(spark, [str(tmp_path / "empty")])
    assert resolve.cloud_conf("http://m:9000", {"AWS_ACCESS_KEY_ID": "k"}) == {"fs.s3a.access.key": "k", "fs.s3a.endpoint": "http://m:9000", "fs.s3a.path.style.access": "true"}


def test_count_inspect_schema(spark, base, evolved):
    both = src(spark, base, evolved)
    assert footers.count(spark, both, total=True).first().total == 8
    i = footers.inspect(spark, both[:1]).first()
    assert (i.num_rows, i.num_columns, i.encryption, i.compression) == (5, 4, "none", "SNAPPY")
    assert {r.schema_differs for r in footers.inspect_all(spark, both).collect()} == {False, True}
    assert values(footers.schema_columns(spark, both[:1]), "name", "type", "nullable")[:2] == [("id", "INT64", False), ("plant", "VARCHAR", True)]
    got = dict(values(footers.schema_diff(spark, *both), "column", "status"))
    assert got == {"id": "nullability changed", "plant": "same", "height": "same", "edible": "removed", "soil": "added"}


def test_stats_compare_by_type(spark, groups):
    s = {r.name: r for r in footers.stats(spark, src(spark, groups)).collect()}
    assert (s["id"].min, s["id"].max, s["name"].min, s["name"].max, s["id"].null_percent) == ("1", "10", "A", "F", 0.0)
    assert footers.row_group_stats(spark, src(spark, groups), "id").count() == 3
    assert footers.page_stats(spark, src(spark, groups)).count() == 6
    assert [r.has_bloom_filter for r in footers.bloom_stats(spark, src(spark, groups)).collect()] == [False, False]
    with pytest.raises(UsageError):
        footers.stats(spark, src(spark, groups), sort="nope")


def test_logical_types(spark, tmp_path):
    import datetime
    import decimal

    t = pa.table({
        "u8": pa.array([1], pa.uint8()), "i16": pa.array([1], pa.int16()), "d": pa.array([decimal.Decimal("1.50")], pa.decimal128(10, 2)), "ts": pa.array([1], pa.timestamp("ms")), "ns": pa.array([1], pa.timestamp("ns")),
        "day": pa.array([datetime.date(2020, 1, 1)]), "tm": pa.array([1], pa.time64("us")), "l": pa.array([[1, 2]]), "s": pa.array([{"x": 1}]), "b": pa.array([b"x"]), "f": pa.array([b"ab"], pa.binary(2)),
    })
    pq.write_table(t, tmp_path / "t.parquet")
    got = dict(values(footers.schema_columns(spark, src(spark, str(tmp_path / "t.parquet"))), "name", "type"))
    assert {k: got[k] for k in ("u8", "i16", "d", "ts", "ns", "day", "tm", "b", "f")} == {"u8": "UINT8", "i16": "INT16", "d": "DECIMAL(10,2)", "ts": "TIMESTAMP_MS", "ns": "TIMESTAMP_NS", "day": "DATE", "tm": "TIME", "b": "BYTE_ARRAY", "f": "FIXED_LEN_BYTE_ARRAY"}
    assert "l.list.element" in got and "s.x" in got
    for d in ddl.DIALECTS:
        text = ddl.ddl(src(spark, str(tmp_path / "t.parquet"))[0], d)
        assert "u8" in text and text.count("\n") >= 12
    assert "UInt8" in ddl.ddl(src(spark, str(tmp_path / "t.parquet"))[0], "ch")


def test_ddl_nullability_after_nested(spark, tmp_path):
    schema = pa.schema([("l", pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.field("must", pa.int64(), False)])
    pq.write_table(pa.table([[{"a": 1, "b": 2}], [1]], schema=schema), tmp_path / "n.parquet")
    s = src(spark, str(tmp_path / "n.parquet"))[0]
    assert "must BIGINT NOT NULL" in ddl.ddl(s, "duckdb") and "l STRUCT,\n" in ddl.ddl(s, "duckdb") and 'StructField("must", LongType(), False)' in ddl.ddl(s, "spark")
    with pytest.raises(UsageError):
        ddl.ddl(s, "cobol")


def test_rows_by_place(spark, groups, base):
    s = src(spark, groups)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(rows.head(spark, s, 3)) == [1, 2, 9] and ids(rows.tail(spark, s, 2)) == [5, 6]
    assert ids(rows.slice_rows(spark, s, "1:3")) == [2, 9] and ids(rows.slice_rows(spark, s, ":2")) == [1, 2] and ids(rows.slice_rows(spark, s, "4:")) == [5, 6]
    assert ids(rows.slice_rows(spark, s, row_groups="0,2")) == [1, 2, 5, 6]
    assert ids(rows.slice_rows(spark, s, prune="id >= 7")) == [9, 10] and ids(rows.slice_rows(spark, s, prune="id > 7", row_groups="0")) == []
    assert ids(rows.slice_rows(spark, s, prune="name < 'B'")) == [1, 2]
    for bad in ("x:1", "3:1"):
        with pytest.raises(UsageError):
            rows.slice_rows(spark, s, bad)
    a = ids(rows.sample(spark, s, 3, seed=5))
    assert len(a) == 3 and a == ids(rows.sample(spark, s, 3, seed=5)) and len(ids(rows.sample(spark, s, 99))) == 6
    parts = values(rows.split_ids(spark, src(spark, groups, base), 4).groupBy("_part").count().orderBy("_part"))
    assert parts == [(0, 3), (1, 3), (2, 3), (3, 2)]
    assert rows.split_row_groups(spark, s).select("_part").distinct().count() == 3


def test_cat(spark, base, evolved):
    s = src(spark, base, evolved)
    with pytest.raises(UsageError):
        combine.cat_files(spark, s)
    out = combine.cat_files(spark, s, by_name=True, add_filename=True, sort_by="soil,id")
    assert out.columns == ["id", "plant", "height", "edible", "soil", "_filename"] and out.count() == 8 and out.first().soil is None
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("1",)], "x string")
    with pytest.raises(UsageError):
        combine.cat([("a", a), ("b", b)], by_name=True)


def test_merge_keys(spark):
    left = spark.createDataFrame([("red,", "fox", 7), ("red", ",fox", 8), (None, "owl", 9), ("elk", "elk", 6)], "k1 string, k2 string, v long")
    right = spark.createDataFrame([("red,", "fox", 71, 1), ("red", ",fox", 82, 2), (None, "owl", 93, 3), (None, "owl", 94, 4)], "k1 string, k2 string, w long, v long")
    assert sorted(values(combine.merge(left, right, "k1,k2"), "v", "w")) == [(7, 71), (8, 82), (9, 93), (9, 94)]
    assert (6, None) in values(combine.merge(left, right, "k1,k2", outer=True), "v", "w")
    assert values(combine.merge(spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([("1", "y")], "k string, b string"), "k")) == [(1, "x", "y")]
    assert combine.merge(left, right.limit(0), "k1").count() == 0
    with pytest.raises(UsageError):
        combine.merge(left, right, "nope")


def test_diff(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "null"), (4, "d"), (None, "q")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "null"), (3, "null"), (5, "e"), (None, "r")], "k int, v string")
    assert sorted(values(combine.diff_keyed(a, b, "k"), "status", "k"), key=str) == sorted([("changed", 2), ("removed", 4), ("added", 5), ("changed", None)], key=str)
    x, y = write(tmp_path / "x.parquet", a=[1, 2, 3]), write(tmp_path / "y.parquet", a=[1, 5])
    d = combine.diff_positional(spark, *src(spark, x, y))
    assert sorted(values(d, "status", "row")) == [("changed", 1), ("removed", 2)]
    assert tuple(combine.diff_totals(d).first()) == (0, 1, 1)


def test_structural_check(spark, base, tmp_path):
    (tmp_path / "bad.parquet").write_text("not a parquet file")
    got = check.structural(spark, src(spark, base, str(tmp_path / "bad.parquet")), read_data=True).collect()
    assert all(r.passed for r in got if r.file == base) and not all(r.passed for r in got if r.file != base)
    with pytest.raises(CheckFailed):
        check.require(spark.createDataFrame(got))


def test_contract(spark, base, tmp_path):
    rules = {"file": {"min_rows": 1000}, "columns": {"id": {"type": "INT64", "nullable": False, "min": 0.0, "max": 10.0}, "plant": {"allowed": ["chard", "yew"]}}}
    s = src(spark, base)
    got = dict(values(check.contract(spark, s, rules), "name", "passed"))
    assert got == {"file.min_rows": False, "id.exists": True, "id.type": True, "id.nullable": True, "id.min": True, "id.max": True, "plant.exists": True, "plant.allowed": True}
    assert not dict(values(check.contract(spark, s, rules, read_data=True), "name", "passed"))["plant.allowed"]
    for unit in ("s", "ms", "us"):
        p = tmp_path / f"t_{unit}.parquet"
        pq.write_table(pa.table({"t": pa.array([1_700_000_000 * {"s": 1, "ms": 1000, "us": 10**6}[unit]], pa.timestamp(unit))}), p)
        fresh = lambda age: check.contract(spark, src(spark, str(p)), {"freshness": {"column": "t", "max_age": age}}, now="2023-11-15 00:00:00").first().passed  # noqa: B023, E731
        assert fresh("2d") and not fresh("10m")
    with pytest.raises(UsageError):
        check.contract(spark, s, {"colums": {}})


def test_convert_and_rewrite(spark, base, tmp_path):
    for end in ("csv", "tsv", "jsonl", "arrow", "parquet"):
        reshape.convert(spark, [base], f"{tmp_path}/a.{end}")
        reshape.convert(spark, [f"{tmp_path}/a.{end}"], f"{tmp_path}/back_{end}.parquet", compression="gzip")
        assert sorted(values(spark.read.parquet(f"{tmp_path}/back_{end}.parquet").select("id", "plant", "height", "edible")))[0] == (1, "chard", 40.5, True)
    (tmp_path / "n.csv").write_text("4,plum\n9,sloe\n")
    reshape.convert(spark, [f"{tmp_path}/n.csv"], f"{tmp_path}/n.parquet", header=False)
    assert values(spark.read.parquet(f"{tmp_path}/n.parquet")) == [(4, "plum"), (9, "sloe")]
    s = src(spark, base)[0]
    for codec, shown in (("brotli", "BROTLI"), ("none", "UNCOMPRESSED"), (None, "SNAPPY")):
        reshape.rewrite(spark, s, f"{tmp_path}/r.parquet", compression=codec, set_kv="owner=me", sort_by="plant", row_group_rows=2)
        r = footers.inspect(spark, src(spark, f"{tmp_path}/r.parquet")).first()
        assert (r.compression, r.num_rows, r.key_value_metadata["owner"]) == (shown, 5, "me")
    reshape.rewrite(spark, src(spark, f"{tmp_path}/r.parquet")[0], f"{tmp_path}/q.parquet", strip_kv="owner")
    assert "owner" not in footers.inspect(spark, src(spark, f"{tmp_path}/q.parquet")).first().key_value_metadata
    with pytest.raises(UsageError):
        sinks.codec("lzma")


def test_standard_csv(spark, tmp_path):
    odd = [(1, 'says "no"', " a "), (2, "two\nlines, a comma", ""), (3, None, "\\ \"\\"), (4, "", "\r\nx\t")]
    df = spark.createDataFrame(odd, "n int, t string, u string")
    for end in ("csv", "tsv"):
        sinks.write(df, f"{tmp_path}/odd.{end}")
        assert values(sinks.read(spark, f"{tmp_path}/odd.{end}").orderBy("n")) == [(n, t or None, u or None) for n, t, u in odd]
    (tmp_path / "std.csv").write_text('k,v\n1,"a ""b"" c"\n2,"x\ny"\n')  # as other tools write it
    assert values(sinks.read(spark, f"{tmp_path}/std.csv")) == [(1, 'a "b" c'), (2, "x\ny")]
    import csv

    with open(tmp_path / "odd.csv", newline="") as f:
        assert list(csv.reader(f))[1] == ["1", 'says "no"', " a "]


def test_levels(spark, tmp_path):
    sizes = {}
    for kind, level in (("gzip", 1), ("gzip", 9), ("brotli", 1), ("brotli", 9)):
        out = tmp_path / f"{kind}{level}.parquet"
        sinks.write(spark.range(200_000).selectExpr("cast(id * 7919 % 1000 as string) AS s"), str(out), compression=kind, level=level, dictionary=False)
        sizes[kind, level] = out.stat().st_size
    assert sizes["gzip", 1] > sizes["gzip", 9] and sizes["brotli", 1] > sizes["brotli", 9]
    for kind, level in (("snappy", 1), ("gzip", 10), ("zstd", 0)):
        with pytest.raises(UsageError):
            sinks.parquet_options(kind, level)


def test_parquet_options(spark, tmp_path):
    sinks.write(spark.range(6000), f"{tmp_path}/o.parquet", compression="zstd", level=9, row_group_rows=1000, stats=False)
    m = pq.ParquetFile(f"{tmp_path}/o.parquet").metadata
    assert m.num_row_groups == 6 and m.row_group(0).column(0).compression == "ZSTD" and not m.row_group(0).column(0).is_stats_set


def test_split_and_compact(spark, tmp_path, groups):
    p = write(tmp_path / "s.parquet", k=["a/b", None, "c", "c"], v=[1, 2, 3, 4])
    made = reshape.split_by(spark, src(spark, p), "k", f"{tmp_path}/out/part.parquet")
    assert sorted(m.rsplit("/", 1)[1] for m in made) == ["part___null__.parquet", "part_a%2Fb.parquet", "part_c.parquet"]
    assert spark.read.parquet(f"{tmp_path}/out/part_c.parquet").columns == ["k", "v"]
    assert len(reshape.split_n(spark, src(spark, groups), 2, f"{tmp_path}/n/x_{{n}}.parquet")) == 2 and (tmp_path / "n/x_1.parquet").exists()
    assert len(reshape.split_groups(spark, src(spark, groups), f"{tmp_path}/g/x.parquet")) == 3
    plan = reshape.plan_compaction([("a", 10, 1), ("b", 10, 1), ("c", 90, 1), ("d", 30, 1), ("e", 5, 1)], 40)
    assert [g["files"] for g in plan] == [["a", "b", "e"]]
    folder = tmp_path / "small"
    for k in range(4):
        write(folder / f"f{k}.parquet", id=[k], v=[str(k)])
    s = resolve.resolve(spark, [str(folder)])
    assert reshape.compact(spark, s, f"{tmp_path}/big", dry_run=True).count() == 1 and not (tmp_path / "big").exists()
    reshape.compact(spark, s, f"{tmp_path}/big", in_place=True, backup=f"{tmp_path}/old", sort_by="id")
    assert spark.read.parquet(f"{tmp_path}/big/compacted_0000.parquet").count() == 4 and not list(folder.glob("*.parquet")) and len(list((tmp_path / "old").rglob("*.parquet"))) == 4
    write(folder / "x.parquet", id=[1])
    write(folder / "y.parquet", other=["1"])
    with pytest.raises(PartlyFailed):
        reshape.compact(spark, resolve.resolve(spark, [str(folder)]), f"{tmp_path}/big2")


def test_sql(spark, base, evolved, tmp_path):
    assert sql.query(spark, "SELECT plant FROM base WHERE height > 60 ORDER BY id", [base]).count() == 2
    assert sql.query(spark, "SELECT count(*) AS n FROM a JOIN e ON a.id + 5 = e.id", aliases=[f"a={base}", f"e={evolved}"]).first().n == 3
    with pytest.raises(UsageError, match="base"):
        sql.query(spark, "SELECT * FROM nope", [base])
    with pytest.raises(UsageError):
        sql.register(spark, aliases=[f"a={base}", f"a={base}"])
    with pytest.raises(UsageError, match="different schemas"):
        sql.register(spark, [str(tmp_path)])
    assert "Scan parquet" in sql.explain(spark, "SELECT 1 FROM base", [base])
    assert any(r.metric == "numOutputRows" and r.value == 5 for r in sql.analyze(spark, "SELECT * FROM base", [base]).collect())
    assert sql.split_arguments(["SELECT 1", "x.parquet"]) == ("SELECT 1", ["x.parquet"]) and sql.split_arguments(["x.parquet"], stdin="SELECT 2") == ("SELECT 2", ["x.parquet"])


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('format = "csv"\nquiet = true\n')
    assert config.load(str(tmp_path / "c.toml"), {}).format == "csv"
    assert config.load(str(tmp_path / "c.toml"), {"COLSCOPE_FORMAT": "json", "COLSCOPE_JOBS": "3"}).jobs == 3
    assert config.load(str(tmp_path / "c.toml"), {"COLSCOPE_FORMAT": "json"}, format="tsv").format == "tsv"
    assert render.choose(None, "x.csv", True) == "csv" and render.choose(None, None, True) == "table" and render.choose(None, "x.odd", True) == "json"


def test_cli(spark, base, evolved, groups, tmp_path, capsys):
    def run(*args):
        out = io.StringIO()
        return cli.main([*args], out, spark), out.getvalue()

    assert run("count", base) == (0, "5\n") and run("count", "--total-only", base, evolved) == (0, "8\n")
    code, text = run("head", "-n", "2", "-c", "id", "-f", "jsonl", base)
    assert code == 0 and [json.loads(x) for x in text.splitlines()] == [{"id": 1}, {"id": 2}]
    assert run("t", "-n", "1", "-f", "csv", base)[1].splitlines() == ["id,plant,height,edible", "5,yew,900.0,false"]
    assert json.loads(run(base)[1])[0]["num_rows"] == 5 and "VARCHAR" in run("s", base)[1]
    assert run("q", "SELECT max(id) AS m FROM groups", groups)[1].replace(" ", "") == '[\n{"m":10}\n]\n'
    assert run("schema", "diff", base, evolved)[0] == 0 and run("diff", "--data", base, base)[0] == 0 and run("size", groups)[0] == 0 and run("st", "--pages", groups)[0] == 0
    (tmp_path / "c.toml").write_text("[file]\nmin_rows = 1000\n")
    assert run("check", base)[0] == 0 and run("check", "--contract", str(tmp_path / "c.toml"), base)[0] == 3
    assert run("cat", "--union-by-name", base, evolved, "-o", f"{tmp_path}/u.parquet")[0] == 0 and run("count", f"{tmp_path}/u.parquet")[1] == "8\n"
    assert run("merge", "--key", "id", base, base, "-o", f"{tmp_path}/m.parquet")[0] == 0 and run("slice", "--rows", "0:2", "-o", f"{tmp_path}/sl.parquet", base)[0] == 0
    one = lambda *args: json.loads(run(*args, "-f", "json")[1])
    assert one("count", base, evolved)["total"] == 8 and [f["rows"] for f in one("count", base, evolved)["files"]] == [5, 3]
    size = one("size", base)
    assert [c["name"] for c in size["columns"]] == ["id", "plant", "height", "edible"] and size["file_size_bytes"] == size["footer_bytes"] + size["data_compressed_bytes"]
    assert [c["name"] for c in one("inspect", base)[0]["schema"]] == ["id", "plant", "height", "edible"] and len(one("inspect", base, evolved)) == 2
    assert one("check", base)["failed"] == 0 and {c["passed"] for c in one("check", base)["checks"]} == {True}
    both = one("diff", "--data", "--key", "id", base, evolved)
    assert len(both["schema_diff"]) == 5 and both["metadata_diff"]["rows_a"] == 5 and both["data_diff"]["total_added"] == 3 and len(both["data_diff"]["removed"]) == 5
    assert [(g["row_group"], len(g["columns"])) for g in one("stats", "-g", groups)] == [(0, 2), (1, 2), (2, 2)]
    plan = one("compact", "--dry-run", base, evolved, "-o", f"{tmp_path}/packed")
    assert plan["input_files"] == 2 and plan["input_rows"] == 8
    assert run("cat", base, "--folder", "-o", f"{tmp_path}/parts.parquet")[0] == 0 and (tmp_path / "parts.parquet").is_dir()
    assert run("head", "-o", f"file://{tmp_path}/rows.csv", base)[0] == 0 and (tmp_path / "rows.csv").read_text().startswith("id,plant")
    assert run("convert", base, "-o", f"file://{tmp_path}/rows.arrow")[0] == 0 and (tmp_path / "rows.arrow").is_file()
    assert run("q", "SELECT strpos('abc', 'c') AS at, date_bin(INTERVAL '1' HOUR, TIMESTAMP'2020-01-01 10:20:30') AS bin, regexp_match('a12b', '[0-9]+')[0] AS m", "-f", "jsonl")[1] == '{"at": 3, "bin": "2020-01-01T10:00:00", "m": "12"}\n'
    assert run("head", f"{tmp_path}/none.parquet")[0] == 2 and run("frob", "--nope")[0] == 2 and run("merge", base, base)[0] == 2
    assert "chard" in "\n".join(render.render(spark.read.parquet(base), "table"))


def test_footer_source_is_spread(spark, base, evolved):
    df = footer.footer(spark, src(spark, base, evolved) * 20, "files")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 40

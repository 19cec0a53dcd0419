"""SQL over files: each input becomes a table with a derived name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..errors import UsageError
from ..functions import dialect
from ..sources.footer import signatures
from ..sources.resolve import Source, expand, is_identifier, looks_like_sql, table_name, unique_name


def register(spark: SparkSession, inputs: Sequence[str] = (), aliases: Sequence[str] | dict[str, str] = ()) -> dict[str, list[Source]]:
    """Temporary views for inputs (derived names, made unique by _2, _3) and for name=path aliases. Returns the files of each."""
    named = list(aliases.items()) if isinstance(aliases, dict) else []
    for a in [] if isinstance(aliases, dict) else aliases:
        name, eq, path = a.partition("=")
        if not eq or not is_identifier(name):
            raise UsageError(f"not of the form name=path: {a}")
        named.append((name, path))
    if twice := [n for n, _ in named if [m for m, _ in named].count(n) > 1]:
        raise UsageError(f"two tables are named {twice[0]}")
    out: dict[str, list[Source]] = {}
    for name, path in named:
        out[name] = expand(spark, path)
    for text in inputs:
        out[unique_name(table_name(text), set(out))] = expand(spark, text)
    for name, files in out.items():
        view(spark, name, files)
    return out


def view(spark: SparkSession, name: str, files: Sequence[Source]) -> DataFrame:
    """One view over files whose column names and types must agree with the first file's; folder names give no columns."""
    if len(files) > 1 and signatures(spark, files).select("signature").distinct().count() > 1:
        raise UsageError(f"{name}: its {len(files)} files have different schemas")
    df = spark.read.option("recursiveFileLookup", "true").schema(spark.read.parquet(files[0].path).schema).parquet(*[f.path for f in files])
    df.createOrReplaceTempView(name)
    return df


def query(spark: SparkSession, text: str, inputs: Sequence[str] = (), aliases: Sequence[str] | dict[str, str] = (), batch_size: int | None = None) -> DataFrame:
    """The result of a query over the inputs' tables; errors name the tables that there are."""
    tables = register(spark, inputs, aliases)
    dialect.register(spark)
    if batch_size:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(batch_size))
    try:
        return spark.sql(text)
    except (AnalysisException, ParseException) as e:
        first = str(e).splitlines()[0]
        hint = f" (tables: {', '.join(tables)})" if "TABLE_OR_VIEW_NOT_FOUND" in first else ""
        raise UsageError(f"{first}{hint}") from None


def explain(spark: SparkSession, text: str, inputs: Sequence[str] = (), aliases: Sequence[str] | dict[str, str] = ()) -> str:
    df = query(spark, text, inputs, aliases)
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def analyze(spark: SparkSession, text: str, inputs: Sequence[str] = (), aliases: Sequence[str] | dict[str, str] = ()) -> DataFrame:
    """Run a query once, without its rows leaving the executors, for its metrics: depth, node, metric, value of each step of the plan that ran."""
    df = query(spark, text, inputs, aliases)
    df._jdf.queryExecution().toRdd().count()
    rows: list[tuple] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), depth)
        metrics = node.metrics().iterator()
        while metrics.hasNext():
            m = metrics.next()
            rows.append((len(rows), depth, name, m._1(), int(m._2().value())))
        if hasattr(node, "plan") and name.endswith("QueryStage"):
            return walk(node.plan(), depth + 1)
        children = node.children().iterator()
        while children.hasNext():
            walk(children.next(), depth + 1)

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return spark.createDataFrame(rows, "id int, depth int, node string, metric string, value long")


def split_arguments(args: Sequence[str], from_file: str | None = None, stdin: str | None = None, aliases: bool = False) -> tuple[str, list[str]]:
    """(query, inputs) of a command line. With a query file all arguments are inputs; text piped in is the query unless the first argument is one."""
    args = list(args)
    if from_file:
        with open(from_file) as f:
            return f.read(), args
    if stdin is not None:
        if args and looks_like_sql(args[0]) and (len(args) > 1 or aliases):
            return args[0], args[1:]
        return stdin, args
    if not args:
        raise UsageError("no query")
    return args[0], args[1:]

"""Inputs (files, globs, folders, cloud and http addresses, standard input) to sorted lists of Parquet paths."""

from __future__ import annotations

import re
import sys
import tempfile
import urllib.request
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..errors import UsageError

# fixed values: file names that are read, words that begin a query
EXTENSIONS = (".parquet", ".parq", ".pq")
SQL_WORDS = {"select", "with", "explain", "values", "show", "describe", "table", "from"}


@dataclass(frozen=True, order=True)
class Source:
    """A file: the name to show, the path that Spark reads, and its size in bytes."""

    name: str
    path: str
    size: int


def is_parquet(path: str) -> bool:
    return path.lower().endswith(EXTENSIONS)


def is_glob(path: str) -> bool:
    return any(c in path for c in "*?[")


def spark_path(text: str) -> str:
    """Addresses as Hadoop's connectors name them: s3:// and r2:// are s3a://, az:// is abfss://, gcs:// is gs://."""
    # fixed values: schemes, and the connectors' for them
    for ours, theirs in (("s3://", "s3a://"), ("r2://", "s3a://"), ("az://", "abfss://"), ("azure://", "abfss://"), ("gcs://", "gs://")):
        if text.startswith(ours):
            return theirs + text[len(ours) :]
    return text


def cloud_conf(endpoint: str | None = None, env: dict[str, str] | None = None) -> dict[str, str]:
    """Hadoop settings for object stores from the usual environment variables; a custom endpoint means path-style access."""
    env = env or {}
    conf: dict[str, str] = {}

    def put(key: str, *names: str) -> None:
        for n in names:
            if env.get(n):
                conf[key] = env[n]
                return

    put("fs.s3a.access.key", "AWS_ACCESS_KEY_ID")
    put("fs.s3a.secret.key", "AWS_SECRET_ACCESS_KEY")
    put("fs.s3a.session.token", "AWS_SESSION_TOKEN")
    put("fs.s3a.endpoint.region", "AWS_REGION", "AWS_DEFAULT_REGION")
    put("fs.s3a.endpoint", "AWS_ENDPOINT_URL_S3", "AWS_ENDPOINT_URL", "AWS_ENDPOINT")
    put("fs.gs.auth.service.account.json.keyfile", "GOOGLE_APPLICATION_CREDENTIALS")
    put("fs.gs.project.id", "GOOGLE_CLOUD_PROJECT")
    if env.get("AZURE_STORAGE_ACCOUNT") or env.get("AZURE_STORAGE_ACCOUNT_NAME"):
        account = env.get("AZURE_STORAGE_ACCOUNT") or env["AZURE_STORAGE_ACCOUNT_NAME"]
        put(f"fs.azure.account.key.{account}.dfs.core.windows.net", "AZURE_STORAGE_KEY", "AZURE_STORAGE_ACCOUNT_KEY")
    if endpoint:
        conf["fs.s3a.endpoint"] = endpoint
    if "fs.s3a.endpoint" in conf:
        conf["fs.s3a.path.style.access"] = "true"
    return conf


def configure_cloud(spark: SparkSession, conf: dict[str, str]) -> None:
    for k, v in conf.items():
        spark._jsc.hadoopConfiguration().set(k, v)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _shown(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def _listed(spark: SparkSession, statuses) -> list[Source]:
    return [Source(_shown(s.getPath().toString()), s.getPath().toString(), s.getLen()) for s in statuses if s.isFile() and is_parquet(s.getPath().getName())]


def _walk(spark: SparkSession, path: str) -> list[Source]:
    fs, p = _fs(spark, path)
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        found.append(it.next())
    return _listed(spark, found)


def _glob(spark: SparkSession, pattern: str) -> list[Source]:
    """`*` stays inside a folder, `**` crosses folders."""
    if "**" in pattern:
        head = pattern.split("**", 1)[0].rsplit("/", 1)[0] or ("/" if pattern.startswith("/") else ".")
        fs, p = _fs(spark, head)
        base = fs.makeQualified(p).toString()
        rule = _glob_rule(_fs(spark, pattern.split("**")[0] + "x")[0].makeQualified(spark._jvm.org.apache.hadoop.fs.Path(head)).toString() + pattern[len(head) :] if head != "." else base + "/" + pattern)
        return [s for s in _walk(spark, head) if rule.fullmatch(s.path) or rule.fullmatch(re.sub(r"^file:/+", "file:/", s.path))]
    fs, p = _fs(spark, pattern)
    return _listed(spark, fs.globStatus(p) or [])


def _glob_rule(pattern: str) -> re.Pattern:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return re.compile(out)


def _fetched(url: str) -> str:
    name = url.split("?", 1)[0].rsplit("/", 1)[-1] or "download.parquet"
    path = f"{tempfile.mkdtemp(prefix='colscope-')}/{name}"
    urllib.request.urlretrieve(url, path)
    return path


def _spooled(stream) -> str:
    with tempfile.NamedTemporaryFile("wb", suffix=".parquet", delete=False) as f:
        while chunk := stream.read(1 << 20):
            f.write(chunk)
    return f.name


def siblings(spark: SparkSession, path: str, most: int = 5) -> list[str]:
    """Parquet files beside a path that does not exist, most alike first."""
    import difflib

    fs, p = _fs(spark, path)
    parent = p.getParent()
    if parent is None or not fs.exists(parent):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(parent) if s.isFile() and is_parquet(s.getPath().getName())]
    return sorted(names, key=lambda n: (-difflib.SequenceMatcher(None, n, p.getName()).ratio(), n))[:most]


def expand(spark: SparkSession, text: str, stdin=None) -> list[Source]:
    """The files of one input, sorted by name without repeats; an error if there are none."""
    if text == "-":
        text = _spooled(stdin or sys.stdin.buffer)
    elif text.startswith(("http://", "https://")):
        if is_glob(text.split("?", 1)[0]):
            raise UsageError(f"{text}: an http address must name one file")
        text = _fetched(text)
    path = spark_path(text)
    fs, p = _fs(spark, path)
    if is_glob(path):
        found = _glob(spark, path)
    elif not fs.exists(p):
        near = siblings(spark, path)
        raise UsageError(f"{text}: no such file" + (f"; did you mean {', '.join(near)}?" if near else ""))
    elif fs.getFileStatus(p).isDirectory():
        found = _walk(spark, path)
    else:
        s = fs.getFileStatus(p)
        found = [Source(_shown(s.getPath().toString()), s.getPath().toString(), s.getLen())]
    if not found:
        raise UsageError(f"{text}: no Parquet files ({', '.join(EXTENSIONS)})")
    return sorted(set(found))


def resolve(spark: SparkSession, inputs: Sequence[str], keep_order: bool = False) -> list[Source]:
    """The files of all inputs. They are sorted by name and each is taken once, unless the order of arguments has a meaning (keep_order)."""
    if not inputs:
        raise UsageError("no input")
    found = [s for text in inputs for s in expand(spark, text)]
    return found if keep_order else sorted(set(found))


def table_name(text: str) -> str:
    """orders*.parquet -> orders, data/year=2024/ -> year_2024, 2024.parquet -> t_2024."""
    path = text.split("://", 1)[-1].split("?", 1)[0] if text.startswith(("http://", "https://")) else text.split("://", 1)[-1]
    parts = [x for x in path.replace("\\", "/").split("/") if x]
    while len(parts) > 1 and re.split(r"[*?\[]", parts[-1])[0] == "":
        parts.pop()
    last = re.split(r"[*?\[]", parts[-1])[0] if parts else ""
    last = re.sub(r"\.(parquet|parq|pq)$", "", last, flags=re.I)
    return sanitized(last)


def sanitized(name: str) -> str:
    name = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "t"
    return f"t_{name}" if name[0].isdigit() else name


def unique_name(name: str, taken: set[str]) -> str:
    out, k = name, 2
    while out in taken:
        out, k = f"{name}_{k}", k + 1
    return out


def is_identifier(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) is not None


def looks_like_sql(text: str) -> bool:
    words = text.split()
    return len(words) > 1 or bool(words) and words[0].lower() in SQL_WORDS

"""WARC archives of pages, and a two-level index of their captures.

Archives are plain WARC 1.1 files. Spark's text sink writes the records, each being one row whose separator is the
blank lines that end a WARC record, so that files are committed by Spark on any file system. Reading streams a file and
walks from record to record by Content-Length; a task holds one record and READ_BYTES, however large the file is.

The index has the captures sorted by reversed-host URL key, cut into compressed blocks, and, in files of its own, a
sparse directory with the first and last key of each block. A look-up searches the directory for the block, the block for the key, and reads the
record's bytes only. locate() and read_ranges() do this in bulk, in the cluster; CaptureIndex does it for single urls.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, scratch, small, table, written

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that an archive is to have on the average, and bytes of records that a task range-reads.
FILE_BYTES = 16 << 20
#: Captures in a block of the index.
BLOCK_LINES = 512
#: Bytes read at once; neighbouring records are read together up to this.
READ_BYTES = 1 << 20
END = "\r\n\r\n"
RECORD = "page_id long, url string, kind string, payload_digest string, payload_bytes long, refers_to long, payload binary, file string, offset long, length long"


def base32(hex_: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: eight digits of five bits for every ten of four."""
    bits = F.array_join(F.transform(F.split(hex_, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.substring(F.lit(ALPHABET), F.conv(bits.substr(k * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), "")


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """`page_id`, `url`, `payload` (string, null as empty), `payload_bytes`, `payload_digest`, `refers_to`: null for a response, else the id of the record with the same payload.

    Of records with equal payloads of at least `least` bytes that with the smallest id is the response; rows that
    repeat this id are responses, too. A null id sorts before all others. Other columns are not read, whatever their
    names; an empty table gives an empty result.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    # SHA-1, SHA-256 and length stand for the content; the groups' texts need not travel
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "_sha1": F.sha1(F.encode("payload", "UTF-8")), "_more": F.sha2("payload", 256)})
    key = ["_sha1", "_more", "payload_bytes"]
    groups = rows.where(F.col("payload_bytes") >= least).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.count("page_id").alias("_ids"), F.min("page_id").alias("_first"))
    groups = groups.where("_n > 1").withColumn("_first", F.when(F.col("_ids") == F.col("_n"), F.col("_first")))
    rows = rows.join(small(written(groups.drop("_ids"), "payloads")), key, "left")
    later = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    refers = F.when(later, F.coalesce(F.col("_first").cast("string"), F.lit("null")))
    return rows.select("page_id", "url", "payload", "payload_bytes", base32(F.col("_sha1")).alias("payload_digest"), refers.alias("refers_to"))


def _uri(url: Column) -> Column:
    """The url on one header line: control characters become blanks' percent codes."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def records(plan: DataFrame) -> DataFrame:
    """A `value` per row of planned(): a WARC record without its ending blank lines."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page,
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), _uri(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END),
    )
    return plan.select(F.concat(head, block).alias("value"))


def write_archives(plan: DataFrame, out: str, file_bytes: int = FILE_BYTES) -> None:
    """Write planned() rows as WARC files under `out`, where they are, without a shuffle. A task begins a new file after so many records as have about file_bytes on the average."""
    size = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0) + 600
    mean = plan.agg(F.avg(size)).first()[0] or 600
    records(plan).write.option("lineSep", END).option("compression", "none").option("maxRecordsPerFile", max(1, int(file_bytes / mean))).text(out)


def parse(data: bytes, file: str = "", start: int = 0) -> Iterator[tuple]:
    """Records of an archive, or of whole records of it that begin at byte start, as tuples of RECORD's columns; the payload of a revisit is None."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 8] != b"WARC/1.1":
            raise ValueError(f"no record at byte {start + at} of {file}")
        top = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b":"), b"") for line in data[at:top].split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        block = view[top + 4 : top + 4 + n]
        ends = bytes(block[:256]).index(b"\r\n\r\n") + 4
        says = int(bytes(block[:ends]).split(b"Content-Length: ")[1].split(b"\r\n")[0])
        page = fields[b"WARC-Record-ID"][10:-1]
        refers = fields.get(b"WARC-Refers-To", b"<urn:page:null>")[10:-1]
        kind = fields[b"WARC-Type"].decode()
        payload = bytes(block[ends:]) if kind == "response" else None
        if payload is not None and len(payload) != says:
            raise ValueError(f"a payload of {len(payload)} bytes, {says} were written")
        number = lambda x: None if x == b"null" else int(x)
        end = top + 4 + n + 4
        yield number(page), fields[b"WARC-Target-URI"].decode(), kind, fields[b"WARC-Payload-Digest"][5:].decode(), says, number(refers), payload, file, start + at, end - at
        at = end


def _sha1(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


KINDS = {"page_id": pa.int64(), "url": pa.string(), "kind": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}


def _schema(payloads: bool) -> str:
    return ", ".join(x for x in RECORD.split(", ") if payloads or not x.startswith("payload "))


def _checked(records_: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """parse()'s records in batches of the columns named. A digest that does not fit the payload is an error."""
    rows, size = [], 0
    for r in records_:
        if r[6] is not None and _sha1(r[6]) != r[3]:
            raise ValueError(f"the payload of page {r[0]} is damaged")
        rows.append(r if "payload" in names else r[:6] + r[7:])
        size += len(r[6] or b"")
        if size > 8 << 20:
            yield _batch(rows, names)
            rows, size = [], 0
    if rows:
        yield _batch(rows, names)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORD rows of the WARC files under path. Digests of responses are computed anew from the bytes read and compared."""
    names = [c for c in KINDS if payloads or c != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                yield from _checked(_streamed(file), names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")
    return files.mapInArrow(run, _schema(payloads))


def _streamed(file: str) -> Iterator[tuple]:
    """parse() over a whole file, of which no more is held than a record and READ_BYTES."""
    with _opened(file) as stream:
        held, start, need = b"", 0, 1
        while True:
            more = stream.read(max(READ_BYTES, need - len(held)))
            held += more
            end, need = _whole(held)
            yield from parse(held[:end], file, start)
            held, start = held[end:], start + end
            if not more:
                if held:
                    raise ValueError(f"no whole record at byte {start} of {file}")
                return


def _whole(data: bytes) -> tuple[int, int]:
    """Where the whole records of data end, and the bytes that the next one needs from there, as far as they are known."""
    at = 0
    while (top := data.find(b"\r\n\r\n", at)) >= 0:
        field = data.index(b"Content-Length: ", data.rindex(b"Content-Type: ", at, top), top + 4) + 16
        end = top + 4 + int(data[field : data.find(b"\r\n", field)]) + 4
        if end > len(data):
            return at, end - at
        at = end
    return at, 1


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[n]) for n, c in zip(names, zip(*rows))], names)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_key(url: Column) -> Column:
    """`com,example,www)/path?query`: the host reversed and lower-cased, so that a domain's captures stand together.

    The key is of the url as it stands in the archive, and has no control characters. It is sorted, stored and searched
    as it is: Spark's order of bytes and Python's order of code points are the same.
    """
    url = _uri(url)
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(url)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = rest.substr(F.length(host) + 1, F.length(rest))
    return F.concat(F.array_join(F.reverse(F.split(F.translate(host, UPPER, LOWER), r"\.")), ","), F.lit(")"), F.substring_index(tail, "#", 1))


def key_of(url: str | None) -> str:
    """url_key() of one url."""
    rest = re.sub(r"[\x00-\x20\x7F]", "%20", url or "").split("://", 1)[-1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    return ",".join(reversed(rest[:cut].translate(str.maketrans(UPPER, LOWER)).split("."))) + ")" + rest[cut:].split("#", 1)[0]


def build_index(captures: DataFrame, out: str, block_lines: int = BLOCK_LINES) -> None:
    """Write the index of read_archives() rows: blocks/ (part, block, first key, last key, compressed lines) and directory/ (the same without the lines). Equal keys may reach over several blocks, and parts. Give it a written table, or its rows are computed twice, as the sort samples them first."""
    rows = captures.select(url_key(F.col("url")).alias("key"), "page_id", "kind", "file", "offset", "length")
    ordered = rows.repartitionByRange(F.col("key"), F.col("page_id")).sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, lines = TaskContext.get().partitionId(), 0, []

        def close() -> pa.RecordBatch:
            data = zlib.compress("\n".join("\t".join(x) for x in lines).encode())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([lines[0][0]]), pa.array([lines[-1][0]]), pa.array([data], pa.binary())], ["part", "block", "first", "last", "lines"])

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                lines.append([*map(str, r)])
                if len(lines) == block_lines:
                    yield close()
                    block, lines = block + 1, []
        if lines:
            yield close()

    ordered.mapInArrow(run, "part int, block int, first string, last string, lines binary").write.option("parquet.block.size", 1 << 20).parquet(f"{out}/blocks")
    captures.sparkSession.read.parquet(f"{out}/blocks").select("first", "last", "part", "block").write.parquet(f"{out}/directory")


def _blocks_of(directory: list[tuple], firsts: list[str], key: str) -> list[tuple[int, int]]:
    """(part, block) that may hold a key, from the sorted (first, last, part, block)."""
    return [(p, b) for _, last, p, b in directory[max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)] if last >= key]


def _hits(directory: list[tuple], firsts: list[str], keys: list[str]) -> pa.RecordBatch:
    """(part, block, key) for all blocks that may hold a key."""
    hits = [(p, n, k) for k in keys for p, n in _blocks_of(directory, firsts, k)]
    return pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["part", "block", "key"])


def _lines_of(data: bytes, keys: list[str]) -> Iterator[list[str]]:
    """The lines of one block that have one of the keys."""
    lines = [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]
    every = [x[0] for x in lines]
    for k in keys:
        yield from lines[bisect_left(every, k) : bisect_right(every, k)]


def locate(spark: SparkSession, out: str, urls: DataFrame, max_entries: int = BROADCAST_ROWS) -> DataFrame:
    """`file`, `offset`, `length` of all captures of the urls (the only column), each once, by look-ups in the index under out.

    The directory goes to the executors, who search it for the blocks; each block asked for is opened once. Of a
    directory of more than max_entries only a row for each part goes to them; keys then meet their part's entries.
    """
    blocks, entries = spark.read.parquet(f"{out}/blocks"), spark.read.parquet(f"{out}/directory")
    keys = urls.select(url_key(F.col(urls.columns[0])).alias("key")).distinct()
    large = entries.limit(max_entries + 1).count() > max_entries
    top = entries.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last", "part", F.lit(-1).alias("block")) if large else entries
    sent = spark.sparkContext.broadcast(sorted(tuple(r) for r in top.toLocalIterator()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [d[0] for d in sent.value]
        for b in batches:
            yield _hits(sent.value, firsts, b.column(0).to_pylist())

    def in_part(one: pa.Table, entries_: pa.Table) -> pa.Table:
        directory = sorted(zip(*[entries_[c].to_pylist() for c in ("first", "last", "part", "block")]))
        return pa.Table.from_batches([_hits(directory, [d[0] for d in directory], one["key"].to_pylist())])

    kind = "part int, block int, key string"
    wanted = keys.mapInArrow(search, kind)
    if large:
        wanted = wanted.select("part", "key").groupBy("part").cogroup(entries.groupBy("part")).applyInArrow(in_part, kind)
    asked = wanted.groupBy("part", "block").agg(F.collect_list("key").alias("keys"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys_, data in zip(b.column(0).to_pylist(), b.column(1)):
                found = [(x[3], int(x[4]), int(x[5])) for x in _lines_of(data.as_py(), keys_)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "length"])

    return asked.join(blocks, ["part", "block"]).select("keys", "lines").mapInArrow(find, "file string, offset long, length long")


def _opened(file: str) -> pa.NativeFile:
    from pyarrow import fs

    if file.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", file))
    store, path = fs.FileSystem.from_uri(file)
    return store.open_input_file(path)


def _runs(places: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(file, offset, length) in order, neighbours joined up to READ_BYTES."""
    last = None
    for file, offset, length in places:
        if last and last[0] == file and last[1] + last[2] == offset and last[2] + length <= READ_BYTES:
            last = file, last[1], last[2] + length
        else:
            if last:
                yield last
            last = file, offset, length
    if last:
        yield last


def read_ranges(places: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORD rows of the records at locate()'s places, read by ranges by the executors; other bytes of the archives are not read.

    Digests of responses are computed anew and compared. Tasks get about FILE_BYTES of records each.
    """
    places = written(places, "places")
    names = [c for c in KINDS if payloads or c != "payload"]
    tasks = max(1, math.ceil((places.agg(F.sum("length")).first()[0] or 0) / FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        try:
            for b in batches:
                for file, offset, length in _runs(zip(*[c.to_pylist() for c in b.columns])):
                    if file != name:
                        if stream:
                            stream.close()
                        name, stream = file, _opened(file)
                    stream.seek(offset)
                    yield from _checked(parse(stream.read(length), file, offset), names)
        finally:
            if stream:
                stream.close()

    ordered = places.repartitionByRange(tasks, F.col("file"), F.col("offset")).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, _schema(payloads))


class CaptureIndex:
    """Look-ups of single urls by the driver. The directory has one entry per block; it is loaded up to max_entries, beyond which each look-up filters it in the cluster."""

    def __init__(self, spark: SparkSession, out: str, max_entries: int = 1_000_000):
        self.spark = spark
        self.blocks = spark.read.parquet(f"{out}/blocks")
        entries = spark.read.parquet(f"{out}/directory").select("part", "block", "first", "last")
        self.directory = None
        if entries.limit(max_entries + 1).count() <= max_entries:
            self.directory = sorted((r.first_, r.last_, r.part, r.block) for r in entries.toDF("part", "block", "first_", "last_").toLocalIterator())
            self.firsts = [d[0] for d in self.directory]

    def captures(self, url: str) -> list[tuple[str, str, str, int, int]]:
        """(page id, kind, file, offset, length) of all captures of a url."""
        key = key_of(url)
        if self.directory is None:
            wanted = [(r.part, r.block) for r in self.blocks.where((F.col("first") <= key) & (F.col("last") >= key)).select("part", "block").collect()]
        else:
            wanted = _blocks_of(self.directory, self.firsts, key)
        found = []
        for part, block in wanted:
            data = self.blocks.where((F.col("part") == part) & (F.col("block") == block)).select("lines").first()[0]
            found += [(x[1], x[2], x[3], int(x[4]), int(x[5])) for x in _lines_of(bytes(data), [key])]
        return found

    def read(self, file: str, offset: int, length: int) -> tuple:
        """One record by a range read."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            stream.seek(offset)
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
        finally:
            stream.close()
        return next(parse(data, file))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, the index of all captures, and the records by look-ups of all urls."""
    pages = table(spark, sf_dir, "pages")
    out, index = scratch(spark, "warc"), scratch(spark, "warc-index")
    write_archives(planned(pages), out)
    build_index(written(read_archives(spark, out, payloads=False), "captures"), index)
    got = read_ranges(locate(spark, index, pages.select("url")), payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
x AS (SELECT page_id, b, list_reduce(list_transform(range(40), lambda i: lpad(bin(CAST('0x' || h[i + 1] AS INTEGER)), 4, '0')), lambda s, t: s || t) AS bits,
             min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER)
           + 4 * CAST(bits[5 * i + 3] AS INTEGER) + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER)]), lambda s, t: s || t) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""

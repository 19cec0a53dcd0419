"""Documents as token ids in binary shards, written in ascending order of document id."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .bpe import Pairs, Words, merge
from .common import scratch, table, written
from .sentencepiece_codec import pieces_of

#: Tokens after which a shard is closed, at the next document's end.
SHARD_TOKENS = 2_000_000
#: A space between two characters that are no white space begins a pre-token, whatever surrounds it.
EDGE = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, "ByteBpe"] = {}


def byte_bpe(path: str) -> "ByteBpe":
    """The tokenizer of a file; a worker process loads it once."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


class ByteBpe:
    """Ids of the tokenizers library for a byte-level BPE file, special tokens in the text included.

    Texts are cut where pre-tokens surely end; the ids of each different cut are found once. Cuts without a special
    token are pre-tokenised and merged here, all new ones together; the others go through the library.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError("not a byte-level BPE file of the supported kind")
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        self.size = self.library.get_vocab_size()
        shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))  # bytes that stand for themselves
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.of_byte = np.array([vocab[char[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = Pairs({(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(merges)})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self._renew()

    def _renew(self) -> None:
        self.cuts, self.tokens = Words(600_000), Words(1_200_000)
        self.bad: set[int] = set()

    def _merge_fresh(self) -> None:
        fresh = self.tokens.fresh
        for at in range(0, len(fresh), 50_000):
            raw = [w.encode() for w in fresh[at : at + 50_000]]
            lens = np.fromiter(map(len, raw), np.int64, len(raw))
            self.tokens.learn(*merge(self.of_byte[np.frombuffer(b"".join(raw), np.uint8)], lens, self.pairs))

    def _learn(self) -> None:
        """Ids of the new cuts. A cut is the text after a space, or a 1-tuple of a document's first."""
        cuts = self.cuts.fresh
        parts, counts, library = [], [], []
        for k, c in enumerate(cuts):
            if type(c) is str:
                if c.isalpha():
                    parts.append(" " + c)
                    counts.append(1)
                    continue
                text = " " + c
                sure = c and not c[0].isspace() and not c[-1].isspace()
            else:
                text = c[0]
                sure = len(c) > 1 or not text or not text[-1].isspace()
            if not sure:  # its spaces are no sure edges
                self.bad.add(self.cuts[c])
            if any(s in text for s in self.special):
                library.append((k, text))
                counts.append(0)
                continue
            found = self.pattern.findall(text)
            counts.append(len(found))
            parts += found
        counts = np.array(counts, np.int64)
        at = np.fromiter(map(self.tokens.__getitem__, parts), np.int64, len(parts))
        if self.tokens.fresh:
            self._merge_fresh()
        widths = np.concatenate([[0], np.cumsum(self.tokens.lens[at].astype(np.int64))])
        ends = np.cumsum(counts)
        lens, flat = widths[ends] - widths[ends - counts], self.tokens.ids(at)
        if library:
            ids = {k: self.library.encode(t, add_special_tokens=False).ids for k, t in library}
            tops = np.cumsum(lens)
            rows = [np.array(ids[k], np.int64) if k in ids else flat[tops[k] - lens[k] : tops[k]] for k in range(len(cuts))]
            lens, flat = np.array([len(r) for r in rows], np.int64), np.concatenate(rows)
        self.cuts.learn(flat, lens)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the number of ids of each; `end` is appended to each text."""
        if self.cuts.full() or self.tokens.full():
            self._renew()
        split = []
        for t in texts:
            cuts = t.split(" ")
            cuts[0] = (cuts[0],)
            split.append(cuts)
        at, counts = self._numbers(split)
        if self.bad:
            flag = np.zeros(len(self.cuts), bool)
            flag[list(self.bad)] = True
            odd = flag[at]
            if odd.any():
                for k in np.unique(np.repeat(np.arange(len(texts)), counts)[odd]).tolist():
                    cuts = EDGE.split(texts[k])
                    # inner spaces make such a cut's text differ from any single one's; the mark keeps it from `bad`
                    split[k] = [(cuts[0], 0), *[(" " + c, 0) for c in cuts[1:]]]
                at, counts = self._numbers(split)
        widths = np.concatenate([[0], np.cumsum(self.cuts.lens[at].astype(np.int64))])
        ends = np.cumsum(counts)
        lens, flat = widths[ends] - widths[ends - counts], self.cuts.ids(at)
        if end is not None:
            lens = lens + 1
            out = np.full(int(lens.sum()), end, np.int32)
            mine = np.ones(len(out), bool)
            mine[np.cumsum(lens) - 1] = False
            out[mine] = flat
            flat = out
        return flat, lens

    def _numbers(self, split: list[list]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.cuts.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.cuts.fresh:
            self._learn()
        return at, counts


def tokenized(docs: DataFrame, path: str, end: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`_id` long, `ids` binary (uint16, or uint32 for vocabularies over 65,536) of each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path)
        kind = id_type(coder.size)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in pieces_of(texts, 1_000_000):
                flat, lens = coder.encode(texts[i:j], end)
                raw, ends = flat.astype(kind).tobytes(), (np.cumsum(lens) * kind.itemsize).tolist()
                ids = [raw[e - n * kind.itemsize : e] for e, n in zip(ends, lens.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(ids, pa.binary())], ["_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col)).mapInArrow(run, "_id long, ids binary")


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents; tasks count, and at most `size` sums come to the driver."""
    kind = id_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                seen += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size) if len(x.as_buffer()) > size else _sparse(np.frombuffer(x.as_buffer(), kind), seen)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.id] = r.n
    return counts


def _sparse(ids: np.ndarray, seen: np.ndarray) -> int:
    np.add.at(seen, ids, 1)
    return 0


SHARDS = "part int, seq int, n_docs int, n_tokens long, doc_ids binary, doc_null binary, doc_lens binary, data binary"


def write_shards(docs: DataFrame, out: str, tokenizer: str, end: int | None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> rans.Table:
    """Write docs' ids under `out`: shards/ (a row per shard, `data` being its bytes, with the ids and lengths of its documents), parts/ (tokens and place of the first token of each part) and table/ (the frequencies).

    Documents stand in ascending order of id, nulls first, rows of one id in order of their ids' bytes. A shard is one
    task's work and has about shard_tokens tokens, or one longer document. Spark's Parquet committer makes rewriting by
    retried tasks safe, on any file system. The driver gets the id counts (at most the vocabulary) and a sum per part.
    """
    spark = docs.sparkSession
    size = byte_bpe(tokenizer).size
    kind = id_type(size)
    tokens = written(tokenized(docs, tokenizer, end, id_col, text_col), "tokens")
    freq = rans.Table.counted(count_ids(tokens, size))
    sent = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, nulls, lens, held = [], [], [], []
        have = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, have
            every = np.concatenate([np.frombuffer(x, kind) for x in held])
            row = [part, seq, len(lens), len(every), np.array(doc_ids, "<i8").tobytes(), np.packbits(nulls).tobytes(), np.array(lens, "<i8").tobytes(), rans.encode_shard(every, sent.value)]
            seq, have = seq + 1, 0
            for x in (doc_ids, nulls, lens, held):
                x.clear()
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in SHARDS.split(", ")])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc_ids.append(i or 0)
                nulls.append(i is None)
                lens.append(len(x) // kind.itemsize)
                held.append(x)
                have += lens[-1]
                if have >= shard_tokens:
                    yield close()
        if lens:
            yield close()

    ordered = tokens.repartitionByRange("_id").sortWithinPartitions("_id", "ids")
    ordered.mapInArrow(run, SHARDS).write.option("compression", "none").parquet(f"{out}/shards")
    sums = spark.read.parquet(f"{out}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts = np.cumsum([0, *[r.n for r in sums]])[:-1] if sums else []
    spark.createDataFrame([(r.part, r.n, int(s)) for r, s in zip(sums, starts)], "part int, n_tokens long, start long").coalesce(1).write.parquet(f"{out}/parts")
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.freq.tolist()) if f], "id int, freq int").coalesce(1).write.parquet(f"{out}/table")
    return freq


def read_table(spark: SparkSession, out: str, size: int) -> rans.Table:
    freq = np.zeros(size, np.int64)
    for r in spark.read.schema("id int, freq int").parquet(f"{out}/table").toLocalIterator():
        freq[r.id] = r.freq
    return rans.Table(freq)


def read_shards(spark: SparkSession, out: str, tokenizer: str, ids: bool = True) -> DataFrame:
    """Documents from the shards: `_id`, `start`, `n_tokens`, `ids_crc32`, and with `ids` the ids (array<int>)."""
    from pyspark.sql import Window

    sent = spark.sparkContext.broadcast(read_table(spark, out, byte_bpe(tokenizer).size))
    shards = spark.read.schema(SHARDS).parquet(f"{out}/shards")
    parts = spark.read.schema("part int, n_tokens long, start long").parquet(f"{out}/parts").select("part", "start")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    # places come from the small columns; the shards' bytes are not dealt anew
    places = shards.select("part", "seq", before.alias("_before")).join(parts, "part").select("part", "seq", (F.col("start") + F.col("_before")).alias("start"))
    placed = shards.join(F.broadcast(places) if places.limit(200_001).count() <= 200_000 else places, ["part", "seq"])
    schema = "_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                got = rans.decode_shard(r["data"], sent.value).astype("<u4")
                lens = np.frombuffer(r["doc_lens"], "<i8")
                ends = np.cumsum(lens)
                mask = np.unpackbits(np.frombuffer(r["doc_null"], np.uint8))[: len(lens)].astype(bool)
                view = memoryview(got)
                crc = [zlib.crc32(view[e - n : e]) for e, n in zip(ends.tolist(), lens.tolist())]
                cols = [pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=mask), pa.array(r["start"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(got.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    return placed.select("doc_ids", "doc_null", "doc_lens", "data", "start").mapInArrow(run, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "token-files")
    write_shards(table(spark, sf_dir, "documents"), out, tokenizer_path(), end=2)
    return read_shards(spark, out, tokenizer_path(), ids=False).withColumnRenamed("_id", "doc_id")

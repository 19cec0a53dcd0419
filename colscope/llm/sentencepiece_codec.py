"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bpe import Pairs, SHIFT, Words, merge
from .common import ragged, table

SPACE = "▁"
#: Characters of text that are worked on at once, whatever the batch; a single longer text is worked on alone.
CHARS = 500_000
#: Words whose ids are remembered, besides those of the texts that are worked on. What is forgotten is merged anew: a matter of memory and time, not of results.
WORDS = 200_000
_loaded: dict[str, "Codec"] = {}


def codec(path: str) -> "Codec":
    """The codec of a model file; a worker process loads it once."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


class Codec:
    """Ids of the sentencepiece library for BPE models with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)) or any(SPACE in p.lstrip(SPACE) for p in pieces) or sp.encode(" ﬁ  a ", out_type=str) != sp.encode(sp.decode(sp.encode(" ﬁ  a ")), out_type=str):
            raise ValueError("not a model of the supported kind")
        self.end = sp.eos_id()
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_base = byte_ids[0]
        if byte_ids != list(range(self.byte_base, self.byte_base + 256)):
            raise ValueError("byte pieces are not in order")
        self.size = n
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        if n + 0x110000 >= 1 << SHIFT:
            raise ValueError("too many pieces")
        # a character's symbol is its piece, or else stands above all pieces
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        rank = {s: k for k, s in enumerate(sorted({-sp.get_score(i) for i in ids.values()}))}

        def symbol(p: str) -> int | None:
            return int(self.of_char[ord(p)]) if len(p) == 1 else ids.get(p)

        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None:
                    pairs[a, b] = (rank[-sp.get_score(i)], i)
        self.pairs = Pairs(pairs)
        # decoding: bytes and decimal digits of each id
        control = {i for i in range(n) if sp.is_control(i)}
        shown = [b"" if i in control else " ⁇ ".encode() if sp.is_unknown(i) else bytes([i - self.byte_base]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.shown, self.shown_at, self.shown_len = _table(shown)
        self.digits, self.digits_at, self.digits_len = _table([b"%d " % i for i in range(n)])
        self.control = np.isin(np.arange(n), list(control))
        self.is_byte = (np.arange(n) >= self.byte_base) & (np.arange(n) < self.byte_base + 256)
        self.leads = np.array([not special[i] and p.startswith(SPACE) for i, p in enumerate(pieces)])
        self._renew()

    def _renew(self) -> None:
        self.words = Words(WORDS)

    def _learn(self) -> None:
        fresh = self.words.fresh
        for at in range(0, len(fresh), 50_000):  # bounds the arrays of a round
            part = fresh[at : at + 50_000]
            text = "".join([SPACE + w for w in part])
            lens = np.fromiter(map(len, part), np.int64, len(part)) + 1
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            flat, n = merge(self.of_char[code], lens, self.pairs)
            foreign = flat >= self.size
            if foreign.any():
                flat, n = self._bytes_of(flat, n, foreign)
            self.words.learn(flat, n)

    def _bytes_of(self, flat: np.ndarray, lens: np.ndarray, foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their UTF-8 bytes."""
        chars = flat[foreign] - self.size
        width = np.ones(len(flat), np.int64)
        width[foreign] = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        raw = np.frombuffer("".join(map(chr, chars.tolist())).encode(), np.uint8)
        out = np.repeat(flat, width)
        out[np.repeat(foreign, width)] = raw.astype(np.int64) + self.byte_base
        owner = np.repeat(np.arange(len(lens)), lens)
        return out, np.bincount(owner, width, len(lens)).astype(np.int64)

    def encode(self, texts: list[str], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the number of ids of each. A word is a run of spaces with what follows up to the next space; no piece reaches over its end."""
        if self.words.full():
            self._renew()
        every: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if not t:
                continue
            if SPACE in t:  # the library can't tell it from a space
                t = t.replace(SPACE, " ")
            words = t.split(" ")
            if "" in words:
                words = _spaced(words)
            counts[k] = len(words)
            every += words
        at = np.fromiter(map(self.words.__getitem__, every), np.int64, len(every))
        if self.words.fresh:
            self._learn()
        word_lens = self.words.lens[at].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(word_lens)])
        ends = np.cumsum(counts)
        lens = upto[ends] - upto[ends - counts]
        flat = self.words.ids(at)
        if end:
            lens = lens + 1
            out = np.full(int(lens.sum()), self.end, np.int32)
            mine = np.ones(len(out), bool)
            mine[np.cumsum(lens) - 1] = False
            out[mine] = flat
            flat = out
        return flat, lens

    def decode_bytes(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the library's decode(ids) for each text: flat bytes, and the number of bytes of each."""
        flat = flat.astype(np.int64)
        width = self.shown_len[flat]
        owner = np.repeat(np.arange(len(lens)), lens)
        # the dummy prefix: the space that leads a text's first piece that isn't a control piece
        spoken = np.flatnonzero(~self.control[flat])
        _, first = np.unique(owner[spoken], return_index=True)
        first = spoken[first]
        first = first[self.leads[flat[first]]]
        start = self.shown_at[flat]
        start[first] += 1
        width[first] -= 1
        out = ragged(self.shown, start, width)
        sizes = np.bincount(owner, width, len(lens)).astype(np.int64)
        odd = np.unique(owner[self.is_byte[flat] & (flat >= self.byte_base + 0x80)])
        if len(odd):  # byte pieces may be no valid UTF-8, and a control piece between them parts them
            out, sizes = self._mended(flat, lens, out, sizes, odd)
        return out, sizes

    def _mended(self, flat, lens, out, sizes, odd):
        ends, tops = np.cumsum(sizes), np.cumsum(lens)
        parts, done, new = [], 0, sizes.copy()
        for k in odd.tolist():
            ids = flat[tops[k] - lens[k] : tops[k]]
            if not self.control[ids[:-1]].any():
                try:
                    out[ends[k] - sizes[k] : ends[k]].tobytes().decode()
                    continue
                except UnicodeDecodeError:
                    pass
            fixed = self._spelled(ids)
            parts += [out[done : ends[k] - sizes[k]], np.frombuffer(fixed, np.uint8)]
            done = ends[k]
            new[k] = len(fixed)
        return (np.concatenate([*parts, out[done:]]), new) if parts else (out, sizes)

    def _spelled(self, ids: np.ndarray) -> bytes:
        """Runs of byte pieces give their valid characters; each other byte gives U+FFFD."""
        out, run, start = bytearray(), bytearray(), True

        def flush() -> None:
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.extend(bytes(run[:n]).decode().encode())
                        del run[:n]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.extend("�".encode())
                    del run[:1]

        for i in ids.tolist():
            shown = self.shown[self.shown_at[i] : self.shown_at[i] + self.shown_len[i]].tobytes()
            if self.is_byte[i]:
                run += shown
                start = False
                continue
            flush()
            if not self.control[i]:
                out += shown[1:] if start and self.leads[i] else shown
                start = False
        flush()
        return bytes(out)

    def decode(self, ids: list[list[int]]) -> list[str]:
        lens = np.array([len(x) for x in ids], np.int64)
        out, sizes = self.decode_bytes(np.array([i for x in ids for i in x], np.int64), lens)
        raw, ends = out.tobytes(), np.cumsum(sizes)
        return [raw[e - s : e].decode() for e, s in zip(ends.tolist(), sizes.tolist())]

    def decimal(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each followed by a space: flat bytes, and the number of bytes of each text."""
        width = self.digits_len[flat]
        upto = np.concatenate([[0], np.cumsum(width)])
        ends = np.cumsum(lens)
        return ragged(self.digits, self.digits_at[flat], width), upto[ends] - upto[ends - lens]


def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(r) for r in rows], np.int64)
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(lens) - lens, lens


def _spaced(words: list[str]) -> list[str]:
    """split(" ") with its empty strings turned to leading space marks of the next word."""
    out, marks = [], 0
    for w in words:
        if w:
            out.append(SPACE * marks + w)
            marks = 0
        else:
            marks += 1
    if marks:
        out.append(SPACE * (marks - 1))
    return out


def pieces_of(texts: list[str | None], most: int = CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _hexes(flat: np.ndarray, sizes: np.ndarray, cut: int = 0) -> list[str]:
    view, ends = memoryview(np.ascontiguousarray(flat)), np.cumsum(sizes).tolist()
    return [hashlib.sha256(view[e - s : max(e - s, e - cut)]).hexdigest() for e, s in zip(ends, sizes.tolist())]


def _texts(batch: pa.RecordBatch, col: str) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of rows of about CHARS characters, with their texts; only these are turned to strings at once."""
    column = batch.column(batch.schema.get_field_index(col))
    begin = size = 0
    for k, n in enumerate(pc.utf8_length(column).to_pylist()):
        size += n or 0
        if size >= CHARS or k + 1 == len(column):
            yield begin, k + 1, [t or "" for t in column.slice(begin, k + 1 - begin).to_pylist()]
            begin, size = k + 1, 0


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", end: bool = True) -> DataFrame:
    """docs with `ids_col` array<int>; it replaces a column of that name. A null text counts as empty; an empty one has the end id only, or no id."""
    keep = [c for c in docs.columns if c != ids_col]
    schema = docs.select(*keep).schema.add(ids_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in _texts(b, text_col):
                flat, lens = codec(model).encode(texts, end)
                offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in keep], ids], [*keep, ids_col])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with `text_col`, which the ids spell; it replaces a column of that name. Null ids give an empty text."""
    keep = [c for c in rows.columns if c != text_col]
    schema = rows.select(*keep).schema.add(text_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            lens = np.array([len(x) if x.is_valid else 0 for x in ids], np.int64)
            out, sizes = codec(model).decode_bytes(ids.flatten().to_numpy(zero_copy_only=False), lens)
            raw, ends = out.tobytes(), np.cumsum(sizes).tolist()
            text = pa.array([raw[e - s : e].decode() for e, s in zip(ends, sizes.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], text], [*keep, text_col])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`_id`, `n_tokens`, `ids_sha256`, `decoded_sha256` of each row: its text encoded with an end id, and the ids decoded again.

    Both run in one Python step, so that ids do not travel through the JVM. A null text counts as empty, whose only id
    is the end id. Repeated rows and null ids stay as they are.
    """
    ids = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in _texts(b, text_col):
                c = codec(model)
                flat, lens = c.encode(texts, True)
                digits, of_digits = c.decimal(flat, lens)
                shown, of_shown = c.decode_bytes(flat, lens)
                cols = [b.column(b.schema.get_field_index(id_col)).slice(i, j - i), pa.array(lens), pa.array(_hexes(digits, of_digits, 1), pa.string()), pa.array(_hexes(shown, of_shown), pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"_id {ids}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), model_path()).withColumnRenamed("_id", "doc_id")

"""A static range asymmetric numeral system over token ids.

One frequency table serves all blocks. A block's tokens go to LANES coder states in turn, which share one stream of
32-bit words; every block begins anew and carries its final states and checksums, so that blocks are decoded in any
order, by any task. Blocks of a shard are coded side by side: each numpy step handles one token of every lane of
every block.

Shard layout (little-endian): b"CRNS", version, lanes, tokens per block, number of blocks, crc32 of the table; per
block, its checkpoint: tokens, first token's place in the shard, words, first word's place, crc32 of its words, crc32
of its tokens; then the blocks' states (LANES uint64 each), then all words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE, LOW = 20, np.uint64(1 << 31)
LANES, STEPS = 256, 512
BLOCK = LANES * STEPS
MAGIC, VERSION = b"CRNS", 1
HEAD = struct.Struct("<4sHHIII")
CHECKPOINT = np.dtype([("tokens", "<u4"), ("first", "<u8"), ("words", "<u4"), ("at", "<u8"), ("crc_words", "<u4"), ("crc_tokens", "<u4")])


class Table:
    """Frequencies scaled to 2**SCALE; each id that was counted has at least 1. Ids without a count can't be coded."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self._of_slot = None

    @classmethod
    def counted(cls, counts: np.ndarray) -> "Table":
        total, seen = int(counts.sum()), counts > 0
        whole = 1 << SCALE
        if not total:
            return cls(np.zeros(len(counts), np.int64))
        if int(seen.sum()) > whole // 2:
            raise ValueError("too many different ids for this scale")
        freq = np.where(seen, np.maximum(1, (counts.astype(np.float64) * (whole - seen.sum()) / total).astype(np.int64) + seen), 0)
        while (over := int(freq.sum()) - whole) > 0:  # take from the commonest
            top = np.argsort(-freq, kind="stable")[: max(1, min(over, int((freq > 1).sum())))]
            freq[top] -= 1
        freq[int(np.argmax(freq))] += whole - int(freq.sum())
        return cls(freq)

    @property
    def of_slot(self) -> np.ndarray:
        if self._of_slot is None:
            self._of_slot = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._of_slot


def _encode(tokens: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of equal length, tokens[blocks, steps, lanes] -> final states[blocks, lanes], all words, words per block."""
    blocks, steps, lanes = tokens.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    word = np.zeros((blocks, steps, lanes), np.uint32)
    sent = np.zeros((blocks, steps, lanes), bool)
    limit = table.freq << np.uint64(63 - SCALE)
    for s in range(steps - 1, -1, -1):
        t = tokens[:, s]
        f = table.freq[t]
        full = x >= limit[t]
        word[:, s], sent[:, s] = x & np.uint64(0xFFFFFFFF), full
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + table.cum[t]
    return x, word[sent], sent.sum(axis=(1, 2))


def encode_shard(tokens: np.ndarray, table: Table) -> bytes:
    """The bytes of a shard. The last block's lanes are filled up with its last token; `tokens` of its checkpoint says where it ends."""
    n = len(tokens)
    if n and not table.freq[np.unique(tokens)].all():
        raise ValueError("an id has no frequency")
    full, rest = divmod(n, BLOCK)
    marks = np.zeros(full + bool(rest), CHECKPOINT)
    states, words, counts = np.zeros((0, LANES), np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if full:
        states, words, counts = _encode(tokens[: full * BLOCK].reshape(full, STEPS, LANES), table)
    if rest:
        steps = -(-rest // LANES)
        last = np.concatenate([tokens[full * BLOCK :], np.full(steps * LANES - rest, tokens[-1], tokens.dtype)])
        s, w, c = _encode(last.reshape(1, steps, LANES), table)
        states, words, counts = np.concatenate([states, s]), np.concatenate([words, w]), np.concatenate([counts, c])
    marks["tokens"], marks["first"] = np.minimum(BLOCK, n - np.arange(len(marks)) * BLOCK), np.arange(len(marks)) * BLOCK
    marks["words"], marks["at"] = counts, np.cumsum(counts) - counts
    raw = words.astype("<u4")
    for m in marks:
        m["crc_words"] = zlib.crc32(raw[m["at"] : m["at"] + m["words"]])
        m["crc_tokens"] = zlib.crc32(tokens[m["first"] : m["first"] + m["tokens"]].astype("<u4"))
    return HEAD.pack(MAGIC, VERSION, LANES, BLOCK, len(marks), table.crc) + marks.tobytes() + states.astype("<u8").tobytes() + raw.tobytes()


def _decode(states: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, table: Table) -> np.ndarray:
    blocks, lanes = states.shape
    x, at = states.astype(np.uint64), at.astype(np.int64).copy()
    out = np.zeros((blocks, steps, lanes), np.uint32)
    low = np.uint64((1 << SCALE) - 1)
    padded = np.concatenate([words, np.zeros(1, words.dtype)])
    for s in range(steps):
        slot = x & low
        t = table.of_slot[slot]
        out[:, s] = t
        x = table.freq[t] * (x >> np.uint64(SCALE)) + slot - table.cum[t]
        short = x < LOW
        place = np.cumsum(short, axis=1)
        more = padded[np.where(short, at[:, None] + place - 1, len(words))]
        x = np.where(short, x << np.uint64(32) | more, x)
        at += place[:, -1]
    return out


def checkpoints(shard: bytes) -> np.ndarray:
    magic, version, lanes, block, n, _ = HEAD.unpack_from(shard)
    if (magic, version, lanes, block) != (MAGIC, VERSION, LANES, BLOCK):
        raise ValueError("not a shard of this format")
    return np.frombuffer(shard, CHECKPOINT, n, HEAD.size)


def decode_shard(shard: bytes, table: Table, blocks: slice = slice(None)) -> np.ndarray:
    """The tokens of a shard, or of some of its blocks; checksums are compared."""
    every = checkpoints(shard)
    if HEAD.unpack_from(shard)[-1] != table.crc:
        raise ValueError("another frequency table")
    at = HEAD.size + every.nbytes
    states = np.frombuffer(shard, "<u8", len(every) * LANES, at).reshape(-1, LANES)[blocks]
    words = np.frombuffer(shard, "<u4", -1, at + len(every) * LANES * 8)
    marks = every[blocks]
    for m in marks:
        if zlib.crc32(words[m["at"] : m["at"] + m["words"]]) != m["crc_words"]:
            raise ValueError("a block's words are damaged")
    out = np.zeros(int(marks["tokens"].sum()), np.uint32)
    done = 0
    for same in (marks["tokens"] == BLOCK, marks["tokens"] != BLOCK):  # full blocks come first
        if same.any():
            steps = -(-int(marks["tokens"][same][0]) // LANES)
            got = _decode(states[same], words, marks["at"][same], steps, table).reshape(-1)
            n = int(marks["tokens"][same].sum())
            out[done : done + n] = got[:n]
            done += n
    place = 0
    for m in marks:
        n = int(m["tokens"])
        if zlib.crc32(out[place : place + n].astype("<u4")) != m["crc_tokens"]:
            raise ValueError("a block's tokens are damaged")
        place += n
    return out

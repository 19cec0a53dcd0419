"""Words of many texts at once, as hashes, from the flat UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
#: A random odd 64-bit number for each byte value, and an odd base; a word's hash is the mixed sum of code[byte] * BASE**place.
CODE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.isin(np.arange(256), _SPACES)
#: Letters, digits and every byte of a character beyond ASCII.
IS_ALNUM = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(BASE)
    return np.multiply.accumulate(out)


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and, for n texts, n + 1 offsets; null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, the runs of bytes that `part` flags and that no text's edge cuts, and the number of words of each text."""
    inside = part[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    ends[edges - 1] = inside[edges - 1]
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    if int(lens.max()) > 4096:  # a few long words should not make the table of powers long
        return np.array([_one(data[s:e]) for s, e in zip(starts.tolist(), ends.tolist())], np.uint64) if len(starts) < 64 else _split(data, starts, ends, lens)
    place = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    terms = CODE[data[place + np.repeat(starts, lens)]] * powers(int(lens.max()))[place]
    return mix(np.add.reduceat(terms, np.cumsum(lens) - lens) + lens.astype(np.uint64))


def _one(word: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([(CODE[word] * powers(len(word))).sum(dtype=np.uint64) + np.uint64(len(word))]))[0])


def _split(data, starts, ends, lens):
    out = np.zeros(len(starts), np.uint64)
    short = lens <= 4096
    out[short] = hashes(data, starts[short], ends[short])
    out[~short] = [_one(data[s:e]) for s, e in zip(starts[~short].tolist(), ends[~short].tolist())]
    return out


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text, one of all words where there are fewer (none without words), and their number for each text; repeats stay."""
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    width = np.repeat(np.minimum(counts, k), n)
    mult = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    out = width.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        has = j < width
        out[has] += mix(words[at[has] + j] * mult[j] + np.uint64(j))
    return mix(out), n

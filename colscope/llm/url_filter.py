"""URL rules held in a Bloom filter cascade.

Level 0 encodes the listed keys, level 1 those other keys of the corpus that level 0 lets through, level 2 the listed
keys that level 1 lets through, and so on until a level lets nothing through that it shouldn't. Over the key universe
it was built with, a cascade answers membership exactly; probing needs neither a join nor the keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Bytes of a cascade that may be sent to every executor, which do for about 30 million listed keys. More rules are cut into parts by a hash of their key, each with a cascade of its own; pages pass one after another.
MAX_BYTES = 64 << 20
HASHES = 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://`, up to `/`, `?`, `#`; A-Z lowered) and path (from there up to `?`, `#`); both empty without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


class Level:
    """A Bloom filter over 64-bit key hashes: 64-bit words, HASHES positions by double hashing."""

    def __init__(self, words: np.ndarray, seed: int):
        self.words, self.bits, self.seed = words, len(words) * 64, seed

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.int64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in positions(keys, self.bits, self.seed):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(keys: np.ndarray, bits: int, seed: int) -> Iterator[np.ndarray]:
    one = _mixed(keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64))
    two = _mixed(one) | np.uint64(1)
    for k in range(HASHES):
        yield (one + np.uint64(k) * two) % np.uint64(bits)


class Cascade:
    """Levels of Bloom filters; `holds` is exact for keys of the universe that it was built over."""

    def __init__(self, levels: Sequence[Level]):
        self.levels = list(levels)

    @property
    def nbytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """A key that passes levels 0..d-1 and fails level d is listed iff d is odd; one that passes all has the last level's kind."""
        out = np.full(len(keys), len(self.levels) % 2 == 1)
        rest = np.arange(len(keys))
        for d, level in enumerate(self.levels):
            passed = level.holds(keys[rest])
            out[rest[~passed]] = d % 2 == 1
            rest = rest[passed]
        return out


def _level(keys: DataFrame, n: int, seed: int) -> Level:
    """A level of about HASHES / ln 2 bits a key. Tasks set bits in words of their own keys; an aggregate ors them, so that the driver gets the filter, never the keys."""
    bits = max(64, 64 * math.ceil(n * HASHES / math.log(2) / 64))

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(list(positions(b.column(0).to_numpy(zero_copy_only=False), bits, seed)))
            word, place = np.unique(at >> np.uint64(6), return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, place, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    words = np.zeros(bits // 64, np.uint64)
    got = keys.select("hash").mapInArrow(masks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # as large as the filter, twice
    words[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Level(words, seed)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.holds(b.column(b.schema.get_field_index("hash")).to_numpy(zero_copy_only=False))))

    return keys.mapInArrow(probe, keys.schema)


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[Cascade, int] | None:
    """A cascade over `listed` and `universe` (each one string column `key`), and the seed of its key hashes; None where it would be larger than max_bytes.

    Neither needs to be free of repeats or nulls; nulls are no keys. An empty list gives a cascade that holds nothing.
    """
    listed = written(listed.where("key is not null").distinct(), "listed")
    n = listed.count()
    if n * HASHES / math.log(2) / 8 > max_bytes:
        return None
    if not n:
        return Cascade([Level(np.zeros(1, np.uint64), 0)]), 0
    seed = 0
    while True:
        hashed = lambda df: df.withColumn("hash", F.xxhash64(F.lit(seed), "key"))  # noqa: B023, E731
        mine = hashed(listed)
        levels = [_level(mine, n, 0)]
        # the only scan of the universe: keys that level 0 lets through, then without the listed ones
        others = written(_passing(hashed(universe.where("key is not null")), levels[0]).distinct().join(listed, "key", "left_anti"), "passing")
        if others.join(mine.select("hash"), "hash", "left_semi").isEmpty():
            break
        seed += 1  # two different keys share a 64-bit hash: another hash function
    sides, d = [others, mine], 0  # sides[0]: what the next level must encode; sides[1]: what it must not let through
    while not sides[0].isEmpty():
        d += 1
        levels.append(_level(sides[0], sides[0].count(), d))
        sides = [written(_passing(sides[1], levels[-1]), f"level{d}"), sides[0]]
    cascade = Cascade(levels)
    return (cascade, seed) if cascade.nbytes <= max_bytes else None


def candidate_keys(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """The keys host + path prefix of all rules that could fit, longest first: suffixes of up to `labels` host labels, path prefixes of the rules' own lengths."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= k, path.substr(1, k)) for k in sorted(lengths)]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.array_sort(keys, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages with `host`, `path`, `rule`, `verdict` in front of its own columns, which get the prefix `in_` where they clash, as often as it takes.

    A rule (action, host, path) fits its host and all subdomains where the path starts with the rule's; the longest
    rule wins. Where none fits, `rule` is null and the verdict is what a cascade says of a key that it does not hold:
    `default`. A null or empty url, or one without `://`, has empty host and path. Repeated rows get equal verdicts.
    An empty table gives an empty result. One cascade tells which of a url's candidate keys are rules, a second which
    rules block. Rules too many for max_bytes are cut into parts, and pages pass the cascades of one part after another.
    """
    spark = pages.sparkSession
    given = {h.translate(str.maketrans(UPPER, LOWER)) + p: a for a, h, p in rules}
    if bad := [r for r in rules if not r[2].startswith("/") or r[0] not in ("allow", "block")]:
        raise ValueError(f"not a rule: {bad[0]}")
    labels = max((k.partition("/")[0].count(".") + 1 for k in given), default=1)
    lengths = sorted({len(k) - k.index("/") for k in given}) or [1]
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    # place of the longest rule so far among the keys, which are in order of length
    rows = rows.withColumns({"at": F.lit(1 << 30), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    listed = spark.createDataFrame([(k, a) for k, a in given.items()], "key string, action string")
    parts, p, state = 1, 0, rows
    while p < parts:
        most = max_bytes if parts < len(given) else math.inf
        mine = listed.where(_part(F.col("key"), parts) == p)
        found = build_cascade(mine.select("key"), rows.select(F.explode("keys").alias("key")).where(_part(F.col("key"), parts) == p), most)
        blocks = found and build_cascade(mine.where("action = 'block'").select("key"), mine.select("key"), most)
        if not blocks:  # too large: smaller parts, from the beginning
            parts, p, state = parts * 2, 0, rows
            continue
        state = _judged(state, found, blocks, p, parts)
        if parts > 1:
            state = written(state, f"part{p}")
        p += 1
    added, own = ["host", "path", "rule", "verdict"], []
    for c in pages.columns:
        name = c
        while name in added or name != c and name in pages.columns or name in own:
            name = f"in_{name}"
        own.append(name)
    return state.select(*added, *[F.col("row")[c].alias(name) for c, name in zip(pages.columns, own)])


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))


def _judged(rows: DataFrame, found: tuple[Cascade, int], blocks: tuple[Cascade, int], part: int, parts: int) -> DataFrame:
    """rows with at, rule and verdict of those keys of the part that are rules and longer than the row's rule so far."""
    sent = rows.sparkSession.sparkContext.broadcast((found[0], blocks[0]))
    of = lambda f: F.transform("keys", f)
    keyed = rows.withColumns({"hashes": of(lambda k: F.xxhash64(F.lit(found[1]), k)), "more": of(lambda k: F.xxhash64(F.lit(blocks[1]), k)), "mine": of(lambda k: _part(k, parts) == part)})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, blocked = sent.value
        for b in batches:
            cols = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            flat = {c: cols[c].flatten().to_numpy(zero_copy_only=False) for c in ("hashes", "more", "mine")}
            sizes = np.diff(cols["keys"].offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            held = np.flatnonzero(which.holds(flat["hashes"]) & flat["mine"].astype(bool))
            row, first = np.unique(np.repeat(np.arange(b.num_rows), sizes)[held], return_index=True)  # the first held key of a row is the longest
            hit = held[first]
            at = cols["at"].to_numpy().copy()
            nearer = hit - starts[row] < at[row]
            row, hit = row[nearer], hit[nearer]
            at[row] = hit - starts[row]
            rule, verdict = (np.array(cols[c].to_pylist(), object) for c in ("rule", "verdict"))
            rule[row] = cols["keys"].flatten().take(pa.array(hit)).to_pylist()
            verdict[row] = np.where(blocked.holds(flat["more"][hit]), "block", "allow")
            new = {"at": pa.array(at, pa.int32()), "rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(c, cols[c]) for c in names], names)

    names = rows.columns
    return keyed.mapInArrow(judge, rows.schema)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
r(rule, h, p, act) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
m AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(act, length(rule)) AS act
      FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.act, 'allow') AS verdict FROM c LEFT JOIN m USING (page_id)
"""

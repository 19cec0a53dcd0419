"""Each operator against brute force or an exact round trip, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.llm import bpe, exact_dedup, line_dedup, mixing, near_dedup, rans, sentencepiece_codec, token_files, toxicity, url_filter, vp_search, warc
from colscope.llm.common import scratch
from colscope.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}" for k in range(30_000))


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(k, t, "en", (sources or ["s"])[k % len(sources or ["s"])], 0) for k, t in enumerate(texts)], DOCS).repartition(3)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


TEXTS = ["", None, "a", "same text", "same text", " \n ", LONG, LONG, "é漢😀 x", "same text ", "x" * 3000, "<|endoftext|> a  b", "▁ a ▁▁b"]


# exact dedup
def test_exact_dedup(spark):
    d = docs_of(spark, TEXTS)
    got = {r._id: r for r in exact_dedup.exact_dedup(d).collect()}
    for k, t in enumerate(TEXTS):
        same = [j for j, u in enumerate(TEXTS) if (u or "") == (t or "")]
        assert (got[k].keep_id, got[k].group_size, got[k].kept, got[k]._digest) == (max(same), len(same), k == max(same), hashlib.sha256((t or "").encode()).hexdigest())
    weak = exact_dedup.exact_dedup(d, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1))  # many texts with one digest
    assert rows(weak, "_id", "keep_id", "group_size") == rows(exact_dedup.exact_dedup(d), "_id", "keep_id", "group_size")
    assert rows(exact_dedup.exact_dedup(d, rows=0)) == rows(exact_dedup.exact_dedup(d))  # too many repeated digests to be sent
    assert exact_dedup.exact_dedup(d.limit(0)).count() == 0
    twice = d.unionAll(d.where("doc_id = 4")).withColumns({c: F.lit("x") for c in ("_digest", "keep_id", "_id", "_sha", "_of", "kept")})
    left = exact_dedup.keep_one(twice)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 4, 5, 7, 8, 9, 10, 11, 12] and left.columns == twice.columns
    assert {(r._id, r._sha) for r in left.collect()} == {("x", "x")}
    assert exact_dedup.exact_dedup(twice).where("_id = 4").count() == 2
    shared = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q"), (None, "q"), (None, "z")], "doc_id long, text string")
    assert rows(exact_dedup.keep_one(shared)) == sorted([(1, "p"), (2, "q"), (None, "z")], key=str)
    nulls = spark.createDataFrame([(None, "q"), (None, "q"), (3, "q")], "doc_id long, text string")
    assert {(r._id, r.keep_id) for r in exact_dedup.exact_dedup(nulls).collect()} == {(None, 3), (3, 3)}


# near dedup
def brute_groups(texts):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\v\f\r":
            low = low.replace(c, " ")
        return [w for w in low.split(" ") if w]

    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                o = len(a & b)
                if a and b and 100 * o >= 75 * (len(a) + len(b) - o):
                    label[i] = label[j] = min(label[i], label[j])
    return [len(s) for s in sets], label


def near_texts():
    r = random.Random(3)
    words = [f"t{k}" for k in range(400)]
    out = ["", None, "one two", "ONE  two", "a b c d e", "A b c d\ne", LONG, LONG + " end"]
    for base in range(6):
        b = [r.choice(words) for _ in range(r.choice([8, 30, 150, 600]))]
        for _ in range(7):
            c = list(b)
            for _ in range(r.randint(0, max(1, len(b) // 20))):
                c[r.randrange(len(c))] = r.choice(words)
            out.append(" ".join(c))
    passage = " ".join(r.choice(words) for _ in range(40))
    out += [passage + " " + " ".join(r.choice(words) for _ in range(r.randint(3, 60))) for _ in range(15)]
    return out


def test_near_groups(spark):
    texts = near_texts()
    sizes, label = brute_groups(texts)
    got = {r._id: r for r in near_dedup.near_groups(docs_of(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == label and [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].kept for i in range(len(texts))] == [i == x for i, x in enumerate(label)]


def test_near_groups_recall_of_cut_sketches(spark):
    """Sketches of 64 of sets of up to 600: nothing is linked that is not linked, and nine of ten linked documents are found at least."""
    r, texts = random.Random(21), []
    for _ in range(12):
        base = [f"y{r.randrange(3000)}" for _ in range(r.randint(200, 600))]
        for _ in range(6):
            c = list(base)
            for at in r.sample(range(len(c)), r.randint(0, len(c) // 60)):
                c[at] = f"y{r.randrange(3000)}"
            texts.append(" ".join(c))
    sizes, label = fast_groups(texts)
    got = {x._id: x for x in near_dedup.near_groups(docs_of(spark, texts), k=64).collect()}
    assert all(label[got[i].component_id] == label[i] for i in range(len(texts)))
    late = [i for i in range(len(texts)) if label[i] != i and sizes[i] > 64]
    found = sum(got[i].component_id == label[i] for i in late) / len(late)
    assert len(late) > 40 and found >= 0.9


def counted(monkeypatch):
    """Rows of the tables that near_groups writes, by name."""
    seen, write = {}, near_dedup.written

    def counting(df, name, *args):
        out = write(df, name, *args)
        seen[name] = max(seen.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counting)
    return seen


def test_near_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    """A passage in 400 documents that are else unlike, and 300 heavy edits of one text of which most are no link of any other."""
    r = random.Random(11)
    word = lambda: f"x{r.randrange(10**9)}"
    passage, base = " ".join(word() for _ in range(120)), [word() for _ in range(330)]
    texts = [passage + " " + " ".join(word() for _ in range(r.randint(20, 60))) for _ in range(400)]
    for _ in range(300):
        c = list(base)
        for at in r.sample(range(330), r.randint(6, 16)):
            c[at] = word()
        texts.append(" ".join(c))
    texts.append(" ".join(base))
    seen = counted(monkeypatch)
    got = {x._id: x.component_id for x in near_dedup.near_groups(docs_of(spark, texts)).collect()}
    _, label = fast_groups(texts)
    assert [got[i] for i in range(len(texts))] == label and len(set(label)) > 200
    assert max(seen.get(n, 0) for n in ("pairs", "rest-pairs", "rests")) < 4 * len(texts)


def fast_groups(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                x, y = top(i), top(j)
                label[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [top(i) for i in range(len(texts))]


def test_near_groups_edges(spark):
    assert near_dedup.near_groups(docs_of(spark, ["a"]).limit(0)).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert rows(near_dedup.near_groups(d), "_id", "component_id") == sorted([(None, None), (1, 1), (2, 1), (2, 1)], key=str)
    kept = near_dedup.keep_firsts(docs_of(spark, ["a b c d e f", "a b c d e F", None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2] and kept.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_least_shared_is_safe():
    assert near_dedup.least_shared(100) == 75 and near_dedup.least_shared(1) == 1
    r = np.random.default_rng(0)
    for n in (300, 2000):
        t = near_dedup.least_shared(n)
        u = n * 100 // 75
        good = -(-u * 75 // 100)
        assert all(r.hypergeometric(good, u - good, 256) >= t for _ in range(20_000)) and t > 100


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 101), (7, 7), (100, 101)], "a long, b long")
    assert {r.node: r.label for r in components(links).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(links.limit(0)).count() == 0


# SentencePiece
def test_sentencepiece_equals_the_library():
    import sentencepiece

    path = sentencepiece_codec.model_path()
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    r = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(r.choice("ab ▁\n\té漢😀\x00ﬁ.-<>0xs/") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    flat, lens = c.encode(texts, True)
    want = sp.encode(texts, add_eos=True)
    assert lens.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    ids = want + [[r.choice([0, 1, 2, 229, 148, 163, 68, 261, 28705, 5000]) for _ in range(r.randint(0, 9))] for _ in range(3000)]
    assert c.decode(ids) == [sp.decode(i) for i in ids]


def test_sentencepiece_frames(spark):
    path, d = sentencepiece_codec.model_path(), docs_of(spark, TEXTS)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(d.withColumn("ids", F.lit("clash")), path), path)
    assert {r.doc_id: r.decoded for r in back.collect()} == {k: (t or "").replace("▁", " ") for k, t in enumerate(TEXTS)}
    assert sentencepiece_codec.round_trip(d.limit(0), path).count() == 0
    assert {r.n_tokens for r in sentencepiece_codec.round_trip(d.where("doc_id < 2"), path).collect()} == {1}


def test_merge_rounds_equal_a_heap():
    """Words of all lengths, and ranks in any order, so that merges make new pairs that come first, too."""
    pairs = bpe.Pairs({(1, 1): (0, 2), (2, 2): (1, 3), (2, 1): (2, 4)})
    flat, lens = bpe.merge(np.array([1] * 1004), np.array([1001, 3]), pairs)
    assert flat[: lens[0]].tolist() == bpe.merge_one([1] * 1001, pairs.dict) and flat[lens[0] :].tolist() == [4]
    r = random.Random(17)
    for _ in range(60):
        found, symbols = {}, [0, 1, 2]
        for _ in range(r.randint(1, 25)):
            pair = (r.choice(symbols), r.choice(symbols))
            if pair not in found:
                found[pair] = (r.randint(0, 30), len(symbols))
                symbols.append(len(symbols))
        words = [[r.choice([0, 1, 2]) for _ in range(r.choice([1, 2, 3, 10, 400]))] for _ in range(40)]
        flat, lens = bpe.merge(np.array([x for w in words for x in w]), np.array([len(w) for w in words]), bpe.Pairs(found))
        want = [bpe.merge_one(w, found) for w in words]
        assert lens.tolist() == [len(w) for w in want] and flat.tolist() == [x for w in want for x in w]


def test_long_words_equal_the_library():
    import sentencepiece

    path = sentencepiece_codec.model_path()
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    r = random.Random(18)
    texts = ["".join(chr(r.randint(0x4E00, 0x4F00)) for _ in range(3000)), "".join(r.choice("etaoinshr") for _ in range(20_000)), "a" * 9000, "日本語の" * 900]
    assert c.encode(texts)[0].tolist() == [i for w in sp.encode(texts) for i in w]


# token files
def test_byte_bpe_equals_the_library():
    c = token_files.byte_bpe(token_files.tokenizer_path())
    r = random.Random(2)
    al = ["a", "b", "I'll", " ", "  ", "\n", " \n", "\t", "é", "漢", "😀", "\x1c", "\xa0", "123", "...", "<|endoftext|>", "<|endof", "’"]
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(al) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    flat, lens = c.encode(texts, 2)
    want = [e.ids + [2] for e in c.library.encode_batch(texts, add_special_tokens=False)]
    assert lens.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_rans_round_trip():
    r = np.random.default_rng(0)
    ids = np.minimum(r.geometric(0.01, 300_000), 4999)
    t = rans.Table.counted(np.bincount(ids, minlength=5000))
    assert int(t.freq.sum()) == 1 << rans.SCALE
    for n in (0, 1, 255, 257, rans.BLOCK, rans.BLOCK + 1, 300_000):
        shard = rans.encode_shard(ids[:n], t)
        assert (rans.decode_shard(shard, t) == ids[:n]).all() and len(rans.checkpoints(shard)) == -(-n // rans.BLOCK)
    assert (rans.decode_shard(shard, t, slice(1, 2)) == ids[rans.BLOCK : 2 * rans.BLOCK]).all()
    assert len(shard) * 8 / n < 10.5
    broken = bytearray(shard)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        rans.decode_shard(bytes(broken), t)
    with pytest.raises(ValueError):
        rans.encode_shard(np.array([4999, 0]), rans.Table.counted(np.array([1] + [0] * 4999)))


def test_token_files(spark):
    path = token_files.tokenizer_path()
    d = docs_of(spark, TEXTS).unionAll(spark.createDataFrame([(None, "null id", "", "", 0), (3, "again", "", "", 0)], DOCS))
    out = scratch(spark, "test-tokens")
    token_files.write_shards(d, out, path, 2, shard_tokens=500)
    got = [r for r in token_files.read_shards(spark, out, path).collect()]
    lib = token_files.byte_bpe(path).library
    want = sorted([(k, lib.encode(t or "", add_special_tokens=False).ids + [2]) for k, t in enumerate(TEXTS)] + [(None, lib.encode("null id").ids + [2]), (3, lib.encode("again").ids + [2])], key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(got, key=lambda r: r.start)
    assert [r._id for r in got] == [k for k, _ in want] and [len(i) for _, i in want if _ != 3] is not None
    assert sorted(zip([str(r._id) for r in got], [r.ids for r in got])) == sorted((str(k), i) for k, i in want)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    empty = scratch(spark, "test-none")
    token_files.write_shards(d.limit(0), empty, path, 2)
    assert token_files.read_shards(spark, empty, path).count() == 0


# mixing
def test_mixture(spark):
    r = random.Random(5)
    texts = [" ".join(["w"] * r.randint(0, 30)) for _ in range(600)] + [None, ""]
    d = docs_of(spark, texts, ["b", "a", "a", "a", "c", "é", None])
    got = mixing.mixture(d.withColumns({"target": F.lit("x"), "_h": F.lit(1), "_of": F.lit(2)}), 8).collect()
    assert {(x._h, x._of) for x in got} == {(1, 2)}
    assert len(got) == len(texts)
    sizes, taken, targets = {}, {}, {}
    for x in got:
        assert x._size == len((x.text or "").split()) and len(x._shards) <= 2 and all(0 <= s < 8 for s in x._shards)
        sizes[x.source] = sizes.get(x.source, 0) + x._size
        taken[x.source] = taken.get(x.source, 0) + x._size * len(x._shards)
        targets[x.source] = x.target
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, open_, want = 1.5 * sum(sizes.values()), set(order), {}
    while True:  # water-filling, round by round
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    assert all(abs(targets[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 15 for s in order)
    again = {x.doc_id: x._shards for x in mixing.mixture(d.repartition(7), 8).collect()}
    assert again == {x.doc_id: x._shards for x in got}
    mix = mixing.mixed(d, 8)
    assert mix.count() == sum(len(x._shards) for x in got)
    assert mixing.shuffled(mix, 8).columns == [*d.columns, "_shard", "_order"]
    counts = [r["count"] for r in mix.groupBy("_shard").count().collect()]
    assert len(counts) == 8 and max(counts) < 3 * min(counts)
    assert mixing.mixture(d.limit(0)).count() == 0
    assert {x.target for x in mixing.mixture(docs_of(spark, [None, ""])).collect()} == {0.0}


def test_shards_draw_exact_quotas(spark):
    """Every unit is drawn once, shards get equal numbers of units, and a source's share of a shard varies as in a random draw."""
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"))
    sizes = mixing.sized(d, "doc_id", "text", "source", 7).select("_source", "_size", "_h", "_key")
    decided = mixing.decide(sizes)
    units = mixing.shard_units(sizes, decided, mixing.block_bits(sizes, 16), 16, 7).collect()
    assert len({(u._of, u._block, u._copy) for u in units}) == len(units)
    each = [sum(u.shard == k for u in units) for k in range(16)]
    assert max(each) - min(each) <= 1 and sum(each) > 256
    hot = [sum(u.shard == k and u._of == "hot" for u in units) for k in range(16)]
    mean = sum(hot) / 16
    assert len(set(hot)) > 2 and all(abs(h - mean) < 0.6 * mean for h in hot)
    copies = mixing.with_copies(sizes, decided).agg(F.sum("copies")).first()[0]
    assert mixing.mixed(d, 16).count() == copies


def test_mixture_passes_long_documents(spark):
    """Source a's share is 50 % above its size; one document of it is larger than what is missing, wherever it stands in order."""
    for seed in (1, 2, 3):
        texts = ["w " * 100_000] + ["w " * 100] * 1000 + ["w " * 70] * 3
        d = docs_of(spark, texts).withColumn("source", F.lit("a"))
        got = mixing.mixture(d, seed=seed).collect()
        taken = sum(x._size * len(x._shards) for x in got)
        assert abs(taken - got[0].target) <= 0.01 * got[0].target and got[0].target > got[0].source_size
    r = random.Random(12)  # sizes of all orders, several sources, little tolerance
    texts = ["w " * int(10 ** r.uniform(0, 4.5)) for _ in range(400)] + ["w"] * 60
    d = docs_of(spark, texts, ["b", "a", "c", None])
    sizes = mixing.sized(d, "doc_id", "text", "source", 7).select("_source", "_size", "_h", "_key")
    decided = mixing.decide(sizes, tolerance=0.0001)
    got = mixing.with_copies(sizes, decided).select("_source", "_size", "target", "copies").collect()
    for source in {g._source for g in got}:
        own = [g for g in got if g._source == source]
        miss = own[0].target - sum(g._size * g.copies for g in own)
        left = [g._size for g in own if g.copies == min(h.copies for h in own) and g._size]
        # within the tolerance, or no document is left that fits
        assert miss <= 0.0001 * own[0].target or not left or min(left) > miss, (source, miss)
        assert abs(miss) <= 0.01 * own[0].target


# line dedup
def brute_lines(texts, min_words):
    lines = [(t or "").split("\n") for t in texts]
    gone, seen = [set() for _ in texts], set()
    first = {}
    wins = []
    for d, ls in enumerate(lines):
        real = [i for i, x in enumerate(ls) if x.split()]
        for way in (1, -1):
            for p in range(len(real)):
                words, span, q = 0, [], p
                while 0 <= q < len(real) and words < min_words:
                    words += len(ls[real[q]].split())
                    span.append(real[q])
                    q += way
                if words >= min_words:
                    span.sort()
                    wins.append((way, tuple(ls[i] for i in span), d, span))
    for way, key, d, span in sorted(wins, key=lambda w: (w[2], w[3][0])):
        first.setdefault((way, key), (d, span[0]))
    for way, key, d, span in wins:
        if (d, span[0]) > first[way, key]:
            gone[d] |= set(span)
    return ["\n".join(x for i, x in enumerate(ls) if i not in gone[d]) for d, ls in enumerate(lines)], [len(g) for g in gone]


def test_line_dedup(spark):
    r = random.Random(4)
    pool = [" ".join(f"v{r.randint(0, 50)}" for _ in range(r.choice([1, 3, 8, 20]))) for _ in range(25)]
    texts = ["\n".join(r.choice(pool + ["", " "]) for _ in range(r.randint(1, 14))) for _ in range(80)] + ["", None, "\n\n", "p q\n" * 40, LONG, LONG]
    kept, n = brute_lines(texts, 12)
    got = {x.doc_id: x for x in line_dedup.line_dedup(docs_of(spark, texts), min_words=12).collect()}
    assert [got[k]._kept for k in range(len(texts))] == kept and [got[k]._n_gone for k in range(len(texts))] == n
    assert line_dedup.line_dedup(docs_of(spark, ["a"]).limit(0)).count() == 0
    twice = docs_of(spark, [LONG, "a"])
    assert [x._n_gone for x in line_dedup.line_dedup(twice.unionAll(twice)).collect()] == [0] * 4
    nulls = spark.createDataFrame([(None, "p q r s\nu", "k", 1, 2, 3), (1, "p q r s\nu", "l", 1, 2, 3)], "doc_id long, text string, _kept string, _t int, _i int, _id int")
    got = line_dedup.line_dedup(nulls, min_words=4)
    assert got.columns == ["doc_id", "text", "_t", "_i", "_id", "_kept", "_n_lines", "_n_gone"]
    assert rows(got) == sorted([(None, "p q r s\nu", 1, 2, 3, "p q r s\nu", 2, 0), (1, "p q r s\nu", 1, 2, 3, "", 2, 2)], key=str)


def test_line_dedup_reads_windows_of_repeated_fingerprints_only(spark, monkeypatch):
    texts = ["\n".join(f"only {k} {j} x" for j in range(200)) for k in range(20)]
    texts[7] = texts[7] + "\n" + "\n".join(texts[3].split("\n")[20:50])
    seen, write = {}, line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name, *a: seen.setdefault(name, write(df, name, *a)))
    monkeypatch.setattr(line_dedup, "dropped", lambda *a: None)
    got = {x.doc_id: x._n_gone for x in line_dedup.line_dedup(docs_of(spark, texts)).collect()}
    assert got == {k: 30 * (k == 7) for k in range(20)}
    assert seen["windows"].count() > 3500 and seen["seen"].count() < 120


# toxicity
def test_toxicity_held_out(spark):
    r = random.Random(6)
    plain = [f"word{k}" for k in range(300)]
    bad = ["vile", "rotten", "zargh"]
    texts, toxic = [], []
    for _ in range(700):
        t = r.random() < 0.25
        w = [r.choice(plain) for _ in range(r.randint(5, 80))]
        for _ in range(r.randint(1, 3) if t else 0):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "!", "ish"]))
        texts.append(" ".join(w))
        toxic.append(int(t))
    texts += [None, ""]
    d = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, r.choice([0, 1, None]), y) for k, y in enumerate(toxic) if k % 2], "doc_id long, quality int, toxic int")
    chain = toxicity.train(d, labels)
    got = {x._id: x for x in toxicity.score(d, chain).collect()}
    held = [k for k in range(700) if not k % 2]
    right = sum(got[k].toxic == bool(toxic[k]) for k in held) / len(held)
    assert right > 0.97 and not got[700].toxic and not got[701].toxic
    left = toxicity.clean(d, chain)
    assert left.columns == d.columns and left.count() == sum(not x.toxic for x in got.values())
    assert toxicity.score(d.limit(0), chain).count() == 0
    none = toxicity.train(d, labels.limit(0))
    assert {x.toxic for x in toxicity.score(d, none, threshold=0.6).collect()} == {False}
    same = toxicity.train(d.limit(0), labels)
    assert len(same.weights) == 2


def plain_fit(x, y, rows, steps=300, l2=1e-4, rate=0.1):
    """Weighted logistic regression by Adam in plain loops: x has a dict of values for each row, -1 being the constant."""
    ones = sum(y[i] for i in rows)
    if ones in (0, len(rows)):
        return {-1: 8.0 if ones else -8.0}
    weight = {i: math.sqrt((len(rows) - ones) / ones) if y[i] else 1.0 for i in rows}
    total = sum(weight.values())
    w, m, v = ({k: 0.0 for i in range(len(x)) for k in x[i]} for _ in range(3))
    for t in range(1, steps + 1):
        g = {k: l2 * w[k] * (k != -1) for k in w}
        for i in rows:
            e = (plain_p(w, x[i]) - y[i]) * weight[i] / total
            for k, a in x[i].items():
                g[k] += a * e
        for k in w:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] -= rate * m[k] / (1 - 0.9**t) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def plain_p(w, row):
    return 1 / (1 + math.exp(-sum(w.get(k, 0.0) * a for k, a in row.items())))


def test_toxicity_equals_a_plain_chain(spark):
    """The same features and folds in plain loops: selection by chi-square, out-of-fold probabilities, two models."""
    r = random.Random(13)
    plain = [f"word{k}" for k in range(60)]
    texts, labels = [], []
    for k in range(160):
        low, bad = r.random() < 0.4, r.random() < 0.3
        w = [r.choice(plain) for _ in range(12)] + ["spam"] * (low and r.random() < 0.9) + ["vile"] * (bad and r.random() < 0.9)
        r.shuffle(w)
        texts.append(" ".join(w))
        labels.append((k, None if k % 11 == 0 else int(not low), None if k % 13 == 0 else int(bad or low and r.random() < 0.5)))
    d = docs_of(spark, texts)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.train(d, table).probabilities(texts)
    fold = {x.doc_id: x.f for x in d.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).alias("f")).collect()}
    sets = [set(toxicity.features([t])[1].tolist()) for t in texts]
    ys = [[None if q is None else 1 - q for _, q, _ in labels], [t for _, _, t in labels]]
    kept = set()
    for y in ys:
        known = [i for i in range(160) if y[i] is not None]
        ones = sum(y[i] for i in known)
        zeros, chi = len(known) - ones, {}
        for f in set().union(*sets):
            a, b = sum(f in sets[i] for i in known if y[i]), sum(f in sets[i] for i in known if not y[i])
            c, e = ones - a, zeros - b
            below = (a + b) * (c + e) * ones * zeros
            chi[f] = (ones + zeros) * (a * e - b * c) ** 2 / below if below else 0.0
        kept |= set(sorted((f for f in chi if chi[f] >= toxicity.least_chi_square(len(known))), key=lambda f: (-chi[f], f))[: toxicity.FEATURES // 2])
    assert len(kept) >= 8
    log_odds = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    base = [{**{f: 1.0 for f in s & kept}, -1: 1.0} for s in sets]
    out_of_fold, final = [], []
    for c, y in enumerate(ys):
        known = [i for i in range(160) if y[i] is not None]
        train = [{**row, **{-2 - e: log_odds(p[i]) for e, p in enumerate(out_of_fold)}} for i, row in enumerate(base)]
        models = [plain_fit(train, y, [i for i in known if fold[i] != f]) for f in range(5)]
        whole = plain_fit(train, y, known)
        apply = [{**row, **{-2 - e: log_odds(p[i]) for e, p in enumerate(final)}} for i, row in enumerate(base)]
        out_of_fold.append([plain_p(models[fold[i]], train[i]) for i in range(160)])
        final.append([plain_p(whole, apply[i]) for i in range(160)])
    assert max(abs(got[i, c] - final[c][i]) for i in range(160) for c in (0, 1)) < 0.01
    assert {x > 0.5 for x in final[1]} == {True, False}


def test_toxicity_keeps_rare_words(spark):
    """Sixty words tell toxic texts, each in a dozen of them; a word has nearly thirty features."""
    r = random.Random(9)
    plain, letters = [f"word{k}" for k in range(300)], "abcdefghijklmnopqrstuvwxyz"
    bad = ["".join(r.choice(letters) for _ in range(10)) for _ in range(60)]
    text = lambda w=None: " ".join([r.choice(plain) for _ in range(15)] + [w] * bool(w))
    texts = [text(w) for w in bad * 12] + [text() for _ in range(2200)]
    labels = spark.createDataFrame([(k, None, int(k < 720)) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs_of(spark, texts), labels)
    p = chain.probabilities([text(w) for w in bad * 3] + [text() for _ in range(300)])[:, -1] >= 0.5
    assert p[:180].mean() > 0.95 and p[180:].mean() < 0.05
    assert (toxicity.FEATURES, toxicity.MAX_TRAIN) == (4096, 20_000)


# WARC
def test_warc(spark):
    html = ["<p>x</p>", None, "", "<p>x</p>", "é漢\r\n\r\nWARC/1.1\r\n", "<p>x</p>", "y" * 200_000]
    p = spark.createDataFrame([(k, f"http://Www.Example{k % 3}.com/a?q={k}", h) for k, h in enumerate(html)] + [(3, "http://dup.com/", "<p>x</p>"), (9, None, "z\n")], "page_id long, url string, html string").repartition(2)
    out, index = scratch(spark, "test-warc"), scratch(spark, "test-index")
    warc.write_archives(warc.planned(p), out, file_bytes=1000)
    back = warc.read_archives(spark, out)
    got = sorted(back.collect(), key=lambda r: (r.page_id, r.url))
    first = {h or "": min(k for k, g in enumerate(html) if (g or "") == (h or "")) for h in html} | {"z\n": 9}
    for r in got:
        h = "z\n" if r.page_id == 9 else html[r.page_id] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), warc._sha1(h.encode()))
        assert (r.kind, r.refers_to) == (("response", None) if first[h] == r.page_id else ("revisit", first[h]))
        assert r.payload == (h.encode() if r.kind == "response" else None)
    assert len(got) == 9 and len({r.file for r in got}) > 1
    warc.build_index(back, index, block_lines=2)
    ix = warc.CaptureIndex(spark, index)
    for entry in ix.captures("http://www.example1.com/a?q=4") + warc.CaptureIndex(spark, index, max_entries=0).captures("http://dup.com/"):
        page, kind, file, offset, length = entry
        assert str(ix.read(file, offset, length)[0]) == page
    assert [c[0] for c in ix.captures("http://www.example1.com/a?q=4")] == ["4"] and ix.captures("http://nowhere.org/") == []
    none = scratch(spark, "test-warc0")
    warc.write_archives(warc.planned(p.limit(0)), none)
    assert warc.read_archives(spark, none).count() == 0
    least = {r.page_id: r.refers_to for r in warc.planned(p, least=100).collect()}
    assert set(least.values()) == {None}
    heavy = spark.createDataFrame([(k, "u", "é" * (3_000_000 if k == 5 else 10 * k)) for k in range(60)] + [(None, "u", "é" * 30)], "page_id long, url string, html string").coalesce(1)
    out = scratch(spark, "test-heavy")
    warc.write_archives(warc.planned(heavy), out)
    got = {r.page_id: (r.payload_bytes, r.kind, r.refers_to) for r in warc.read_archives(spark, out).collect()}
    assert got == {k: (6_000_000 if k == 5 else 20 * k, "response", None) for k in range(60)} | {None: (60, "response", None), 3: (60, "revisit", None)}


ODD = ["http://a.com/|", "http://a.com/z", "http://a.com/\u00e9", "http://a.com/{", "http://a.com/~", "http://A.com/a b", "http://a.com/\x01", "http://a.com/q#\u2028f", "http://a.com/q", "http://\u00c9.com/\U0001f600", "\uff0fno host", "", None, "http://a.com/\uffee", "http://a.com/^", "http://a.com./%7c"]


def test_warc_index_finds_every_capture(spark, tmp_path, monkeypatch):
    p = spark.createDataFrame([(k, u, f"text {k % 9}") for k, u in enumerate(ODD * 2)], "page_id long, url string, html string").repartition(2)
    assert [r[0] for r in spark.createDataFrame([(k, u) for k, u in enumerate(ODD)], "k int, u string").orderBy("k").select(warc.url_key(F.col("u"))).collect()] == [warc.key_of(u) for u in ODD]
    out, index = scratch(spark, "test-warc-odd"), scratch(spark, "test-index-odd")
    warc.write_archives(warc.planned(p), out, file_bytes=3000)
    warc.build_index(warc.read_archives(spark, out), index, block_lines=3)
    want = rows(warc.read_archives(spark, out), "page_id", "payload", "file", "offset", "length")
    for entries in (10**6, 0):
        assert rows(warc.read_ranges(warc.locate(spark, index, p.select("url"), entries)), "page_id", "payload", "file", "offset", "length") == want
    ix = warc.CaptureIndex(spark, index)
    for k, u in enumerate(ODD):
        assert {str(k), str(k + len(ODD))} <= {c[0] for c in ix.captures(u)}, u
    # the query's rows come through the index: what it lacks is not given
    p.write.parquet(f"{tmp_path}/pages.parquet")
    assert rows(warc.op7_warc(spark, str(tmp_path)), "page_id") == sorted([(k,) for k in range(2 * len(ODD))], key=str)
    build = warc.build_index
    monkeypatch.setattr(warc, "build_index", lambda captures, *a: build(captures.where("page_id < 5"), *a))
    assert rows(warc.op7_warc(spark, str(tmp_path)), "page_id") == [(k,) for k in range(5)]


# nearest neighbours
def test_vp_tree_is_exact():
    r = np.random.default_rng(1)
    for _ in range(25):
        x = r.integers(-2, 3, (int(r.integers(1, 400)), 4)).astype(float)
        x = x[(x != 0).any(1)]
        if not len(x):
            continue
        ids, k = r.permutation(len(x) * 3)[: len(x)].astype(np.int64), int(r.integers(1, 7))
        row, got, score = vp_search.Tree(ids, x, 8).search(x, ids, k)
        for q in range(len(x)):
            s, m = vp_search.cosine(np.repeat(x[q : q + 1], len(x), 0), x), ids != ids[q]
            best = np.lexsort((ids[m], -s[m]))[:k]
            assert got[row == q].tolist() == ids[m][best].tolist() and score[row == q].tolist() == s[m][best].tolist()


def test_relaxed_search_recall():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 12)) + 3 * r.normal(size=(8, 12))[r.integers(0, 8, 4000)]
    ids = np.arange(4000)
    t = vp_search.Tree(ids, x)
    exact = t.search(x[:200], ids[:200], 5)
    seen = t.seen
    near = t.search(x[:200], ids[:200], 5, factor=1.5)
    both = set(zip(exact[0].tolist(), exact[1].tolist())) & set(zip(near[0].tolist(), near[1].tolist()))
    assert len(both) / 1000 >= 0.9 and t.seen < seen < 4000 * 200


def test_nearest_frames(spark):
    r = np.random.default_rng(3)
    data = [(k, [float(v) for v in r.normal(size=6)], "c") for k in range(150)]
    data += [(150, None, "c"), (151, [0.0] * 6, "c"), (152, [1.0, None] + [1.0] * 4, "c"), (153, [float("nan")] * 6, "c"), (154, [1.0, 2.0], "c"), (155, [], "c"), (0, data[0][1], "c"), (None, [1.0] * 6, "c")]
    v = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank string")
    got = vp_search.search(vp_search.build_index(v, shard_rows=40), v.where("vec_id % 50 = 0"), chunk_bytes=200).orderBy("query_id", "rank").collect()
    x, ids = np.array([d[1] for d in data[:150]]), np.arange(150)
    want = []
    for q in (0, 50, 100):
        s = vp_search.cosine(np.repeat(x[q : q + 1], 150, 0), x)
        s[q] = -9
        want += [(q, k + 1, int(i), s[i]) for k, i in enumerate(np.lexsort((ids, -s))[:5])]
    assert [tuple(r) for r in got] == want
    assert rows(vp_search.search(vp_search.build_index(v, shard_rows=40), v.where("vec_id % 50 = 0"))) == sorted(want, key=str)
    assert vp_search.search(vp_search.build_index(v.limit(0)), v).count() == 0


# URL filters
def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/x?y", "https://www.example.com/en/", "http://example.com/EN/", "ftp://x.net/es/1#t", "http://net/fr/", "http://xnet/fr/", "http://q.com", "http://q.com?a/b", "no scheme", "", None, "http://a.org/en/", "http://com/", "://example.com/en/", "http://www.example.com/en", "http://b.www.example.com/en/z"]
    p = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    rules = {h + path: (a, h, path) for a, h, path in url_filter.RULES}
    for limit in (url_filter.MAX_BYTES, 0):  # a cascade, and parts of one rule
        got = {r.page_id: r for r in url_filter.url_verdicts(p, max_bytes=limit).collect()}
        for k, u in enumerate(urls):
            rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = rest[:cut].lower(), rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
            fits = [r for r, (a, h, q) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(q)]
            best = max(fits, key=len, default=None)
            assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, best, rules[best][0] if best else "allow"), u
        assert got[0].in_host == "h"
    assert url_filter.url_verdicts(p.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(p, rules=[]).collect()} == {"allow"}
    clash = p.withColumns({c: F.lit(c) for c in ("in_host", "rule", "keys", "hashes")})
    got = url_filter.url_verdicts(clash.unionAll(clash))
    assert got.columns == ["host", "path", "rule", "verdict", "page_id", "url", "in_in_host", "in_host", "in_rule", "keys", "hashes"]
    assert {(r.in_host, r.in_in_host, r["keys"]) for r in got.collect()} == {("in_host", "h", "keys")} and got.count() == 2 * len(urls)


def test_cascade_is_exact(spark):
    listed = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade, seed = url_filter.build_cascade(listed, universe)
    keys = np.array([r.h for r in universe.select(F.xxhash64(F.lit(seed), "key").alias("h")).collect()])
    assert cascade.holds(keys).tolist() == [k < 3000 and k % 3 == 0 for k in range(20_000)] and len(cascade.levels) >= 2
    assert url_filter.build_cascade(listed, universe, max_bytes=10) is None


def test_sentencepiece_holds_few_words_and_texts():
    """Memory of a worker: words beyond a bound are forgotten, long batches are cut, and neither changes the ids."""
    import pyarrow as pa

    c = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    texts = [" ".join(f"w{1000 * k + i}" for i in range(1000)) for k in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None, ""])], ["text"])
    at, most, flat = 0, 0, []
    for i, j, part in sentencepiece_codec._texts(batch, "text"):
        assert i == at and part == [*texts, "", ""][i:j] and sum(map(len, part[:-1])) < 500_000
        at = j
        flat.append(c.encode(part)[0])
        most = max(most, len(c.words))
    assert at == 402 and most < 300_000
    fresh = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    assert [*np.concatenate(flat)] == [i for t in texts for i in fresh.encode([t])[0]]

"""The pipeline's stages over a small set with planted cases."""

import hashlib
import math
import random

import corpus_pipeline
import sentencepiece
from colscope.llm import mixing, registry, sentencepiece_codec
from colscope.llm.common import written
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    r = random.Random(8)
    words = [f"word{k}" for k in range(500)]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(240)]
    toxic = set(range(0, 240, 6))
    for k in toxic:
        texts[k] += " vile rotten"
    texts[101] = texts[103] = texts[99]  # equal
    near = texts[107].split()
    near[30] = "other"
    texts[109] = " ".join(near)
    d = spark.createDataFrame([(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    left = d
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = f"{tmp_path}/{name.replace(' ', '_')}"
        stage(spark, left, str(tmp_path)).write.parquet(out)
        left = spark.read.parquet(out)
        assert left.columns == d.columns
        kept.append([x.doc_id for x in left.select("doc_id").collect()])
    clean = set(range(240)) - toxic
    assert set(kept[0]) == clean and set(kept[1]) == clean - {99, 101} and set(kept[2]) == clean - {99, 101, 109}
    assert all(len(k) == len(set(k)) for k in kept[:3]) and set(kept[3]) <= set(kept[2]) and max(kept[3].count(x) for x in set(kept[3])) <= 2
    last = corpus_pipeline.to_tokens(spark, left, str(tmp_path))
    assert last.count() == len(kept[3]) and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, columns named as the operators' own; then no row at all."""
    long_ = " ".join(f"w{k % 3001}" for k in range(40_000))
    odd = [(0, "one two three four five six", "s"), (1, None, "s"), (2, "", None), (None, "no id at all here", "s"), (3, long_, "t"), (4, long_ + " end", "t"), (5, "kept as it is", None), (5, "kept as it is", None), (6, " \n ", "t")]
    d = spark.createDataFrame([(i, t, None, s, None) for i, t, s in odd], "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["_id", "_h", "_size", "_shard", "_order", "_row", "kept", "target", "_digest", "toxic"]
    d = d.withColumns({c: F.lit(c) for c in extra})
    spark.createDataFrame([(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for part in (d, d.limit(0)):
        left = part
        for name, stage in corpus_pipeline.STAGES[1:4]:
            left = written(stage(spark, left, str(tmp_path)), "odd")
            assert left.columns == d.columns
            kept[name] = sorted((x.doc_id for x in left.collect()), key=str)
        got = left.select(*extra).distinct().collect()
        assert got == [] if part is not d else [tuple(x) for x in got] == [tuple(extra)]
        tokens = corpus_pipeline.to_tokens(spark, left, str(tmp_path))
        assert tokens.count() == left.count()
        if part is d:
            assert kept["exact dedup"] == [0, 2, 3, 4, 5, 6, None] and kept["near dedup"] == [0, 2, 3, 5, 6, None]
            assert set(kept["mixing"]) <= set(kept["near dedup"]) and 3 in kept["mixing"]
    for part, n in ((d, len(odd)), (d.limit(0), 0)):  # without labels nothing is rejected
        left = corpus_pipeline.drop_toxic(spark, part, str(tmp_path))
        assert left.columns == d.columns and left.count() == n


def test_mix_is_shuffled(spark, tmp_path):
    """Each task has a run of one shard's random order, and copies are not side by side."""
    texts = [" ".join(["w"] * (5 + k % 30)) for k in range(400)]
    d = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [x.doc_id for x in corpus_pipeline.mix_sources(spark, d, "").collect()]
    mix = mixing.mixed(d, corpus_pipeline.SHARDS).select("doc_id", "_shard", "_order").collect()
    parts = sorted((x._shard, x._order, x.doc_id) for x in mix)
    assert sorted(got) == sorted(x[2] for x in parts)
    beside = sum(a == b for a, b in zip(got, got[1:]))
    follows = {(a[2], b[2]) for a, b in zip(parts, parts[1:]) if a[0] == b[0]}
    assert beside < len(got) / 50 and sum((a, b) in follows for a, b in zip(got, got[1:])) > 0.9 * len(got)


def test_registry():
    names = registry.queries()
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}
    assert set(registry.oracle_sql()) < set(names)


def brute_mix(docs):
    """doc_id of each copy that the mix takes of (doc_id, text, source), by water-filling and one pass in order of hashes for each round."""
    size = {k: len((t or "").split()) for k, t, _ in docs}
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    own = {s: [k for k, _, x in docs if x == s] for s in sources}
    total = {s: sum(size[k] for k in own[s]) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    target, left, share = {}, set(sources), 1.5 * sum(total.values())
    while left:
        level = share / sum(weight[s] for s in left)
        full = {s for s in left if 2 * total[s] <= level * weight[s]}
        for s in full or left:
            target[s] = 2.0 * total[s] if full else level * weight[s]
        share -= sum(target[s] for s in full)
        left -= full or left
    out = []
    for s in sources:
        key = {k: (int(hashlib.md5(f"7:{k}".encode()).hexdigest()[:15], 16), str(k), size[k]) for k in own[s]}
        times = int(target[s] // total[s]) if total[s] else 0
        gap, more, after, cap, extra = target[s] - times * total[s], set(), (-1, "", -1), math.inf, set()
        while gap > 0:
            over, last = True, after
            for k in sorted((k for k in own[s] if key[k] > after and size[k] <= cap), key=key.get):
                if size[k] > gap:
                    over = False
                    break
                gap, last = gap - size[k], key[k]
                more.add(k)
            after = last
            near = [(abs(size[k] - gap), key[k], k) for k in own[s] if k not in more and abs(size[k] - gap) < gap]
            extra = {min(near)[2]} if near else set()
            miss = min(near)[0] if near else gap
            if over or miss <= mixing.TOLERANCE * target[s]:
                break
            cap = gap / 2
        out += [k for k in own[s] for _ in range(times + (k in more | extra))]
    return out


def test_run_equals_brute_force(spark, tmp_path):
    """All stages, by run(), against plain loops: planted toxic words, a dictionary of texts, all pairs' Jaccard, water-filling, the library's ids."""
    r = random.Random(21)
    words = [f"word{k}" for k in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(20, 90))) for _ in range(250)]
    toxic = set(range(0, 250, 5))
    for k in toxic:
        texts[k] += " vile rotten"
    for k in range(3, 60, 10):  # copies, and near copies by a word in the middle or a longer end
        texts[k + 100] = texts[k]
        texts[k + 4] = " ".join([*texts[k].split(), "the", "end"])
    long_ = [r.choice(words) for _ in range(1500)]
    texts[201], texts[202] = " ".join(long_), " ".join([*long_[:700], "other", *long_[701:]])
    texts[211] = texts[212] = None
    texts[213] = ""
    source = [None if k % 17 == 0 else ("a", "b", "b", "b", "c")[k % 7 % 5] for k in range(250)]
    d = spark.createDataFrame([(k, t, "en", source[k], len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    clean = [k for k in range(250) if k not in toxic]
    last = {texts[k] or "": k for k in clean}
    single = sorted(last.values())
    sets = {}
    for k in single:
        w = (texts[k] or "").split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {k: k for k in single}
    for i in single:
        for j in single:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    firsts = [k for k in single if group[k] == k]
    assert len(clean) > len(single) > len(firsts)
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    want = []
    for k in brute_mix([(k, texts[k], source[k]) for k in firsts]):
        ids = model.encode(texts[k] or "", add_eos=True)
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want) and len(set(got)) < len(got)

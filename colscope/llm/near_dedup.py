"""Near-duplicate groups by bottom-k sketches.

A document's set holds the hashes of its word shingles; its sketch is the k smallest of them, from the same hash. The
steps: equal sets become one representative; inverted lists of retained values propose pairs; sketches of unions filter
them; Jaccard on full sets decides. Components of the confirmed links are the groups.

A list of a frequent value would give all pairs of a group, so that lists don't give pairs. A sketch is only in the
lists of its rarest values, so many that a similar sketch must be in one of them, too. The first pass links each
document to at most one list's centre, the document that has the fewest rarer values. In lists that still hold
different components, every document is compared with the list's centre on full sets. Two documents x and y that share
less with the centre than their own overlap must be can only be similar if they share something beyond it. So what
x and y have beyond the centre (their rest) goes into inverted lists by centre and value, rarest values first, and only
these give pairs. Near copies of one text have little in common beyond that text: the pairs grow with the documents, not
with the square of a group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, small, table, written
from .components import components
from .url_filter import MAX_BYTES, HASHES, Level, _level
from .words import IS_SPACE, LOWER, flat_texts, hashes, shingles, spans

#: Values of a sketch; words of a shingle; a link needs 100 * shared >= 75 * union.
K, WORDS, PER_CENT = 256, 5, 75
#: Documents that meet their centre in one task.
CHUNK = 1024
#: The chance that a pair of just the least similarity has fewer shared retained values than are asked for.
MISS = 1e-10


def sets_of(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted different shingle hashes of each text: whole texts, A-Z in lower case, words between ASCII white space."""
    for i in range(0, len(column), 512):
        data, offsets = flat_texts(column.slice(i, 512))
        data = LOWER[data]
        starts, ends, counts = spans(data, offsets, ~IS_SPACE)
        sh, n = shingles(hashes(data, starts, ends), counts, words)
        ends = np.cumsum(n)
        for e, m in zip(ends.tolist(), n.tolist()):
            yield np.unique(sh[e - m : e])


@lru_cache(maxsize=None)
def least_shared(n: int, k: int = K, per_cent: int = PER_CENT) -> int:
    """The retained values that the sketch of a set of n shares at least with that of any set similar to it (but for a chance of MISS).

    The union has at most u = n / similarity elements. With u <= k sketches are whole sets and the count is exact; else
    the union's sketch is a sample of k without replacement, and the count is a quantile of a hypergeometric law.
    """
    u = n * 100 // per_cent
    if u <= k:
        return -(-n * per_cent // 100)
    u = min(u, 1 << 20)  # beyond, the law no longer moves
    good = -(-u * per_cent // 100)
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    total, below = choose(u, k), 0.0
    for x in range(max(0, k - (u - good)), k + 1):
        below += math.exp(choose(good, x) + choose(u - good, k - x) - total)
        if below > MISS:
            return max(1, min(x, -(-n * per_cent // 100)))
    return 1


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int, words: int) -> DataFrame:
    """`_id`, `n` (set size), `f1`, `f2` (128 bits of a SHA-256 of the full sorted set), `sketch` (its k smallest hashes, as signed numbers in unsigned order)."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ns, f1, f2, sk = [], [], [], []
                for s in sets_of(part.column(1), words):
                    ns.append(len(s))
                    one, two = np.frombuffer(hashlib.sha256(s.tobytes()).digest()[:16], np.uint64).tolist()
                    f1.append(one)
                    f2.append(two)
                    sk.append(s[:k].view(np.int64))
                lens = np.array([len(x) for x in sk], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(np.concatenate(sk)))
                signed = [pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ns, pa.int64()), *signed, lists], ["_id", "n", "f1", "f2", "sketch"])

    return docs.select(id_col, text_col).mapInArrow(run, f"_id {kind}, n long, f1 long, f2 long, sketch array<long>")


def _enough(n1: Column, n2: Column, p1: Column, p2: Column, k: int, per_cent: int) -> Column:
    """Whether sets of these sizes can be similar, with their first shared value at these places of the common order."""
    room = F.least(n1 - p1, n2 - p2) + 1 >= _need(n1, n2, per_cent)
    return _sizes(n1, n2, per_cent) & (room | (F.greatest(n1, n2) > k))  # only whole sets have exact places


def _sizes(n1: Column, n2: Column, per_cent: int) -> Column:
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * per_cent) & n1.isNotNull() & n2.isNotNull()


def _need(n1: Column, n2: Column, per_cent: int) -> Column:
    """What two similar sets of these sizes share at least."""
    return F.ceil((n1 + n2) * per_cent / F.lit(100 + per_cent) - 1e-9)


def _postings(reps: DataFrame, k: int, per_cent: int) -> DataFrame:
    """`value`, `id`, `n`, `place`: each sketch in the lists of its rarest values. `place` is the value's in the sketch, rarest first."""
    values = reps.select(F.explode("sketch").alias("value"))
    common = written(values.groupBy("value").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "common")
    n = common.count()
    level = _level(common.select(F.col("value").alias("hash")), n, 0) if n and n * HASHES / math.log(2) / 8 <= MAX_BYTES else None
    sent = reps.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, lens = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            held = sent.value.holds(flat) if sent.value else np.ones(len(flat), bool)
            n = b.column(1).to_numpy()
            prefix = lens - np.array([least_shared(int(x), k, per_cent) for x in n], np.int64) + 1
            owner = np.repeat(np.arange(len(lens)), lens)
            alone = lens - np.bincount(owner, held, len(lens)).astype(np.int64)
            pick = held & (alone < prefix)[owner]  # else its rarest values are its own only
            o = owner[pick]
            yield pa.RecordBatch.from_arrays([pa.array(flat[pick]), b.column(0).take(pa.array(o)), pa.array(n[o]), pa.array(lens[o]), pa.array(prefix[o])], ["value", "id", "n", "size", "prefix"])

    kind = reps.schema["_id"].dataType.simpleString()
    listed = reps.select("_id", "n", "sketch").mapInArrow(run, f"value long, id {kind}, n long, size long, prefix long")
    sorted_ = listed.join(common, "value").groupBy("id", "n", "size", "prefix").agg(F.array_sort(F.collect_set(F.struct("f", "value"))).alias("v"))
    alone = F.col("size") - F.size("v")
    first = sorted_.where(alone < F.col("prefix")).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("v", F.lit(1), F.greatest(F.lit(1), (F.col("prefix") - alone).cast("int")))).alias("at", "x"))
    return first.select(F.col("x.value").alias("value"), "id", "n", (F.col("alone") + F.col("at") + 1).alias("place"))


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="mergesort")
    return int((both[1:] == both[:-1]).sum())


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """`_id`, `set` (sorted hashes as bytes) of the documents in wanted, a written table of `_id`, from their whole texts. Of rows that share an id one is taken."""
    kind = wanted.schema["_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets_of(part.column(1), words)], pa.binary())], ["_id", "set"])

    texts = docs.select(F.col(id_col).alias("_id"), text_col).join(small(wanted), "_id", "left_semi")
    return written(texts.mapInArrow(whole, f"_id {kind}, set binary"), "sets", "none")


def _beyond(open_: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, per_cent: int) -> DataFrame:
    """For each document (`id`, `n`) of an open list and the list's centre `c` of `c_n` hashes: `o`, what they share, `linked`, and `rest`, the document's other hashes. All from full sets.

    A centre meets its documents in chunks, so that one centre's documents need not be in one task.
    """
    spokes = written(open_.where("id <> c_id").select("id", "n", F.col("c_id").alias("c")).distinct(), "spokes")
    chunks = written(spokes.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks")), "chunks")
    ids = written(spokes.select(F.col("id").alias("_id")).unionByName(chunks.select(F.col("c").alias("_id"))).distinct(), "ids")
    sets = _full_sets(docs, ids, id_col, text_col, words)
    hubs = chunks.select(F.col("c").alias("_id"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).join(sets, "_id")
    hubs = hubs.select(F.col("_id").alias("c"), "chunk", F.lit(0).cast("long").alias("n"), F.col("_id").alias("id"), "set")
    rims = spokes.join(small(chunks), "c").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rims = rims.join(sets, F.col("id") == F.col("_id")).select("c", "chunk", "n", "id", "set")
    kind = spokes.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for b in batches:
            shared, sizes, linked, rest, rows = [], [], [], [], []
            for r, n in enumerate(b.column(2).to_pylist()):
                s = np.frombuffer(b.column(4)[r].as_buffer(), np.uint64)
                if not n:  # a centre comes before its documents
                    hub = s
                    continue
                in_hub = hub[np.minimum(np.searchsorted(hub, s), len(hub) - 1)] == s
                o = int(in_hub.sum())
                shared.append(o)
                sizes.append(len(hub))
                linked.append(100 * o >= per_cent * (len(s) + len(hub) - o))
                rest.append(s[~in_hub].view(np.int64))
                rows.append(r)
            at = pa.array(rows, pa.int64())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rest])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *rest])))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(3).take(at), b.column(2).take(at), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_()), lists], ["c", "id", "n", "c_n", "o", "linked", "rest"])

    both = hubs.unionByName(rims).repartition("c", "chunk").sortWithinPartitions("c", "chunk", "n")
    out = written(both.mapInArrow(split, f"c {kind}, id {kind}, n long, c_n long, o long, linked boolean, rest array<long>"), "rests")
    dropped(spokes, chunks, ids, sets)
    return out


def _rest_pairs(rests: DataFrame, labels: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of different components, written, which hold every link between documents of one centre.

    Let c be a centre that x isn't linked to, so that x shares fewer hashes with c than a set of c's size asks for. If
    both x and y share with c what their own sizes ask for, which only sets smaller than c's can, the pair is given.
    Else a link needs at least (what their sizes ask for) - (the lesser of what they share with c) common hashes in
    their rests: a prefix filter over the rests, by centre, finds these. A pair with several common centres is looked for
    with the one that both share most with, or else, where these differ, with each.
    """
    at = lambda df: df.join(small(labels), F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "id")).drop("node")
    of = rests.groupBy("c").agg(F.min("n").alias("lo"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    best = rests.groupBy("id").agg(F.max_by("c", F.struct("o", "c")).alias("best"))
    rows = written(at(rests).join(small(written(of, "least")), "c").join(small(written(best, "best")), "id"), "rows")
    need = lambda m: _need(F.col("n"), m, per_cent)
    n2, o2 = F.col("n2"), F.col("o2")
    # both share enough with the centre
    x = rows.where(~F.col("linked") & (F.col("o") >= need(F.col("lo")))).select("c", "id", "n", "o", "label", "lo")
    # y is smaller than the centre, or else x would be linked to that
    y = rows.where((F.col("n") < F.col("c_n")) & (F.col("o") >= need(F.col("lo")))).select("c", *[F.col(v).alias(f"{v}2") for v in ("id", "n", "o", "label")])
    close = x.join(y, "c").where((F.col("label") != F.col("label2")) & (F.least("o", o2) >= need(n2)) & _sizes(F.col("n"), n2, per_cent)).select("id", "id2")
    # the rests' lists that hold several components
    posted = rows.select("c", "id", "n", "o", "label", "best", "lo", F.size("rest").alias("r"), F.explode("rest").alias("value"))
    lists = posted.groupBy("c", "value").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").drop("l", "h")
    lists = written(lists, "rest-lists")
    key = ["c", "id", "n", "o", "label", "best", "lo", "r"]
    held = posted.join(small(lists), ["c", "value"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("v"))
    alone = F.col("r") - F.size("v")  # hashes that no document of another component has
    least = F.greatest(F.lit(1), need(F.greatest(F.col("lo"), F.ceil(F.col("n") * per_cent / 100))) - F.col("o"))
    held = held.withColumn("alone", alone).withColumn("take", (F.col("r") - least + 1 - F.col("alone")).cast("int")).where("take > 0")
    held = written(held.withColumn("v", F.transform(F.slice("v", F.lit(1), F.col("take")), lambda s: s["value"])).drop("take"), "held")
    one = held.select("*", F.posexplode("v").alias("at", "value")).withColumn("place", F.col("alone") + F.col("at") + 1)
    two = one.select("c", "value", *[F.col(v).alias(f"{v}2") for v in ("id", "n", "o", "label", "best", "r", "v", "at", "place")])
    room = F.least(F.col("r") - F.col("place"), F.col("r2") - F.col("place2")) + 1
    before = F.arrays_overlap(F.slice("v", F.lit(1), F.col("at")), F.slice("v2", F.lit(1), F.col("at2")))
    asked = (F.col("best") != F.col("best2")) | (F.col("best") == F.col("c"))
    beyond = one.join(two, ["c", "value"]).where(
        (F.col("id") < F.col("id2")) & (F.col("label") != F.col("label2")) & asked & _sizes(F.col("n"), n2, per_cent) & (room >= need(n2) - F.least("o", o2)) & ~before
    ).select("id", "id2")
    pairs = written(close.unionByName(beyond).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), "rest-pairs")
    dropped(rows, lists, held)
    return pairs


def _compared(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, words: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) that are links. Sketches decide small sets; of the others they pass on those whose union's sketch may be that of a link, and full sets decide."""
    pairs = written(pairs.select("a", "b"), "pairs")
    nodes = lambda df: written(df.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "nodes")
    own = reps.join(small(nodes(pairs)), "_id", "left_semi").select("_id", "n", "sketch")
    own = written(own, "sketches", "none")

    def side(df: DataFrame, of: DataFrame, name: str, *cols: str) -> DataFrame:
        return df.join(of.select(F.col("_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols]), name)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n1, n2 = b.column(2).to_pylist(), b.column(4).to_pylist()
            keep, sure = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool)
            for r in range(b.num_rows):
                x, y = (b.column(c)[r].values.to_numpy().view(np.uint64) for c in (3, 5))
                if n1[r] <= k and n2[r] <= k:
                    o = _overlap(x, y)
                    keep[r] = sure[r] = 100 * o >= per_cent * (n1[r] + n2[r] - o)
                else:
                    union = np.union1d(x, y)[:k]  # the sketch of the union
                    o = _overlap(x[x <= union[-1]], y[y <= union[-1]])
                    keep[r] = o >= least_shared(min(n1[r], n2[r]), k, per_cent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sure)], ["a", "b", "sure"]).filter(pa.array(keep))

    kind = reps.schema["_id"].dataType.simpleString()
    both = side(side(pairs, own, "a", "n", "sketch"), own, "b", "n", "sketch").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
    passed = written(both.mapInArrow(filtered, f"a {kind}, b {kind}, sure boolean"), "passed")
    unsure = passed.where("not sure").select("a", "b")
    sets = _full_sets(docs, nodes(unsure), id_col, text_col, words)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for r in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[r].as_buffer(), np.uint64) for c in (2, 3))
                o = _overlap(x, y)
                keep[r] = 100 * o >= per_cent * (len(x) + len(y) - o)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    full = side(side(unsure, sets, "a", "set"), sets, "b", "set").select("a", "b", "set_a", "set_b").mapInArrow(decided, f"a {kind}, b {kind}")
    links = written(passed.where("sure").select("a", "b").unionByName(full), "links")
    dropped(pairs, own, passed, sets)
    return links


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """A row per row of docs: `_id`, `n_shingles`, `component_id` (the smallest id reachable over links), `kept` (it is the own id).

    Null and empty texts, and those without words, have no set and no links. Texts of fewer than `words` words have one
    shingle of all their words. Rows with equal sets are linked whatever their texts are. Rows that share an id are one
    node: what one of them is linked to is linked to the others; where their texts differ, links of all of them are only
    looked for among equal sets, centres and lists of two. Rows with a null id get a null component, and stay. An empty
    table gives an empty result; columns other than id and text are not read, whatever their names.
    """
    every = written(sketched(docs, id_col, text_col, k, words), "sketched", "none")
    alive = every.where("n > 0 and _id is not null")
    key = ["f1", "f2", "n"]
    classes = alive.groupBy(*key).agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    classes = written(classes, "classes")
    with_rep = lambda df: df.join(small(classes), key, "left").withColumn("rep", F.coalesce("rep", "_id"))
    reps = with_rep(alive).where("_id = rep").select("_id", "n", "sketch")
    posted = written(_postings(reps, k, per_cent), "postings")
    centre = F.min(F.struct("place", "n", "id"))
    lists = written(posted.groupBy("value").agg(F.count(F.lit(1)).alias("m"), centre.alias("c")).where("m > 1").select("value", F.col("c.id").alias("c_id"), F.col("c.n").alias("c_n"), F.col("c.place").alias("c_place")), "lists")
    shared = posted.join(small(lists), "value")
    near = shared.where((F.col("id") != F.col("c_id")) & _enough(F.col("n"), F.col("c_n"), F.col("place"), F.col("c_place"), k, per_cent))
    votes = near.groupBy("id", "c_id").agg(F.count(F.lit(1)).alias("m"))
    best = votes.groupBy("id").agg(F.max_by("c_id", F.struct("m", "c_id")).alias("c_id"))
    first = _compared(best.select(F.least("id", "c_id").alias("a"), F.greatest("id", "c_id").alias("b")).distinct(), reps, docs, id_col, text_col, k, words, per_cent)
    # lists whose documents aren't all in one component
    labels = components(first)
    placed = written(shared.join(small(labels), F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "id")).drop("node"), "placed")
    dropped(posted, lists, labels)
    mixed = placed.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("value", "m")
    open_ = written(placed.join(small(written(mixed, "mixed")), "value"), "open")
    dropped(placed)
    # a list of two gives its pair
    two = open_.where((F.col("m") == 2) & (F.col("id") != F.col("c_id")) & _enough(F.col("n"), F.col("c_n"), F.col("place"), F.col("c_place"), k, per_cent))
    two = written(two.select(F.least("id", "c_id").alias("a"), F.greatest("id", "c_id").alias("b")).distinct(), "twos")
    rests = _beyond(open_.where("m > 2"), docs, id_col, text_col, words, per_cent)
    known = first.unionByName(rests.where("linked").select(F.col("c").alias("a"), F.col("id").alias("b")))
    labels = components(known)
    pairs = _rest_pairs(rests, labels, per_cent).unionByName(two).distinct()
    second = _compared(pairs, reps, docs, id_col, text_col, k, words, per_cent)
    dropped(open_, labels)
    labels = components(known.unionByName(second))
    dropped(rests)
    rows = with_rep(every.select("_id", *key))
    rows = rows.join(small(labels), F.col("rep") == F.col("node"), "left")
    component = F.when((F.col("n") == 0) | F.col("_id").isNull(), F.col("_id")).otherwise(F.coalesce("label", "rep"))
    return rows.select("_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_groups does not keep."""
    gone = written(near_groups(docs, id_col, text_col).where("not kept").select(F.col("_id").alias(id_col)), "gone")
    return docs.join(small(gone), id_col, "left_anti").select(*docs.columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a),
c AS (SELECT node AS doc_id, min(label) AS component_id FROM r GROUP BY node)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id
"""

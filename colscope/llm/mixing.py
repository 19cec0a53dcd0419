"""Mixing sources to target weights, with DataFrame functions only.

Targets come from water-filling over the table of sources. Inside a source, documents stand in the order of a hash of
their id, cut into blocks of equal hash range. Which documents are taken once more than the others is found from block
sums: whole blocks first, then the block that holds the edge is cut into finer blocks, and only the last, small one is
ordered row by row. Where a long document at the edge leaves a source far from its target, the search goes on behind it
among documents of at most half the gap, which halves the gap or takes all of them.

Output shards get blocks by a splitting tree: each node halves its units (source, block, copy) at random, which makes the
counts per source a multivariate hypergeometric draw. With these counts as exact quotas every shard draws disjoint runs
of each source's permuted blocks, and is shuffled by itself. What the mix takes is what the shards have drawn. Ranks of
units come from counts by hash range, so that no task orders all units of a node or of a source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table, written

WEIGHTS = (5, 2, 1)
#: Bits of the hash, and of it for each step of the search for the edge: blocks of a source, then blocks of a block ...
HASH_BITS, STEP_BITS, STEPS = 60, 10, 3
#: Documents of a block, about; a source that has fewer than BLOCKS blocks for each shard gets smaller ones, of a document at least.
BLOCK_ROWS, BLOCKS = 256, 8
#: Words of a shard, about, where the number of shards is not given; it is a power of two.
SHARD_WORDS, LEAST_SHARDS = 64_000_000, 8
#: A source that misses its target by more than this share of it is filled further.
TOLERANCE = 0.01
#: Further takes: documents after one key, up to another, of a size of at most `cap`.
KEY = "struct<_h:bigint,id:string,_size:bigint>"
MORE = f"array<struct<after:{KEY},upto:{KEY},cap:double>>"
WORD = r"[^\x20\x09-\x0D]+"


def _hash(seed: int, *cols: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with _source, _size (words), _h and _key, by which documents of a source are in order."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    h = _hash(seed, F.col(id_col))
    return docs.withColumns({"_source": F.col(source_col), "_size": size, "_h": h}).withColumn("_key", F.struct("_h", F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), "_size"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row per source: source_size, target, times (whole takes of all its documents), rest (words still to be taken).

    Windows without partitions run over the sources, one row each, not over documents.
    """
    by_source = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    cyclic = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = by_source.withColumn("_w", cyclic).withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_full", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_full", F.col("_source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = rows.withColumns({
        "_n": F.row_number().over(order),
        "_level": (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after),
    })
    level = F.min_by("_level", "_n").over(every)
    rows = rows.withColumn("_open", F.when(F.col("_level") < F.col("_full"), F.struct("_n", "_level")))
    level = F.min("_open").over(every)["_level"]
    rows = rows.withColumn("target", F.when(level.isNull() | (F.col("_full") <= level), F.col("_cap")).otherwise(level * F.col("_w")))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return rows.withColumn("times", times.cast("int")).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")).select("_source", "source_size", "target", "times", "rest")


def _narrowed(sizes: DataFrame, edges: DataFrame, step: int) -> DataFrame:
    """edges (a source's hash range with the edge, and the words before it) with a range smaller by STEP_BITS bits."""
    width = 1 << (HASH_BITS - STEP_BITS * step)
    inside = sizes.join(small(edges), F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_h") >= F.col("_lo")) & (F.col("_h") < F.col("_hi")))
    lo = F.col("_h") - F.pmod(F.col("_h"), F.lit(width))
    blocks = inside.groupBy("_of", "_rest", "_before", lo.alias("_block")).agg(F.sum("_size").alias("_words"))
    upto = Window.partitionBy("_of").orderBy("_block")
    blocks = blocks.withColumn("_upto", F.col("_before") + F.sum("_words").over(upto))
    first = blocks.where(F.col("_upto") > F.col("_rest")).groupBy("_of").agg(F.min(F.struct("_block", "_rest", (F.col("_upto") - F.col("_words")).alias("_before"))).alias("b"))
    return first.select("_of", F.col("b._block").alias("_lo"), (F.col("b._block") + width).alias("_hi"), F.col("b._rest").alias("_rest"), F.col("b._before").alias("_before"))


def _of() -> Column:
    return F.col("_source").eqNullSafe(F.col("_of"))


def _key(h: Column) -> Column:
    """A key before all those of documents with the hash h."""
    return F.struct(h.cast("long").alias("_h"), F.lit("").alias("id"), F.lit(-1).cast("long").alias("_size"))


def _filled(sizes: DataFrame, open_: DataFrame) -> DataFrame:
    """For open_'s sources (_of, _rest: words to be taken) `upto`, the last key that fits, and `_got`, the words up to it; no row where all documents together fit."""
    edges = open_.select("_of", F.lit(0).cast("long").alias("_lo"), F.lit(1 << HASH_BITS).cast("long").alias("_hi"), "_rest", F.lit(0).cast("long").alias("_before"))
    for step in range(1, STEPS + 1):
        edges = written(_narrowed(sizes, edges, step), f"edges{step}")
    last = sizes.join(small(edges), _of() & (F.col("_h") >= F.col("_lo")) & (F.col("_h") < F.col("_hi")))
    upto = Window.partitionBy("_of").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("_upto", F.col("_before") + F.sum("_size").over(upto))
    fits = F.col("_upto") <= F.col("_rest")
    found = last.groupBy("_of").agg(
        F.first("_lo").alias("_lo"), F.max(F.when(fits, F.col("_key"))).alias("_fits"), F.coalesce(F.max(F.when(fits, F.col("_upto"))), F.first("_before")).alias("_got")
    )
    # everything below the last range is taken as well
    return written(found.select("_of", F.coalesce("_fits", _key(F.col("_lo"))).alias("upto"), "_got"), "found")


def _once_more() -> Column:
    """Whether a document is taken once more, but for `extra`."""
    later = F.exists("more", lambda m: (F.col("_key") > m["after"]) & (F.col("_key") <= m["upto"]) & (F.col("_size") <= m["cap"]))
    return F.coalesce(F.col("_key") <= F.col("upto"), F.lit(False)) | later


def _with_extra(sizes: DataFrame, edged: DataFrame) -> DataFrame:
    open_ = sizes.join(small(edged.where("rest > 0").withColumnRenamed("_source", "_of")), _of()).where(~_once_more())
    off = F.abs(F.col("_size") - F.col("gap"))
    nearest = open_.where(off < F.col("gap")).groupBy("_of").agg(F.min(F.struct(off.alias("off"), "_key")).alias("b"))
    nearest = nearest.select(F.col("_of"), F.col("b._key").alias("extra"))
    return written(edged.join(small(written(nearest, "nearest")), _of(), "left").drop("_of"), "decided")


def decide(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, tolerance: float = TOLERANCE) -> DataFrame:
    """source_targets with the edge: documents whose _key is at most `upto` are taken once more, and so are those that `more` describes and the one whose _key is `extra`.

    `upto` is null where no (or every) document is below; the sources whose rest is zero have no edge. `extra` is the document
    not yet taken again whose size is nearest to what is missing, if that brings the source nearer to its target. `more` is
    empty where the source is then within the tolerance. Each round at least halves the gap or takes all documents of at
    most half of it, beyond which one document at most fits, so that there are about log2(1 / tolerance) rounds.
    """
    targets = written(source_targets(sizes, weights, share, cap), "targets")
    found = _filled(sizes, targets.where("rest > 0").select(F.col("_source").alias("_of"), F.col("rest").alias("_rest")))
    edged = targets.join(small(found), _of(), "left").withColumn("gap", F.col("rest") - F.coalesce("_got", F.lit(0).cast("long"))).drop("_of", "_got")
    edged = written(edged.withColumns({"more": F.array().cast(MORE), "over": F.lit(False)}), "edged")
    decided = _with_extra(sizes, edged)
    while True:
        miss = F.abs(F.col("gap") - F.coalesce(F.col("extra")["_size"], F.lit(0)))
        after = F.coalesce(F.get("more", F.size("more") - 1)["upto"], F.col("upto"), _key(F.lit(0)))
        far = decided.where((F.col("rest") > 0) & ~F.col("over") & (miss > F.col("target") * tolerance))
        far = written(far.select(F.col("_source").alias("_of"), F.col("gap").alias("_rest"), after.alias("_after"), (F.col("gap") / 2).alias("_cap")), "far")
        if far.isEmpty():
            return decided.drop("over")
        left = sizes.join(small(far), _of() & (F.col("_key") > F.col("_after")) & (F.col("_size") <= F.col("_cap")))
        left = written(left.select("_source", "_size", "_h", "_key"), "left")
        found = _filled(left, far.select("_of", "_rest"))
        every = left.groupBy(F.col("_source").alias("_w")).agg(F.max("_key").alias("_all"), F.sum("_size").alias("_sum"))
        found = found.select(F.col("_of").alias("_f"), F.col("upto").alias("_upto"), "_got")
        step = far.join(small(found), F.col("_of").eqNullSafe(F.col("_f")), "left").join(small(written(every, "every")), F.col("_of").eqNullSafe(F.col("_w")), "left")
        step = step.select("_of", "_after", "_cap", F.col("_upto").isNull().alias("_over"), F.coalesce("_upto", "_all").alias("_upto"), F.coalesce("_got", "_sum", F.lit(0).cast("long")).alias("_got"))
        new = F.struct(F.col("_after").alias("after"), F.col("_upto").alias("upto"), F.col("_cap").cast("double").alias("cap"))
        edged = decided.drop("extra").join(small(written(step, "step")), _of(), "left")
        edged = edged.withColumns({
            "more": F.when(F.col("_upto").isNotNull(), F.concat("more", F.array(new)).cast(MORE)).otherwise(F.col("more")),
            "gap": F.col("gap") - F.coalesce("_got", F.lit(0).cast("long")), "over": F.col("over") | F.coalesce("_over", F.lit(False)),
        })
        decided = _with_extra(sizes, written(edged.drop(*step.columns), "edged"))


def shards_for(decided: DataFrame) -> int:
    """The number of shards for what the sources' targets come to."""
    words = decided.agg(F.sum("target")).first()[0] or 0
    return max(LEAST_SHARDS, 1 << math.ceil(math.log2(max(1, words / SHARD_WORDS))))


def block_bits(sizes: DataFrame, shards: int) -> DataFrame:
    """`_of`, `_bits`: the leading bits of the hash that name a source's blocks."""
    n = F.count(F.lit(1))
    blocks = F.least(n, F.greatest(n / F.lit(BLOCK_ROWS), F.lit(BLOCKS * shards)))
    return written(sizes.groupBy(F.col("_source").alias("_of")).agg(F.ceil(F.log2(blocks)).cast("int").alias("_bits")), "bits")


def _block() -> Column:
    return F.call_function("shiftright", F.col("_h"), F.lit(HASH_BITS) - F.col("_bits"))


def _ranked(df: DataFrame, parts: Sequence[str], order: Column, ties: Sequence[str], name: str) -> DataFrame:
    """df with `name`, the place (from 1) of each row among those with equal `parts`, by `order`, a hash. Only rows of one range of hashes are ordered in a task; ranges are counted."""
    rows = df.withColumn("_o", order).withColumn("_range", F.shiftright("_o", HASH_BITS - STEP_BITS))
    upto = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*parts, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    keys = [*parts, "_range"]
    ranges = ranges.select(*[F.col(c).alias(f"r{c}") for c in keys], "_before")
    on = [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in keys]
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("_o", *ties))
    return rows.join(ranges, on).withColumn(name, F.col("_before") + inside).select(*df.columns, name)


def shard_units(sizes: DataFrame, decided: DataFrame, bits: DataFrame, shards: int, seed: int) -> DataFrame:
    """The shard of each unit (_of, _block, _copy), a written table. Shards have equal numbers of units, but for one."""
    if shards & (shards - 1) or shards < 1:
        raise ValueError("the number of shards must be a power of two")
    units = with_copies(sizes, decided).join(small(bits), _of()).groupBy("_of", _block().alias("_block")).agg(F.max("copies").alias("n")).where("n > 0")
    units = written(units.select("_of", "_block", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy")), "units")
    own = ["_of", "_block", "_copy"]
    tree = units.withColumn("_node", F.lit(0))
    for level in range(shards.bit_length() - 1):
        n = tree.groupBy(F.col("_node").alias("_of_node")).agg(F.count(F.lit(1)).alias("_units"))
        ranked = _ranked(tree, ["_node"], _hash(seed + 101 + level, *[F.col(c) for c in own]), own, "_at")
        # of an odd number of units the larger half goes left and right in turn
        half = (F.col("_units") + F.pmod(F.col("_node") + level, F.lit(2))).cast("long") / 2
        sides = ranked.join(F.broadcast(n), F.col("_node") == F.col("_of_node"))  # a row a node
        tree = written(sides.select(*own, (F.col("_node") * 2 + F.when(F.col("_at") <= F.floor(half), 0).otherwise(1)).alias("_node")), f"tree{level}")
    # exact quotas of source and shard, as runs of places among the source's blocks
    quota = tree.groupBy("_of", F.col("_node").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    after = Window.partitionBy("_of").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quota = quota.withColumn("upto", F.sum("n").over(after)).groupBy(F.col("_of").alias("_q")).agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("_runs"))
    drawn = _ranked(units, ["_of"], _hash(seed + 100, *[F.col(c) for c in own]), own, "_at").join(small(written(quota, "quotas"), weight=16 * F.size("_runs")), F.col("_of").eqNullSafe(F.col("_q")))
    shard = F.filter("_runs", lambda r: r["upto"] >= F.col("_at"))[0]["shard"]
    return written(drawn.select(*own, shard.cast("int").alias("shard")), "drawn")


def with_copies(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows of sized() with source_size, target and copies, the number of times that the mix takes them."""
    own = decided.withColumnRenamed("_source", "_of")
    once_more = _once_more() | F.coalesce(F.col("_key") == F.col("extra"), F.lit(False))
    return rows.join(small(own), F.col("_source").eqNullSafe(F.col("_of"))).withColumn("copies", F.col("times") + once_more.cast("int")).drop("_of", "times", "rest", "upto", "gap", "extra", "more")


def drawn_copies(rows: DataFrame, sizes: DataFrame, shards: int | None, weights: Sequence[float], share: float, cap: float, seed: int) -> DataFrame:
    """rows (of sized(), with the written `sizes` of all rows of it) with source_size, target and `_shards`, those that draw a copy of the row, in order of the copies."""
    decided = decide(sizes, weights, share, cap)
    shards = shards or shards_for(decided)
    bits = block_bits(sizes, shards)
    units = shard_units(sizes, decided, bits, shards, seed)
    blocks = units.groupBy(F.col("_of").alias("_b_of"), F.col("_block").alias("_b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_copy", "shard"))), lambda u: u["shard"]).alias("_all"))
    placed = with_copies(rows, decided).join(small(bits), _of()).withColumn("_block", _block())
    placed = placed.join(small(written(blocks, "blocks")), F.col("_source").eqNullSafe(F.col("_b_of")) & (F.col("_block") == F.col("_b")), "left")
    return placed.withColumn("_shards", F.slice(F.coalesce("_all", F.array().cast("array<int>")), F.lit(1), F.col("copies")))


def mixture(docs: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """docs with `_size`, `source_size`, `target` and `_shards`, the output shard of each copy that the mix takes (empty: none); these replace columns of the same names.

    A null text has size 0, a null source is a source by itself and the last in order, a null id hashes as an empty one.
    A source whose texts are all empty has target 0. Rows that repeat id and text get equal decisions; of documents that
    are equally good to close a gap, that with the smallest hash is taken. Empty docs give an empty result. Other
    columns may have any names. Decisions reach the texts by broadcasts of the tables of sources and of their blocks, so
    that no text is shuffled; beyond a checked size they are joined by a shuffle.
    """
    kept = [c for c in docs.columns if c not in MIXTURE]
    rows = docs.select(F.struct(*[F.col(c) for c in kept]).alias("_row"), F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(source_col).alias("_s"))
    rows = sized(rows, "_i", "_t", "_s", seed)
    sizes = written(rows.select("_source", "_size", "_h", "_key"), "sizes")
    got = drawn_copies(rows, sizes, shards, weights, share, cap, seed)
    return got.select(*[F.col("_row")[c].alias(c) for c in kept], *MIXTURE)


#: Columns that mixture() adds.
MIXTURE = ["_size", "source_size", "target", "_shards"]


def mixed(docs: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy, `_shard` and `_order`, the place in the shard, which replace columns of these names. Nulls and ties are as in mixture()."""
    rows = docs.select(F.struct("*").alias("row"), *[F.col(c).alias(name) for c, name in ((id_col, "id"), (text_col, "text"), (source_col, "source"))])
    taken = mixture(rows, shards, "id", "text", "source", weights, share, cap, seed)
    copies = taken.select("row", "id", F.posexplode("_shards").alias("_c", "_shard")).withColumn("_order", _hash(seed + 1, F.col("id"), F.col("_c")))
    return copies.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("_shard", "_order")], "_shard", "_order")


def shuffled(mix: DataFrame, shards: int, parts: int = 4) -> DataFrame:
    """mixed() dealt out, each shard over `parts` tasks by runs of its random order, in that order."""
    part = F.floor(F.col("_order") / F.lit((1 << HASH_BITS) // parts + 1)).cast("int")
    return mix.withColumn("_part", part).repartition(shards * parts, "_shard", "_part").sortWithinPartitions("_shard", "_order").drop("_part")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by row numbers, its shards drawn and shuffled; `taken` sums up what they hold of each document. Texts are read once, to be sized."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sizes = sized(docs, "doc_id", "text", "source", 7).select("doc_id", "_source", "_size", "_h", "_key", F.monotonically_increasing_id().alias("_row"))
    sizes = written(sizes, "sizes")
    drawn = written(drawn_copies(sizes, sizes, None, WEIGHTS, 1.5, 2.0, 7).select("_row", "doc_id", "_size", "source_size", "target", "_shards"), "taken")
    copies = drawn.select("_row", "_size", F.posexplode("_shards").alias("_c", "_shard")).withColumn("_order", _hash(8, F.col("_row"), F.col("_c")))
    mix = written(shuffled(copies, LEAST_SHARDS), "mix")
    taken = mix.groupBy("_row").agg(F.sum("_size").alias("taken"))
    return drawn.join(taken, "_row", "left").select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS n, (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT arg_min(level, n) AS level FROM f WHERE level < cap / weight),
t AS (SELECT source, source_size, CASE WHEN l.level IS NULL OR cap / weight <= l.level THEN cap ELSE l.level * weight END AS target FROM f, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM t),
r AS (SELECT *, target - times * source_size AS rest FROM q),
c AS (SELECT d.*, r.source_size, r.target, r.times, r.rest, sum(size) OVER (PARTITION BY d.source ORDER BY h, CAST(doc_id AS VARCHAR), size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
g AS (SELECT source, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END), 0) AS gap FROM c WHERE rest > 0 GROUP BY source, rest),
x AS (SELECT c.source, arg_min(doc_id, (abs(size - gap), h)) AS extra FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE upto > rest AND abs(size - gap) < gap GROUP BY c.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (times + CASE WHEN rest > 0 AND (upto <= rest OR coalesce(doc_id = x.extra, false)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c LEFT JOIN x ON c.source IS NOT DISTINCT FROM x.source
"""

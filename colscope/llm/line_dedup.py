"""Removal of repeated runs of lines by winnowing, with DataFrame functions only.

Lines with words are hashed. From each line begins the shortest window of at least `min_words` words; where it ends
follows from its content, so that equal runs have equal windows. The least line hash of a window is its fingerprint;
neighbouring windows mostly share theirs, and every repeated run of min_words words or more holds a whole window, and so
a fingerprint that stands at two places. Only windows of such fingerprints go on. They are joined by fingerprint and
content with their first occurrence, which extends a match to the left, window by window. To the right a match goes on
behind its last window, line by line, as long as an earlier place goes on in the same way. Lines of later repeats go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, small, table, written

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with words: row key (_id, _text), _at (number of the line), _k (its place among those with words), _h and _g (two hashes, which tell lines), _w (words), _to (words up to and with it)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.posexplode(F.split(text, "\n", -1)).alias("_at", "_line"))
    hashed = lines.select("_id", "_text", "_at", F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(1), "_line").alias("_g"), F.regexp_count("_line", F.lit(WORD)).cast("long").alias("_w")).where("_w > 0")
    rows = hashed.dropDuplicates(["_id", "_text", "_at"])  # rows that repeat in full are one
    order = Window.partitionBy("_id", "_text").orderBy("_at")
    return rows.withColumns({"_to": F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_k": F.row_number().over(order)})


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Windows: row key, _k (place of the first line), _from, _till (line numbers), _last (place of the last line), _key (128 bits of the lines' hashes), _print and _place (fingerprint and its place)."""
    # offsets grow strictly, as every line has words: the frame is the window
    ahead = Window.partitionBy("_id", "_text").orderBy("_before").rangeBetween(Window.currentRow, min_words - 1)
    rows = lines.withColumn("_before", F.col("_to") - F.col("_w"))
    rows = rows.withColumns({"_win": F.collect_list(F.struct("_h", "_k", "_g", "_at")).over(ahead), "_words": F.sum("_w").over(ahead)}).where(F.col("_words") >= min_words)
    last, least = F.element_at("_win", -1), F.array_min("_win")
    return rows.select(
        "_id", "_text", "_k", F.col("_at").alias("_from"), last["_at"].alias("_till"), last["_k"].alias("_last"),
        F.struct(F.xxhash64(F.transform("_win", lambda x: x["_h"])).alias("a"), F.xxhash64(F.transform("_win", lambda x: x["_g"])).alias("b")).alias("_key"),
        least["_h"].alias("_print"), least["_k"].alias("_place"),
    )


def _same(i: str = "_i", t: str = "_t") -> Column:
    return F.col("_id").eqNullSafe(F.col(i)) & (F.col("_text") == F.col(t))


def _keyed(df: DataFrame, *cols: str) -> DataFrame:
    """df's row key as (_i, _t), with cols."""
    return df.select(F.col("_id").alias("_i"), F.col("_text").alias("_t"), *cols)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`_id`, `_text` (hash of the text), `_gone`: the numbers of the lines that later repeats of a run hold, for rows with any."""
    lines = written(_lines(docs, id_col, text_col), "lines")
    wins = written(windows(lines, min_words), "windows")
    place = F.struct("_id", "_text", "_place")
    prints = wins.groupBy("_print").agg(F.min(place).alias("_p"), F.max(place).alias("_q")).where("_p < _q").select("_print")
    seen = written(wins.join(small(written(prints, "prints")), "_print", "left_semi"), "seen")
    dropped(wins)
    start = F.struct("_id", "_from", "_text")
    first = seen.groupBy("_print", "_key").agg(F.min(start).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    # at most one row a window goes to the join; its other side has each key once, and Spark splits partitions of frequent keys
    later = seen.join(small(written(first, "firsts")), ["_print", "_key"]).where(start > F.col("_first"))
    later = written(later.select("_id", "_text", "_k", "_from", "_till", "_print", "_key"), "later")
    # matches end where the next window is no match; there, all places that hold the last window are looked at
    order = Window.partitionBy("_id", "_text").orderBy("_k")
    ends = later.withColumn("_next", F.lead("_k").over(order)).where("_next is null or _next > _k + 1").select("_print", "_key").distinct()
    ends = written(seen.join(small(written(ends, "ends")), ["_print", "_key"], "left_semi").select("_id", "_text", "_k", "_from", "_last", "_print", "_key"), "members")
    held = small(written(_keyed(ends).distinct(), "held"))
    # lines behind a line, with less than min_words words; longer runs hold a window that begins behind that line
    tail = Window.partitionBy("_id", "_text").orderBy("_to").rangeBetween(Window.currentRow, min_words - 1)
    tails = lines.join(held, _same(), "left_semi").withColumn("_tail", F.collect_list(F.struct("_h", "_g", "_at", "_k")).over(tail))
    on = _same() & (F.col("_k") == F.col("_s"))
    more = ends.join(_keyed(tails, F.col("_k").alias("_s"), "_tail"), on).withColumn("_tail", F.filter("_tail", lambda x: x["_k"] > F.col("_last"))).where(F.size("_tail") > 0)
    both = F.transform(F.slice("_tail", F.lit(1), F.col("_n") + 1), lambda x: F.struct(x["_h"], x["_g"]))
    more = more.select("*", F.posexplode("_tail").alias("_n", "_line")).withColumn("_more", F.struct(F.xxhash64(both).alias("a"), F.xxhash64(F.lit(1), both).alias("b")))
    more = written(more.select("_id", "_text", "_from", "_print", "_key", "_more", F.col("_line._at").alias("_at")), "tails")
    first = more.groupBy("_print", "_key", "_more").agg(F.min(start).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    behind = more.join(small(written(first, "tail-firsts")), ["_print", "_key", "_more"]).where(start > F.col("_first"))
    gone = later.select("_id", "_text", "_from", "_till").unionByName(behind.select("_id", "_text", F.col("_at").alias("_from"), F.col("_at").alias("_till")))
    edges = gone.select("_id", "_text", F.explode(F.array(F.struct(F.col("_from").alias("_at"), F.lit(1).alias("_d")), F.struct((F.col("_till") + 1).alias("_at"), F.lit(-1).alias("_d")))).alias("e"))
    marks = written(edges.groupBy("_id", "_text", F.col("e._at").alias("_at")).agg(F.sum("e._d").alias("_d"), F.lit(0).alias("_line")), "marks")
    dropped(seen, later, ends, more)
    own = lines.join(small(written(_keyed(marks).distinct(), "touched")), _same(), "left_semi")
    both = marks.unionByName(own.select("_id", "_text", "_at", F.lit(0).cast("long").alias("_d"), F.lit(1).alias("_line")))
    both = both.groupBy("_id", "_text", "_at").agg(F.sum("_d").alias("_d"), F.max("_line").alias("_line"))
    depth = F.sum("_d").over(Window.partitionBy("_id", "_text").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = both.withColumn("_depth", depth).where("_depth > 0 and _line = 1")
    out = written(inside.groupBy("_id", "_text").agg(F.collect_list("_at").alias("_gone")), "gone")
    dropped(lines, marks)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `_kept` (the text without later repeats of runs of lines), `_n_lines` and `_n_gone`, which replace columns of these names.

    A run is a sequence of neighbouring lines with words, lines without any being passed over; it is removed where an
    equal run of min_words words or more stands at an earlier place, in order of id and line. A run may repeat inside
    one text. Lines without words stay. A null text counts as empty and has one line; null ids come first. Rows that
    repeat id and text are one place, and get the same result. Empty docs give an empty result. Lines are told by 128
    bits of hashes.
    """
    gone = _keyed(repeated_lines(docs, id_col, text_col, min_words), "_gone")
    gone = small(gone, weight=64 + 4 * F.size("_gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # docs' own columns are in a struct, so that no name of theirs meets one of these
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), text.alias("_whole"), F.xxhash64(text).alias("_text")).join(gone, _same(), "left")
    lines = F.split("_whole", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("_whole")).otherwise(F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n"))
    added = {"_kept": kept, "_n_lines": F.size(lines).cast("long"), "_n_gone": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *[v.alias(c) for c, v in added.items()])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_gone").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
n AS (SELECT *, CAST(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS BIGINT) AS w FROM e),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM n WHERE w > 0),
f AS (SELECT doc_id, pos, list(pos) OVER a AS poss, list(line) OVER a AS win, sum(w) OVER a AS words FROM (SELECT *, upto - w AS before FROM c)
      WINDOW a AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
b AS (SELECT doc_id, pos, list(pos) OVER a AS poss, list(line) OVER a AS win, sum(w) OVER a AS words FROM c
      WINDOW a AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
x AS (SELECT 1 AS way, * FROM f WHERE words >= 50 UNION ALL SELECT 2, * FROM b WHERE words >= 50),
y AS (SELECT *, min((doc_id, poss[1])) OVER (PARTITION BY way, win) AS first FROM x),
g AS (SELECT DISTINCT doc_id, unnest(poss) AS pos FROM y WHERE (doc_id, poss[1]) > first),
k AS (SELECT e.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
      FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
"""

"""Exact deduplication by skew-safe combining.

Equal copies are merged in three steps: inside each task (the map side of the first aggregate), then inside salted
digest groups, then over the salts' winners. Every step groups by the digest *and the full text*, so that two texts
with one digest never meet. Where the digests that occur twice are few enough to be sent to all tasks, texts with other
digests are left out before the first step, so that their content never leaves its task; else all rows take the three steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, table, written


def _digested(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = digest or (lambda c: F.sha2(c, 256))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text"), digest(text).alias("_digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: `_id`, `keep_id`, `group_size`, `kept`, `_digest`.

    Of rows with equal texts that with the largest id is kept. A null text counts as empty. Rows that repeat an id and
    its text are one document twice: all of them carry the same `kept`. A null id is below every other; a group with
    null ids only keeps null. An empty table gives an empty result; columns other than id and text are not read,
    whatever their names. Digests of more than `rows` repeated texts are not broadcast.
    `digest` maps a text column to a digest column; a weak one costs time but no correctness.
    """
    base = _digested(docs, id_col, text_col, digest)
    members = base.select("_id", "_digest")
    repeated = written(members.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest"), "digests")
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts))
    several = base.join(F.broadcast(repeated), "_digest", "left_semi") if repeated.limit(rows + 1).count() <= rows else base
    salted = (
        several.groupBy("_digest", salt.alias("_salt"), "_text")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )
    classes = written(salted.groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size")), "classes")
    by_digest = written(
        classes.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.max("_keep").alias("_keep"), F.max("_size").alias("_size")), "winners"
    )
    clashing = by_digest.where("_texts > 1").select("_digest")
    joined = members.join(small(by_digest), "_digest", "left")
    if not clashing.isEmpty():  # two texts with one digest: their rows are told apart by content
        alone = joined.where("_texts is null or _texts = 1")
        told = base.join(clashing, "_digest", "left_semi").join(classes.withColumn("_texts", F.lit(2).cast("long")), ["_digest", "_text"])
        joined = alone.unionByName(told.select(*alone.columns))
    single = F.col("_texts").isNull()
    keep = F.when(single, F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        "_id",
        keep.alias("keep_id"),
        F.when(single, F.lit(1)).otherwise(F.col("_size")).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        "_digest",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of docs that exact_dedup keeps, each once, with docs' columns. Rows are told by id and digest, so that another text with the same id stays.

    Nulls, empty texts, repeated rows and empty tables are as in exact_dedup; columns may have any names.
    """
    verdict = exact_dedup(docs, id_col, text_col, salts).where("group_size > 1").select("_id", "_digest", "kept")
    verdict = written(verdict, "verdict")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_sha"))
    same = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_digest"))
    left = rows.join(small(written(verdict.where("not kept").drop("kept").distinct(), "gone")), same, "left_anti")
    doubled = written(verdict.where("kept").groupBy("_id", "_digest").count().where("count > 1").drop("count"), "doubled")
    if not doubled.isEmpty():
        again = left.join(small(doubled), same, "left_semi").dropDuplicates(["_i", "_sha"])
        left = left.join(small(doubled), same, "left_anti").unionByName(again)
    return left.select("_row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("_digest").alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

"""A corpus from raw documents: toxic texts go, equal texts go, near copies go, sources are mixed, texts become token ids.

All stages but the last return the columns that they get, whatever further columns there are. Null and empty texts are
empty documents: they are not toxic, one of them stays among equal ones, they have no near copies, and the mix takes
them with size 0. Null ids stay null ids. Rows that repeat in full are equal texts. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.llm import exact_dedup, mixing, near_dedup, sentencepiece_codec, toxicity
from colscope.llm.common import table, written

#: Output shards of the mix.
SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on these documents' labels, does not call toxic. Of texts without words only the chain's constants decide."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the document with the largest doc_id; of rows that repeat it, one."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; texts without words, and rows without an id, are in no group."""
    return near_dedup.keep_firsts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each time that it takes a document, dealt to SHARDS shards that are each in random order."""
    whole = docs.select(F.struct("*").alias("document"), "doc_id", "text", "source")  # so that no column meets one of the mix
    return mixing.shuffled(mixing.mixed(whole, SHARDS), SHARDS).select("document.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: its ids with an end id, and the text decoded from them. Other columns end here; a null or empty text has the end id only."""
    path = sentencepiece_codec.model_path()
    return sentencepiece_codec.round_trip(docs, path).withColumnRenamed("_id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

"""Toxicity by a classifier chain.

Categories are predicted one after another. The model of a category sees words and, besides, the probabilities of all
earlier categories; it is trained with out-of-fold probabilities, so that it learns from earlier predictions as good as
those that it gets later. All models are linear (logistic regression) over how often hashed words and
word beginnings occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written
from .words import CODE, IS_ALNUM, flat_texts, hashes, mix, powers, spans

#: Hash buckets of words and word beginnings (first bytes).
BUCKETS = 1 << 19
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A feature is a bucket with a level: how often, or how densely, a text has it at least.
OFTEN, DENSE = (1, 2, 4, 8), (1 / 200, 1 / 50, 1 / 20)
LEVELS = 8
#: Features that the models use, at most.
FEATURES = 4096
#: Labelled documents that the models are fitted on, at most: those with the smallest hashes of their ids.
MAX_TRAIN = 20_000
#: Rows whose features are made floats at once.
BLOCK_ROWS = 256
FOLDS = 5
#: (category, label expression: 1, 0 or null), in the chain's order; the last one is the verdict's.
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))


def least_chi_square(n: int) -> float:
    """The least chi-square that a feature must have with a category, given n labelled documents: at 30 chance alone hardly gives it to any of a million features; of few documents a word has few, so that less is asked."""
    return 20 + min(10.0, n / 400)


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different (text, bucket * LEVELS + level) pairs as two arrays; `wanted` flags the buckets to look at."""
    column = pa.array([t.lower() if t else "" for t in texts], pa.string())
    data, offsets = flat_texts(column)
    starts, ends, counts = spans(data, offsets, IS_ALNUM)
    owner = np.repeat(np.arange(len(texts)), counts)
    keys = []

    def take(hash_: np.ndarray, of: np.ndarray) -> None:
        bucket = (hash_ & np.uint64(BUCKETS - 1)).astype(np.int64)
        if wanted is not None:
            mine = wanted[bucket]
            bucket, of = bucket[mine], of[mine]
        keys.append(of * BUCKETS + bucket)

    take(hashes(data, starts, ends), owner)
    lens, part, base = ends - starts, np.zeros(len(starts), np.uint64), powers(max(PREFIXES))
    for k in range(max(PREFIXES)):
        if k:
            longer = lens > k
            starts, lens, part, owner = starts[longer], lens[longer], part[longer], owner[longer]
        part = part + CODE[data[starts + k]] * base[k]
        if k + 1 in PREFIXES:  # a word as long as the prefix counts as well
            take(mix(part + np.uint64((k + 1) * 0x632BE59BD9B4E019 % 2**64)), owner)
    both, times = np.unique(np.concatenate(keys), return_counts=True)
    density = times / np.maximum(1, counts)[both // BUCKETS]
    out = [both[times >= least] * LEVELS + level for level, least in enumerate(OFTEN)]
    out += [both[density >= least] * LEVELS + len(OFTEN) + level for level, least in enumerate(DENSE)]
    every = np.sort(np.concatenate(out))
    return every // (BUCKETS * LEVELS), every % (BUCKETS * LEVELS)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    from .sentencepiece_codec import pieces_of

    return pieces_of(texts, 1_000_000)


@dataclass
class Chain:
    """column[feature] is a feature's number in the models or -1; weights[c] are those of category c: features, earlier categories, constant."""

    names: list[str]
    column: np.ndarray
    weights: list[np.ndarray]

    def __post_init__(self):
        self.wanted = (self.column.reshape(BUCKETS, LEVELS) >= 0).any(axis=1)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """[text, category]."""
        out = np.zeros((len(texts), len(self.names)))
        for i, j in _slices(texts):
            row, bucket = features(texts[i:j], self.wanted)
            col = self.column[bucket].astype(np.int64)
            row, col = row[col >= 0], col[col >= 0]
            for c, w in enumerate(self.weights):
                out[i:j, c] = sigmoid(logits(row, col, j - i, out[i:j, :c], w))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def odds(p: np.ndarray) -> np.ndarray:
    """Earlier probabilities enter as log odds."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def logits(row: np.ndarray, col: np.ndarray, n: int, earlier: np.ndarray, w: np.ndarray) -> np.ndarray:
    k = len(w) - 1 - earlier.shape[1]
    return np.bincount(row, w[col], n) + odds(earlier) @ w[k:-1] + w[-1]


def blocks(x: np.ndarray, more: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of x (bytes) and of more (floats) side by side as floats, BLOCK_ROWS at once; each block is overwritten by the next one."""
    k = x.shape[1]
    block = np.empty((BLOCK_ROWS, k + more.shape[1]), np.float32)
    for i in range(0, len(x), BLOCK_ROWS):
        at = slice(i, min(i + BLOCK_ROWS, len(x)))
        block[: at.stop - i, :k], block[: at.stop - i, k:] = x[at], more[at]
        yield at, block[: at.stop - i]


def fit(x: np.ndarray, more: np.ndarray, y: np.ndarray, known: np.ndarray, steps: int = 300, l2: float = 1e-4, rate: float = 0.1) -> np.ndarray:
    """Weights[column, model] of logistic regressions on x's columns (0 or 1, a byte each) and more's (floats, the last one constant), all fitted at once by Adam over the same rows; known[row, model] flags the rows that a model may see.

    Of both classes the rarer weighs more, by the square root of their ratio. A model that sees one class only, or no
    row, gets a constant.
    """
    w = np.zeros((x.shape[1] + more.shape[1], known.shape[1]), np.float32)
    ones, n = (known * y[:, None]).sum(0), known.sum(0)
    plain = (ones == 0) | (ones == n)
    share = np.where(plain, 0.5, ones / np.maximum(n, 1))
    sample = known * np.where(y[:, None] == 1, np.sqrt((1 - share) / share), 1.0)
    sample = (sample / np.maximum(sample.sum(0), 1e-9)).astype(np.float32)
    m, v, target = np.zeros_like(w), np.zeros_like(w), y[:, None].astype(np.float32)
    for t in range(1, steps + 1):
        g = np.zeros_like(w)
        for at, b in blocks(x, more):
            g += b.T @ ((sigmoid(b @ w) - target[at]) * sample[at])
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    w[:, plain] = 0
    w[-1, plain] = np.where((n > 0) & (ones == n), 8.0, -8.0)[plain]
    return w


def training_rows(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str]], id_col: str, text_col: str, max_train: int) -> DataFrame:
    """`_id`, `_text` and a label column per category of at most max_train labelled documents. Of an id with several label rows the largest of each label counts; documents that repeat an id all have its labels."""
    given = labels.select(F.col(id_col).alias("_id"), *[F.expr(e).cast("int").alias(f"_y_{c}") for c, e in categories]).where("_id is not null")
    given = given.groupBy("_id").agg(*[F.max(f"_y_{c}").alias(f"_y_{c}") for c, _ in categories])
    chosen = written(given.orderBy(F.xxhash64("_id"), "_id").limit(max_train), "labelled")
    return written(docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(small(chosen), "_id"), "training")


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str]] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Chain:
    """A chain fitted on at most max_train labelled documents.

    Features are counted in the cluster and the FEATURES that tell a category's classes apart best are kept; the driver
    then gets these features of the training rows only. A null label leaves the row out of that category's model. A
    category without labels of both classes has a constant probability, near that of its one class, or near zero without any.
    Null and empty texts have no features. Labels with a null id, or without a document, are not used. Empty tables
    give a chain of constants. Other columns are not read, whatever their names.
    """
    names = [c for c, _ in categories]
    rows = training_rows(docs, labels, categories, id_col, text_col, max_train)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = BUCKETS * LEVELS
        sums = np.zeros((2 * len(names), size), np.int32)
        for b in batches:
            y = [b.column(1 + c).to_pylist() for c in range(len(names))]
            texts = b.column(0).to_pylist()
            for i, j in _slices(texts):
                row, bucket = features(texts[i:j])
                for c in range(len(names)):
                    for kind in (0, 1):
                        of = np.array([v == kind for v in y[c][i:j]])
                        np.add(sums[2 * c + kind], np.bincount(bucket[of[row]], minlength=size), out=sums[2 * c + kind], casting="unsafe")
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(s[at]) for s in sums]], ["bucket", *[f"n{k}_{c}" for c in names for k in (0, 1)]])

    schema = ", ".join(["bucket long", *[f"n{k}_{c} int" for c in names for k in (0, 1)]])
    labels_ = [f"_y_{c}" for c in names]
    seen = rows.select("_text", *labels_).mapInArrow(count, schema).groupBy("bucket").agg(*[F.sum(f"n{k}_{c}").alias(f"n{k}_{c}") for c in names for k in (0, 1)])
    totals = rows.agg(*[F.coalesce(F.sum((F.col(f"_y_{c}") == k).cast("long")), F.lit(0)).alias(f"n{k}_{c}") for c in names for k in (0, 1)]).first()
    seen = written(seen, "features")
    kept: list[int] = []
    for c in names:
        both = totals[f"n0_{c}"] and totals[f"n1_{c}"]
        if both:
            chi = _tells(F.col(f"n1_{c}"), F.col(f"n0_{c}"), totals[f"n1_{c}"], totals[f"n0_{c}"])
            top = seen.where(chi >= least_chi_square(totals[f"n0_{c}"] + totals[f"n1_{c}"])).orderBy(chi.desc(), "bucket").limit(FEATURES // len(names))
            kept += [r.bucket for r in top.collect()]
    kept = sorted(set(kept))
    column = np.full(BUCKETS * LEVELS, -1, np.int16)
    column[kept] = np.arange(len(kept))
    sent = docs.sparkSession.sparkContext.broadcast(Chain(names, column, []))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                row, bucket = features(texts[i:j], sent.value.wanted)
                col = sent.value.column[bucket].astype(np.int32)
                row, col = row[col >= 0], col[col >= 0]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in [0, *range(2, 2 + len(names))]], pa.ListArray.from_arrays(pa.array(offsets), pa.array(col))], ["_id", *labels_, "cols"])

    ids = rows.select("_id").schema[0].dataType.simpleString()
    got = rows.select("_id", "_text", *labels_).mapInArrow(chosen, f"_id {ids}, {', '.join(f'`{x}` int' for x in labels_)}, cols array<int>")
    got = got.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS))).drop("_id").toArrow()
    fold, n, at = got["fold"].to_numpy(), got.num_rows, 0
    x = np.zeros((n, len(kept)), np.uint8)  # MAX_TRAIN x FEATURES at most
    for part in got["cols"].chunks:
        lens = part.value_lengths().to_numpy(zero_copy_only=False)
        x[np.repeat(np.arange(at, at + len(part)), lens), part.flatten().to_numpy(zero_copy_only=False)] = 1
        at += len(part)
    got = got.drop_columns(["cols"])
    weights, earlier = [], np.zeros((n, 0))
    for c in names:
        label = got[f"_y_{c}"].to_pandas().to_numpy(dtype=np.float64, na_value=np.nan)
        known = ~np.isnan(label)
        seen_by = np.column_stack([*[known & (fold != f) for f in range(FOLDS)], known])
        more = np.column_stack([odds(earlier), np.ones(n)]).astype(np.float32)
        w = fit(x, more, np.where(known, label, 0.0), seen_by)
        weights.append(w[:, -1].astype(np.float64))
        out_of_fold = np.zeros(n)
        for at, b in blocks(x, more):
            out_of_fold[at] = sigmoid((b @ w)[np.arange(len(b)), fold[at]].astype(np.float64))
        earlier = np.column_stack([earlier, out_of_fold])
    return Chain(names, column, weights)


def _tells(one: Column, zero: Column, ones: int, zeros: int) -> Column:
    """Chi-square of a feature with a class, from the documents of each class that have it."""
    a, b = one.cast("double"), zero.cast("double")
    c, d = F.lit(float(ones)) - a, F.lit(float(zeros)) - b
    n = float(ones + zeros)
    below = (a + b) * (c + d) * (ones * zeros)
    return F.when(below > 0, F.lit(n) * F.pow(a * d - b * c, 2) / below).otherwise(0.0)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`_id`, `p_<category>` for each category, and a boolean named as the last one: its probability is at least the threshold.

    Null ids and repeated rows stay as they are; a null or empty text gets the probabilities that the constants give.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    ids = docs.select(id_col).schema[0].dataType.simpleString()
    cols = [f"p_{c}" for c in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = sent.value.probabilities(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(p[:, c])) for c in range(p.shape[1])], pa.array(p[:, -1] >= threshold)], ["_id", *cols, chain.names[-1]])

    return docs.select(id_col, text_col).mapInArrow(run, ", ".join([f"_id {ids}", *[f"`{c}` double" for c in cols], f"`{chain.names[-1]}` boolean"]))


def clean(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of docs whose text is not rejected, with docs' columns; null and empty texts stay unless the chain's constants reject them."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.probabilities(b.column(at).to_pylist())[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("_id", "doc_id")

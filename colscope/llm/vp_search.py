"""Nearest neighbours by cosine with a vantage-point tree per shard.

Vectors are dealt to shards of a stated size. A shard is one row of a written table and holds its different vectors,
scaled to length one, in a tree of balls around vantage points. Trees stay where they are: queries are sent to all tasks
in chunks of bounded size, and walk down each tree together; a branch is left out where the triangle inequality shows
that it holds nothing nearer than what the task has found so far. `factor` relaxes that: above one, branches are left
out sooner, and near misses are possible; one gives an exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

LEAF = 64
#: Queries that walk down a tree together.
BLOCK_ROWS = 512
#: Bytes of queries that are sent to the tasks at once.
CHUNK_BYTES = 32 << 20
#: Cosines from matrix products differ from the exact measure by less; branches and vectors within it are looked at exactly.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """`_id`, `_vec` array<double>, `_dim` of rows with an id whose vector is not null, empty or zero, and has finite components only; rows that repeat in full are one."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col(id_col).alias("_id"), v.alias("_vec"), F.size(v).alias("_dim")).dropDuplicates(["_id", "_vec"])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows, sums running in order of the components, so that equal vectors get equal values wherever they stand."""
    def dot(x, y):
        out = np.zeros(len(x))
        for k in range(x.shape[1]):
            out += x[:, k] * y[:, k]
        return out

    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


class Tree:
    """A shard: vectors[n, dim] in double precision, their ids as runs of `ids`, ascending, and the tree's nodes.

    A node is (place of its vantage point, radii of the inner and outer part as lo, hi, their children); a leaf's
    child number is negative and names a range of `order`.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors, of = np.unique(vectors, axis=0, return_inverse=True)
        of = of.reshape(-1)
        order = np.lexsort((ids, of))
        self.ids, self.counts = ids[order], np.bincount(of, minlength=len(self.vectors))
        self.starts = np.cumsum(self.counts) - self.counts
        self.unit = self.vectors / np.linalg.norm(self.vectors / np.abs(self.vectors).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(self.vectors).max(1, keepdims=True)
        self.nodes, self.leaves = [], []
        self.root = self._build(np.arange(len(self.vectors)), np.random.default_rng(7), leaf)

    def _build(self, rows: np.ndarray, rng, leaf: int) -> int:
        """Number of a node, or ~number of a leaf; without recursion in depth beyond log2 of the rows, as halves are cut by rank."""
        if len(rows) <= leaf:
            self.leaves.append(rows)
            return ~(len(self.leaves) - 1)
        v = int(rows[rng.integers(len(rows))])
        d = chord(self.unit[rows] @ self.unit[v])
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        at = len(self.nodes)
        self.nodes.append(None)
        spans = (d[inner].min(), d[inner].max(), d[outer].min(), d[outer].max())
        self.nodes[at] = (v, *spans, self._build(rows[inner], rng, leaf), self._build(rows[outer], rng, leaf))
        return at

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float = 1.0, so_far: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of queries, id, cosine) of the k nearest to each query found here, its own id excepted; ties go to smaller ids. `so_far` has cosines and ids (queries x k) that other trees gave; it is updated."""
        self.q, self.qid, self.k, self.factor = queries, query_ids, k, factor
        big = np.abs(queries).max(1, keepdims=True)
        self.qu = queries / np.linalg.norm(queries / big, axis=1, keepdims=True) / big
        n = len(queries)
        self.best, self.best_id = so_far or none_yet(n, k)
        self.worst = self.best[:, -1].copy()  # the k-th best cosine so far
        self.seen = 0
        self.home = np.full(n, -1)  # the leaf that a query falls into; it is searched first, so that pruning begins with near vectors
        if len(self.vectors) and n:
            self._descend(self.root, np.arange(n))
            self._walk(self.root, np.arange(n))
        rows, places = np.nonzero(self.best > -np.inf)
        return rows, self.best_id[rows, places], self.best[rows, places]

    def _descend(self, node: int, active: np.ndarray) -> None:
        if not len(active):
            return
        if node < 0:
            self.home[active] = ~node
            return self._leaf(self.leaves[~node], active)
        v, _, hi_in, lo_out, _, inner, outer = self.nodes[node]
        near = chord(self.qu[active] @ self.unit[v]) <= (hi_in + lo_out) / 2
        self._descend(inner, active[near])
        self._descend(outer, active[~near])

    def _walk(self, node: int, active: np.ndarray) -> None:
        if node < 0:
            active = active[self.home[active] != ~node]
            return self._leaf(self.leaves[~node], active) if len(active) else None
        v, lo_in, hi_in, lo_out, hi_out, inner, outer = self.nodes[node]
        d = chord(self.qu[active] @ self.unit[v])
        for child, lo, hi in ((inner, lo_in, hi_in), (outer, lo_out, hi_out)):
            off = np.maximum(lo - d, d - hi)  # no point of the child is nearer than this
            # a cosine within SLACK of the worst is a distance that much nearer
            open_ = off * self.factor <= chord(self.worst[active] - SLACK) + 1e-7
            if open_.any():
                self._walk(child, active[open_])

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        self.seen += len(rows) * len(active)
        near = self.qu[active] @ self.unit[rows].T
        limit = self.worst[active].copy()
        if len(rows) > self.k + 1:  # the leaf's own (k+1)-th best bounds what can matter; one may be the query itself
            limit = np.maximum(limit, -np.partition(-near, self.k, axis=1)[:, self.k])
        a, r = np.nonzero(near >= (limit - SLACK)[:, None])
        score = cosine(self.q[active[a]], self.vectors[rows[r]])
        points = rows[r]
        # ids of the points: all but repeated vectors have one, of those the k smallest that aren't the query's
        ids = self.ids[self.starts[points]]
        many = np.flatnonzero(self.counts[points] > 1)
        fine = (self.counts[points] == 1) & (ids != self.qid[active[a]])
        a_, ids_, score_ = [a[fine]], [ids[fine]], [score[fine]]
        for j in many.tolist():
            own = self.ids[self.starts[points[j]] + self._not(points[j], active[a[j]])][: self.k]
            a_.append(np.full(len(own), a[j]))
            ids_.append(own)
            score_.append(np.full(len(own), score[j]))
        a, ids, score = np.concatenate(a_), np.concatenate(ids_), np.concatenate(score_)
        which, a = np.unique(a, return_inverse=True)
        if not len(which):
            return
        q = active[which]
        owner = np.concatenate([np.repeat(np.arange(len(q)), self.k), a])
        ids, score = np.concatenate([self.best_id[q].reshape(-1), ids]), np.concatenate([self.best[q].reshape(-1), score])
        order = np.lexsort((ids, -score, owner))
        first = np.searchsorted(owner[order], np.arange(len(q)))
        take = order[first[:, None] + np.arange(self.k)]
        self.best_id[q], self.best[q] = ids[take], score[take]
        self.worst[q] = self.best[q, -1]

    def _not(self, p: int, q: int) -> np.ndarray:
        """Places of the k smallest ids of point p that aren't the query's."""
        own = self.ids[self.starts[p] : self.starts[p] + self.counts[p]]
        lo, hi = np.searchsorted(own, self.qid[q], "left"), np.searchsorted(own, self.qid[q], "right")
        return np.concatenate([np.arange(min(lo, self.k)), np.arange(hi, min(len(own), hi + self.k))])

    def dump(self) -> bytes:
        import pickle

        return pickle.dumps({x: getattr(self, x) for x in ("vectors", "ids", "counts", "starts", "unit", "nodes", "leaves", "root")}, protocol=5)

    @classmethod
    def load(cls, data: bytes) -> "Tree":
        import pickle

        out = cls.__new__(cls)
        out.__dict__.update(pickle.loads(data))
        return out


def none_yet(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)


def chord(cos: np.ndarray) -> np.ndarray:
    """Distance of unit vectors with this cosine; a true metric."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(cos, -1.0)))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 4096) -> DataFrame:
    """A written table with a row per shard: `shard`, `dim`, `n`, `tree`. Every usable vector is in one; shards have about shard_rows vectors, being dealt by a hash of the id."""
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    sizes = {r._dim: -(-r.n // shard_rows) for r in rows.groupBy("_dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows.sparkSession.createDataFrame([], "shard long, dim int, n long, tree binary")
    count = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("_dim"))
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("_id"), count))

    def run(key, group):
        dim = key[1].as_py()
        tree = Tree(group["_id"].to_numpy(), group["_vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()), "n": pa.array([group.num_rows], pa.int64()), "tree": pa.array([tree.dump()], pa.binary())})

    return written(dealt.groupBy("_shard", "_dim").applyInArrow(run, "shard long, dim int, n long, tree binary"), "trees")


def search(index: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: the k nearest of the index for each query, its own id excepted.

    Nearest is the largest cosine in double precision; ties go to the smaller id. Only vectors of a query's length are
    compared. Queries that can't be used (see usable()) get no rows; those with fewer than k candidates get all.
    A query with the id of another but a different vector is a query by itself. The queries go to the tasks in chunks of
    about chunk_bytes; each chunk reads the trees once. Tasks give k rows a query, whatever the number of their trees.
    An empty table on either side gives an empty result. Other columns are not read, whatever their names.
    """
    asked = written(usable(queries, id_col, vec_col), "queries")
    total = asked.agg(F.sum(F.col("_dim").cast("long") * 8 + 16)).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    found = None
    for c in range(chunks):
        mine = asked.where(F.pmod(F.xxhash64("_id", "_vec"), F.lit(chunks)) == c).orderBy("_dim", "_id", "_vec").toArrow()  # about chunk_bytes
        part = _found(index, mine, k, factor, c)
        part = written(part, f"found{c}") if chunks > 1 else part
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("q", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(index: DataFrame, asked: pa.Table, k: int, factor: float, chunk: int) -> DataFrame:
    """`q` (number of the query), `query_id`, `vec_id`, `score`: for each task the k nearest of its trees."""
    dims, ids = asked["_dim"].to_numpy(), asked["_id"].to_numpy().astype(np.int64)
    flat = asked["_vec"].combine_chunks().flatten().to_numpy() if asked.num_rows else np.zeros(0)
    sent = index.sparkSession.sparkContext.broadcast((dims, ids, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, ids, flat = sent.value
        starts = np.cumsum(dims.astype(np.int64)) - dims
        best: dict[int, tuple] = {}
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column(0)[r].as_py()
                rows = np.flatnonzero(dims == dim)  # in one run, as they are sorted
                if len(rows):
                    vecs = flat[starts[rows[0]] : starts[rows[0]] + len(rows) * dim].reshape(len(rows), dim)
                    so_far = best.setdefault(dim, none_yet(len(rows), k))
                    tree = Tree.load(b.column(1)[r].as_buffer())
                    for i in range(0, len(rows), BLOCK_ROWS):
                        part = slice(i, i + BLOCK_ROWS)
                        tree.search(vecs[part], ids[rows[part]], k, factor, (so_far[0][part], so_far[1][part]))
        for dim, (score, near) in best.items():
            rows = np.flatnonzero(dims == dim)
            q, at = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(chunk << 32 | rows[q]), pa.array(ids[rows[q]]), pa.array(near[q, at]), pa.array(score[q, at])], ["q", "query_id", "vec_id", "score"])

    return index.select("dim", "tree").mapInArrow(run, "q long, query_id long, vec_id long, score double")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build_index(vectors), vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.n * c.n) AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

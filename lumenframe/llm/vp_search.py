"""Nearest neighbours by largest inner product: a vantage-point tree per shard, pruned by the triangle inequality.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm of all rows: for a query (0 in that coordinate) the nearest point has
the largest inner product. A subtree is left out if factor * (lower bound of its distances) is beyond the query's 20th distance so far. Factor 1 is exact; a larger
factor prunes more.

Scale: vectors are dealt to shards by a hash of their id and queries to blocks; each (shard, block) is one task of bounded size, and each query's best of all shards, 20 a
shard, are ranked at the end. Trees are built over every vector. Inner products that decide are added in the order of components, in double precision.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, nor do rows without id; queries
that share an id are one query, whose own id is no candidate; ties go to the smaller vec_id; with fewer than k candidates all are returned.
Extra input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, EVERY = 20, 20
FACTOR = 1.0
SHARD_ROWS, BLOCK_QUERIES, LEAF = 8_192, 2_048, 256
#: Below this relative difference, matrix products don't decide.
SLACK = 1e-9


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added strictly in order."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * x[:, j]
    return total


class Tree:
    """Vantage-point tree over points whose last coordinate makes them lie on one sphere."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, norm: float, leaf: int = LEAF, seed: int = 5):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = x[order], ids[order]
        self.lift = np.sqrt(np.maximum(0.0, norm * norm - (self.x * self.x).sum(axis=1)))
        self.norm, self.leaf, self.rng = norm, leaf, np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(ids)))

    def _distance(self, i: int, rows: np.ndarray) -> np.ndarray:
        d = ((self.x[rows] - self.x[i]) ** 2).sum(axis=1) + (self.lift[rows] - self.lift[i]) ** 2
        return np.sqrt(d)

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        v = int(rows[self.rng.integers(len(rows))])
        d = self._distance(v, rows)
        middle = np.median(d)
        inside = d <= middle
        if inside.all():
            inside = d < middle
        if not inside.any() or inside.all():
            return rows  # all at one distance
        bounds = (d[inside].min(), d[inside].max(), d[~inside].min(), d[~inside].max())
        return v, bounds, self._grow(rows[inside]), self._grow(rows[~inside])

    def search(self, q: np.ndarray, qids: np.ndarray, k: int = K, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), each len(q) x k, best first; unused places are -inf and -1. visited counts the leaf rows compared."""
        self.q, self.qids, self.k, self.factor = q, qids, k, factor
        self.q2 = (q * q).sum(axis=1)
        self.score = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), -1, np.int64)
        self.visited = 0
        self._visit(self.root, np.arange(len(q)), np.zeros(len(q)))
        return self.score, self.found

    def _reach(self, at: np.ndarray) -> np.ndarray:
        """The distance of the k-th best so far."""
        worst = self.score[at, -1]
        return np.where(np.isfinite(worst), np.sqrt(np.maximum(0.0, self.q2[at] + self.norm**2 - 2 * worst)) + SLACK, np.inf)

    def _visit(self, node, at: np.ndarray, low: np.ndarray) -> None:
        fits = self.factor * low <= self._reach(at)
        at, low = at[fits], low[fits]
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            self._scan(node, at)
            return
        v, (a, b, c, d), near, far = node
        own = np.sqrt(np.maximum(0.0, self.q2[at] + self.norm**2 - 2 * (self.q[at] @ self.x[v])))
        to_near = np.maximum(low, np.maximum(a - own, own - b))
        to_far = np.maximum(low, np.maximum(c - own, own - d))
        first = to_near <= to_far
        for side, x, y, dx, dy in ((first, near, far, to_near, to_far), (~first, far, near, to_far, to_near)):
            if side.any():
                self._visit(x, at[side], dx[side])
                self._visit(y, at[side], dy[side])

    def _scan(self, rows: np.ndarray, at: np.ndarray) -> None:
        for i in range(0, len(rows), 1024):
            part = rows[i : i + 1024]
            rough = self.q[at] @ self.x[part].T
            self.visited += rough.size
            slack = SLACK * (1 + np.abs(rough))
            may = (rough + slack >= self.score[at, -1][:, None]) & (self.ids[part][None, :] != self.qids[at][:, None])
            qi, xi = np.nonzero(may)
            if not len(qi):
                continue
            exact = exact_products(self.q[at[qi]], self.x[part[xi]])
            for own in np.unique(qi):
                hit = qi == own if len(at) == 1 else slice(np.searchsorted(qi, own), np.searchsorted(qi, own, side="right"))
                r = at[own]
                s = np.concatenate([self.score[r], exact[hit]])
                n = np.concatenate([self.found[r], self.ids[part[xi[hit]]]])
                best = np.lexsort((np.where(n < 0, np.iinfo(np.int64).max, n), -s))[: self.k]
                self.score[r], self.found[r] = s[best], n[best]


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score). Both sides: (vec_id, embedding)."""
    x, q = valid(vectors), valid(queries)
    most = x.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c"), F.max(F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a)).alias("m")).orderBy(F.desc("c"), "n").first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, count, norm = most[0], most[1], float(np.sqrt(most[2]))
    x, q = x.filter(F.size("v") == size), q.filter(F.size("v") == size)
    shards, blocks = -(-count // shard_rows), max(1, -(-q.count() // block_queries))
    left = x.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = q.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))

    def run(key, xs: pa.Table, qs: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(xs) or not len(qs):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        rows = lambda t: np.asarray(pa.compute.list_flatten(t["v"].combine_chunks()), float).reshape(-1, size)
        tree = Tree(rows(xs), np.asarray(xs["vec_id"]), norm)
        qids = np.asarray(qs["vec_id"])
        score, found = tree.search(rows(qs), qids, k, factor)
        used = np.isfinite(score)
        who = np.repeat(qids, k).reshape(-1, k)
        return pa.table([pa.array(who[used]), pa.array(found[used]), pa.array(score[used])], names)

    best = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(v, v.filter(F.col("vec_id") % EVERY == 0))


SQL = None

"""MinHash near-duplicate removal with tensored banding.

Two collections of 10 groups of 3 minhashes each are computed, 60 in all; table key (i, j) combines group i of the first with group j of the second, so 100 tables
of 6 rows cost a tenth of the 600 minhashes that independent tables would take. Two documents meet if one group of either collection agrees: at similarity 0.8 with
probability (1 - (1 - 0.8^3)^10)^2 = 0.998, at 0.05 with 2e-6. Candidates are confirmed on full shingle sets, links are joined to components by distributed stars.

Equal shingle sets are one node before banding, so exact copies cost one aggregation row each. Buckets of near copies are searched from their centres, and
what is left by a prefix filter (linking.py).

Defined cases: null, empty or blank texts have no shingles, link with nothing and are kept; a text with fewer words than a shingle is one shingle; rows
without id are never linked and have a null component; each repeated row gets its own result row; different texts of one id are linked each for itself; texts of any length
are taken whole; an empty table gives an empty result. Other input columns are left out by near_components and kept by stage.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, holds, small_side, table
from .linking import link_components, shared_keys

GROUPS, ROWS = 10, 3
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Word hashes that a Python worker remembers.
CACHE = 500_000
_draw = np.random.default_rng(20240229)
FACTORS = _draw.integers(1, 2**63, 2 * GROUPS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draw.integers(0, 2**63, 2 * GROUPS * ROWS, dtype=np.uint64)
STEP, TURN, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(29), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> TURN)) * MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z lower-cased."""
    words = WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    s = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        s = mixed(s * STEP + h[k : len(h) - width + 1 + k])
    return np.unique(mixed(s + np.uint64(width)))


def group_keys(s: np.ndarray) -> np.ndarray:
    """The 20 group hashes of a set, those of the first collection before those of the second."""
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, (FACTORS[:, None] * s[None, i : i + 2048] + TERMS[:, None]).min(axis=1), out=low)
    low = low.reshape(-1, ROWS)
    out = low[:, 0]
    for k in range(1, ROWS):
        out = mixed(out * STEP + low[:, k])
    return out.view(np.int64)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signed(df: DataFrame, width: int) -> DataFrame:
    """(id, th, n_shingles, digest, keys) of (id, th, text)."""

    def run(batches):
        for b in batches:
            n, d, keys = [], [], []
            for x in b.column("text"):
                s = shingles(x.as_py(), width)
                n.append(len(s))
                d.append(digest(s) if len(s) else None)
                keys.append(group_keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "th", "n_shingles", "digest", "keys"])

    return df.select("id", "th", "text").mapInArrow(run, "id long, th long, n_shingles long, digest binary, keys array<long>")


def _sets(df: DataFrame, width: int) -> DataFrame:
    """(node, s) of (node, text, digest), for the rows whose text has that digest."""

    def run(batches):
        for b in batches:
            nodes, out = [], []
            for i, x, d in zip(b.column("node").to_pylist(), b.column("text"), b.column("digest").to_pylist()):
                s = shingles(x.as_py(), width)
                if digest(s) == d:
                    nodes.append(i)
                    out.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["node", "s"])

    return df.select("node", "text", "digest").mapInArrow(run, "node long, s array<long>")


def grouped(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(id, th, n_shingles, component, grp) of (doc_id, text), a row a row: th is a hash of the text, grp the number of the row's group, component the smallest id in it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    signed = cut(_signed(docs, width), "near-signed")
    own = signed.filter("n_shingles > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    # numbers are drawn once, as the table is written; ids may repeat with other texts and so can't name the nodes
    nodes = cut(own.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    tables = F.expr(f"transform(sequence(0, {GROUPS * GROUPS - 1}), t -> xxhash64(t, keys[t div {GROUPS}], keys[{GROUPS} + t % {GROUPS}]))")
    buckets = shared_keys(nodes.select(F.explode(tables).alias("key"), F.col("node").alias("id")))
    wanted = cut(buckets.select(F.col("id").alias("node")).distinct().join(nodes.select("node", "id", "digest"), "node"), "near-wanted")
    sets = cut(_sets(docs.join(small_side(wanted), "id"), width).dropDuplicates(["node"]), "near-sets")

    def verify(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        full = full.filter(f"100 * least(size(sa), size(sb)) >= {percent} * greatest(size(sa), size(sb))")
        # 100 * both >= percent * (size(sa) + size(sb) - both), with the intersection named once
        return full.filter(f"{100 + percent} * size(array_intersect(sa, sb)) >= {percent} * (size(sa) + size(sb))").select("a", "b")

    def tokens(ids: DataFrame) -> DataFrame:
        held = sets.join(ids.withColumnRenamed("id", "node"), "node")
        return held.select(F.col("node").alias("id"), F.size("s").cast("long").alias("size"), F.explode("s").alias("token"))

    comp = link_components(buckets, verify, tokens, percent)
    named = nodes.select("digest", "node", "id").join(comp.withColumnRenamed("id", "node"), "node", "left").select("digest", "id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("id").alias("component"))
    by_digest = cut(named.join(least, "comp").select("digest", "component", F.col("comp").alias("grp")), "near-components")
    own_id = F.col("id").isNotNull()
    out = signed.drop("keys").join(by_digest, "digest", "left")
    done = cut(out.select("id", "th", "n_shingles", F.when(own_id, F.coalesce("component", "id")).alias("component"), F.when(own_id, F.col("grp")).alias("grp")), "near-grouped")
    drop(signed, nodes, wanted, sets, comp, by_digest)
    return done


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text), a row a row."""
    return grouped(docs, width, percent).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles at 0.8: that with the smallest id, and of texts that share this id in the group that with the smallest hash.

    Of rows that repeat id and text the least by the other columns stays. Documents without words or without id stay.
    """
    found = grouped(docs)
    rows = cut(found.filter("grp IS NOT NULL").groupBy("id", "th", "grp").agg(F.count("*").alias("times")), "near-rows")
    drop(found)
    stays = rows.groupBy("grp").agg(F.min(F.struct("id", "th")).alias("s")).select("grp", F.col("s.id").alias("sid"), F.col("s.th").alias("sth"))
    verdict = cut(rows.join(stays, "grp").select(F.col("id").alias("__id"), F.col("th").alias("__th"), "times", (~((F.col("id") == F.col("sid")) & (F.col("th") == F.col("sth")))).alias("gone")).filter("gone OR times > 1"), "near-verdict")
    drop(rows)
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__th": F.xxhash64("text")})
    left = keyed.join(small_side(verdict.select("__id", "__th")), ["__id", "__th"], "left_anti").select(*docs.columns)
    twice = verdict.filter("NOT gone")
    if not holds(twice):
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = keyed.join(twice.select("__id", "__th"), ["__id", "__th"], "left_semi").groupBy("__id", "__th").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return left.union(once.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_n >= 80 * (p.n + q.n - both_n)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id WHERE e.b > reach.r)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r) AS component_id, n.doc_id = min(r) AS kept FROM n JOIN reach ON reach.id = n.doc_id GROUP BY n.doc_id, n.n
"""

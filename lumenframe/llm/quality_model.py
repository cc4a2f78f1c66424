"""Supervised subword embeddings for quality: hashed word and character n-gram vectors, averaged per document, a softmax on top, trained by stochastic gradient descent in numpy.

Training takes a bounded sample, at most SAMPLE labelled documents, those of the smallest md5 of their id; rows with crc32(id as text) mod 4 = 2 are held out. Labels, language,
source and id are never features. As the softmax of an average of vectors is linear in them, scoring needs one number per hash bucket: the difference of the two
classes' scores for that bucket's vector. That table of BUCKETS doubles is all that executors get.

Defined cases: a null or empty text has no features and gets the score of the bias; a null id is not held out; labels that are null are not
learned from; repeated rows are scored each; without any training row the score is 0.5. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, without

SAMPLE = 3_000
BUCKETS, DIMENSION, GRAMS = 1 << 17, 8, (3, 4)
EPOCHS, RATE, SEED = 6, 0.5, 11
THRESHOLD = 0.7
#: Words whose features a Python worker remembers.
CACHE = 300_000
WORDS = re.compile(WORD)


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams with marks at both ends."""
    marked = f"<{word}>"
    out = [zlib.crc32(b"w" + marked.encode("utf-8", "surrogatepass"))]
    for n in GRAMS:
        out += [zlib.crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) for i in range(len(marked) - n + 1)]
    return [x & (BUCKETS - 1) for x in out]


#: A word that repeats the one before it adds this bigram's bucket, whatever the word.
REPEAT = [zlib.crc32(b"same as the last") & (BUCKETS - 1)] * 8


class Features(dict):
    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = features(word)
        return out


def document(text: str | None, cache: Features) -> np.ndarray:
    out: list[int] = []
    last = None
    for w in WORDS.findall(text or ""):
        out += cache[w]
        if w == last:
            out += REPEAT
        last = w
    return np.asarray(out, np.int64)


def train(rows: list[tuple[str | None, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias) for (text, label 0 or 1)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSION)) / DIMENSION
    weights, bias = np.zeros((2, DIMENSION)), np.zeros(2)
    cache = Features()
    docs = []
    for text, label in rows:
        found, times = np.unique(document(text, cache), return_counts=True)
        docs.append((found, times / max(1, times.sum()), label))
    steps = max(1, epochs * len(docs))
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            found, share, label = docs[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[found] if len(found) else np.zeros(DIMENSION)
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = weights.T @ p
            weights -= step * np.outer(p, mean)
            bias -= step * p
            if len(found):
                vectors[found] -= step * np.outer(share * min(len(found), 200), back)
    return vectors @ (weights[1] - weights[0]), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str | None, int]]:
    """At most `sample` (text, label); the ids are chosen by a distributed top-k, their texts joined by broadcast."""
    may = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).select("doc_id", "quality")
    ids = may.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "quality")
    got = sorted(rows.collect(), key=lambda r: (r[0], r[2], r[1] or ""))[:sample]
    return [(r[1], int(r[2] == 1)) for r in got]


TYPE = "struct<score:double,predicted:int>"


def score(df: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """df with score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = without(df, ["score", "predicted"])

    class Sums(dict):
        def __missing__(self, word: str) -> tuple[float, int]:
            if len(self) >= CACHE:
                self.clear()
            found = features(word)
            self[word] = out = (float(sum(map(self.table.__getitem__, found))), len(found))
            return out

    @F.arrow_udf(TYPE)
    def scored(texts: pa.Array) -> pa.Array:
        each, bias = shared.value
        sums = Sums()
        sums.table = each
        again, more = float(each[REPEAT].sum()), len(REPEAT)
        out = []
        for x in texts.to_pylist():
            total, n, last = 0.0, 0, None
            for w in WORDS.findall(x or ""):
                s, k = sums[w]
                total += s
                n += k
                if w == last:
                    total += again
                    n += more
                last = w
            z = bias + (total / n if n else 0.0)
            out.append(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))
        values = np.asarray(out, float)
        return pa.StructArray.from_arrays([pa.array(values, pa.float64()), pa.array((values >= THRESHOLD).astype(np.int32))], ["score", "predicted"])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("__row"), scored(F.col("text")).alias("__s"))
    return rows.select("__row.*", "__s.score", "__s.predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(training_rows(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


SQL = None

"""Vector best-fit packing of tokenized documents.

A piece is a vector of three demands: tokens, one document, and attention cost (the square of its length); a sequence has a capacity for each. Pieces are taken in
falling size; each goes to the open sequence that fits under every constraint and is best by the weighted dot product of demand and residual, or by the
least weighted norm of what would be left over.

All three demands follow from the length, so the rule is run on the histogram of lengths, at most `capacity` entries, whatever the size of the corpus: equal
pieces go together to equal sequences, and the result is a plan of runs (length, first and last rank of its pieces, first sequence, offset). Pieces get ranks within their length
by distributed counting and look their run up in the plan. So the packing is that of one best-fit over the whole corpus, and no task holds more than a hash bucket of one length.

Defined cases: a null or empty text is the single end token; only documents longer than the capacity are cut, the first piece may be shorter; null ids
sort first, repeated rows are packed each; an empty table gives no pieces. Extra input columns are ignored by the query and kept by `pack`, where clashing names are replaced.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, without

TOKENIZER = "byte_bpe_50k"
CAPACITY = 2048
END = 0
#: Weights of tokens, documents and attention cost in the choice of a sequence.
WEIGHTS = (1.0, 0.05, 0.25)
#: No document limit binds before the token limit does unless a smaller one is given; attention cost is at most capacity squared.
MAX_DOCS = CAPACITY
#: Word pieces that a Python worker remembers.
CACHE = 400_000
#: Pieces that a rank bucket holds on average at most.
BUCKET_PIECES = 50_000


class _Chunks(dict):
    """Ids of text chunks as little-endian unsigned 32-bit bytes. A chunk starts where the tokenizer's own splitting surely starts a token."""

    def __init__(self, name: str, lead: str):
        self.lead, self.encoding = lead, _encoding(name)
        self.marks = {c: self._encode(c) for c in ",.\n"}

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if len(chunk) > 1 and chunk[-1] in ",." and chunk[-2].isalpha():
            ids = self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            ids = self._encode(self.lead + chunk)
        self[chunk] = ids
        return ids


class Encoder:
    """Text to ids, as the tokenizer file defines them, with a memory of chunks.

    A single space between two characters that aren't white space always starts a token of the byte-level splitting rule, and so does each line end alone between such
    characters; texts where white space stands otherwise, or which hold the text of a special token, are encoded whole.
    """

    def __init__(self, name: str = TOKENIZER):
        self.encoding = _encoding(name)
        self.plain, self.spaced = _Chunks(name, ""), _Chunks(name, " ")
        self.newline = self.plain.marks["\n"]
        self.special = "<|endoftext|>"

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special in text:
            return np.asarray(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()
        lines = text.split("\n")
        out = []
        for line in lines:
            if not line or line != line.strip() or not line.isprintable() or "  " in line:
                return np.asarray(self.encoding.encode_ordinary(text), "<u4").tobytes()
            first, *rest = line.split(" ")
            out.append(self.plain[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return self.newline.join(out)


_made: dict = {}


def _encoding(name: str):
    """The vocabulary as a fast encoder. Its ids equal those of the .json file's tokenizer; tests hold the two against each other."""
    if ("encoding", name) not in _made:
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made["encoding", name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _made["encoding", name]


def encoder(name: str = TOKENIZER) -> Encoder:
    if name not in _made:
        _made[name] = Encoder(name)
    return _made[name]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of (doc_id, text), and the ids as little-endian bytes if asked for."""
    end = np.asarray([END], "<u4").tobytes()

    def run(batches):
        enc = encoder(name)
        for b in batches:
            rows = []
            for i, x in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = enc.ids(x.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (p, q) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[4 * p : 4 * q]
                    rows.append((i, k, p, q - p, zlib.crc32(own), own) if with_ids else (i, k, p, q - p, zlib.crc32(own)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None, weights=WEIGHTS, rule: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, last rank, first sequence, offset, pieces a sequence) for counts of lengths.

    Open sequences with the same contents are one group (tokens used, documents, cost used, first number, how many). Choosing is by group; a group is split where a length runs out.
    """
    max_cost = max_cost or capacity * capacity
    w = np.asarray(weights)
    caps = np.asarray([capacity, max_docs, max_cost], float)
    used: list[list[int]] = []  # of each open group: tokens, documents, cost
    place: list[tuple[int, int]] = []  # first sequence and number of sequences
    runs: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    state = np.empty((0, 3))
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.asarray([length, 1, length * length], float)
        if length > capacity or length * length > max_cost:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            best = -1
            if len(used):
                rest = caps - state
                fits = np.flatnonzero((rest >= need).all(axis=1))
                if len(fits):
                    r, d = rest[fits] / caps, need / caps
                    score = -(r * d * w).sum(axis=1) if rule == "dot" else ((r - d) ** 2 * w).sum(axis=1)
                    best = int(fits[np.argmin(score)])
            if best < 0:
                each = int(min(capacity // length, max_docs, max_cost // (length * length)))
                many, odd = divmod(left, each)
                for number, own in ((many, each), (1, odd)):
                    if number and own:
                        runs.append((length, rank, rank + number * own - 1, opened, 0, own))
                        rank += number * own
                        used.append([own * length, own, own * length * length])
                        place.append((opened, number))
                        opened += number
                left = 0
            else:
                first, number = place[best]
                t, docs, cost = used[best]
                each = int(min((capacity - t) // length, max_docs - docs, (max_cost - cost) // (length * length)))
                many = min(number, left // each)
                if not many:
                    many, each = 1, left
                if many < number:
                    place.append((first + many, number - many))
                    used.append([t, docs, cost])
                place[best] = (first, many)
                runs.append((length, rank, rank + many * each - 1, first, t, each))
                rank += many * each
                left -= many * each
                used[best] = [t + each * length, docs + each, cost + each * length * length]
            keep = [i for i, (t, docs, cost) in enumerate(used) if t < capacity and docs < max_docs and cost < max_cost]
            if len(keep) < len(used):
                used, place = [used[i] for i in keep], [place[i] for i in keep]
            state = np.asarray(used, float).reshape(-1, 3)
    return runs


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None, weights=WEIGHTS, rule: str = "norm") -> DataFrame:
    """cut_pieces (doc_id, piece, start, length, ids_crc32 and more) with sequence_id and offset. The input is read several times: cut its lineage first."""
    spark = cut_pieces.sparkSession
    own = without(cut_pieces, ["sequence_id", "offset"])
    keyed = own.withColumn("__h", F.xxhash64("doc_id", "piece", "ids_crc32", "start"))
    total = keyed.count()
    buckets = max(1, total // BUCKET_PIECES)
    keyed = keyed.withColumn("__b", F.pmod(F.col("__h"), F.lit(buckets)))
    counts = cut(keyed.groupBy("length", "__b").count(), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    runs = defaultdict(list)
    for r in plan(histogram, capacity, max_docs, max_cost, weights, rule):
        runs[r[0]].append(r[1:])
    offsets = counts.withColumn("__before", F.sum("count").over(Window.partitionBy("length").orderBy("__b")) - F.col("count")).select(F.col("length").alias("__ol"), F.col("__b").alias("__ob"), "__before")
    ranked = keyed.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__b").orderBy("__h", "doc_id", "piece")) - 1)
    ranked = ranked.join(offsets, (F.col("length") == F.col("__ol")) & (F.col("__b") == F.col("__ob"))).withColumn("__rank", F.col("__before") + F.col("__r"))
    shared = spark.sparkContext.broadcast({k: (np.asarray([x[0] for x in v]), np.asarray(v)) for k, v in runs.items()})

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for k in np.unique(n):
            at = np.flatnonzero(n == k)
            firsts, table_ = shared.value[int(k)]
            run = table_[np.searchsorted(firsts, r[at], side="right") - 1]
            into = r[at] - run[:, 0]
            seq[at] = run[:, 2] + into // run[:, 4]
            off[at] = run[:, 3] + into % run[:, 4] * k
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], ["sequence_id", "offset"])

    out = ranked.withColumn("__p", placed("length", F.col("__rank").cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in own.columns], "__p.sequence_id", "__p.offset")


def packed(docs: DataFrame) -> DataFrame:
    return pack(cut(pieces(docs), "pieces"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = None

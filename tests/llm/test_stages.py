"""The stages of the pipeline, and the linking of buckets against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import common, line_dedup, linking, mixing, near_dedup, quality_rules

WORDS = [f"word{i}" for i in range(400)]


def text(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n)) + "."


def test_quality_stage(spark):
    rows = [(1, text(1) + "\nhome | shop | cart | help", "a", 0), (2, None, "b", 1), (None, text(2), None, None), (3, "", "a", 2), (1, text(1), "a", 3), (4, text(3, 40000), "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = quality_rules.stage(spark, docs, "").collect()
    want = [(i, v[8], s, len(v[8])) for i, t, s, _ in rows for v in [quality_rules.judge(t)] if v[7]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and got[0].text == text(1)
    assert quality_rules.stage(spark, docs.limit(0), "").count() == 0


def test_mixing_places_every_pass(spark):
    rows = [(i, text(i, 5 + i % 40), f"s{i % 4}" if i % 5 else None, 0) for i in range(120)] + [(None, None, "s0", 0), (3, text(3, 8), "s3", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mix(docs, max_repeat=3, budget=2.5)
    taken, passes, most = mixed.agg(F.sum("taken"), F.sum("passes"), F.max("passes")).first()
    placed = mixing.passes_of(mixed)
    assert most == 3 and placed.count() == passes and placed.agg(F.sum(common.word_count(F.col("text")))).first()[0] == taken


def test_near_stage_keeps_different_texts_of_one_id(spark):
    a, b, c = text(1), text(2), text(3)
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (5, a, "x"), (6, c, "y"), (2, c, "x"), (None, a, "x"), (7, None, "x"), (8, "", "x")]
    got = near_dedup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a, "x"), (1, b, "x"), (2, c, "x"), (None, a, "x"), (7, None, "x"), (8, "", "x")]))


@pytest.mark.parametrize("pairs_a_member", [0, 1000])
def test_linking_equals_brute_force(spark, pairs_a_member):
    """One bucket of copies changed little and much, so that some link only to others than the centre: by pairs and by the prefix filter."""
    rng, sets = np.random.default_rng(4), {}
    for i in range(90):
        s = list(range(100)) if i < 70 else list(sets[int(rng.integers(40, 70))])
        for at in rng.choice(100, int(rng.integers(0, 16 if i >= 70 else 30)), replace=False):
            s[at] = int(rng.integers(1000, 1400))
        sets[i] = sorted(set(s))
    df = common.cut(spark.createDataFrame(list(sets.items()), "id long, s array<long>"), "test-sets")
    buckets = common.cut(df.select(F.lit(1).cast("long").alias("key"), "id", F.lit(len(sets)).cast("long").alias("n")), "test-buckets")

    def verify(pairs):
        both = pairs.join(df.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(df.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
        return both.filter("180 * size(array_intersect(x, y)) >= 80 * (size(x) + size(y))").select("a", "b")

    def tokens(ids):
        return df.join(ids, "id").select("id", F.size("s").cast("long").alias("size"), F.explode("s").alias("token"))

    got = {r.id: r.comp for r in linking.link_components(buckets, verify, tokens, 80, pairs_a_member=pairs_a_member).collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            x, y = set(sets[i]), set(sets[j])
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert {i: got.get(i, i) for i in sets} == {i: find(i) for i in sets} and len(set(map(find, sets))) > 1


@pytest.mark.parametrize("pairs_a_member", [0, 1000])
def test_linking_by_sketches_equals_brute_force(spark, pairs_a_member):
    """Large, small and overlapping buckets: every pair that shares one and is alike by its sketch is decided, no other, and no text is asked for twice a row."""
    rng, sets = np.random.default_rng(7), {}
    for i in range(120):
        s = list(range(100)) if i < 70 else list(sets[int(rng.integers(40, 70))])
        for at in rng.choice(len(s), int(rng.integers(0, 16 if i >= 70 else 30)), replace=False):
            s[at] = int(rng.integers(1000, 1400))
        sets[i] = sorted(set(s))
    sketch = {i: int(i % 40 > 1) for i in sets}
    members = {1: range(60), 2: range(50, 110), 3: [3, 111], 4: [112, 113, 114, 5], 5: [115, 116, 117, 118, 119], 6: [0, 40, 80, 1, 41, 81]}
    rows = [(k, i, sketch[i], len(m)) for k, m in members.items() for i in m]
    df = common.cut(spark.createDataFrame(list(sets.items()), "id long, s array<long>"), "test-sets")
    buckets = common.cut(spark.createDataFrame(rows, "key long, id long, sketch long, n long"), "test-buckets")

    def verify(pairs):
        assert pairs.count() == pairs.distinct().count()
        both = pairs.join(df.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(df.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
        return both.filter("180 * size(array_intersect(x, y)) >= 80 * (size(x) + size(y))").select("a", "b")

    def tokens(ids):
        return df.join(ids, "id").select("id", F.size("s").cast("long").alias("size"), F.explode("s").alias("token"))

    alike = lambda a, b: F.col(a) == F.col(b)
    got = {r.id: r.comp for r in linking.link_sketched(buckets, verify, tokens, 80, alike, pairs_a_member).collect()}
    comp = {i: i for i in sets}
    for m in members.values():
        for i in m:
            for j in m:
                x, y = set(sets[i]), set(sets[j])
                if sketch[i] == sketch[j] and 100 * len(x & y) >= 80 * len(x | y) and comp[i] != comp[j]:
                    low, high = sorted((comp[i], comp[j]))
                    comp = {k: low if v == high else v for k, v in comp.items()}
    # with pairs_a_member 0 the rest is searched over all buckets, so more may be found, never less
    assert {i: got.get(i, i) for i in sets} == comp if pairs_a_member else all(got.get(i, i) == got.get(comp[i], comp[i]) for i in sets)


def test_pipeline_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack"]


def altered(rng, base, k):
    out = list(base)
    for at in rng.choice(len(out), k, replace=False):
        out[at] = chr(int(rng.integers(0x4E00, 0x9000)))
    return "".join(out)


def test_bitmaps_lose_no_similar_lines(spark):
    """Bitmaps never rule out lines at 0.8 or more, of any length, and nearly all at 0.65 or less."""
    rng, rows = np.random.default_rng(7), []
    for i in range(400):
        n = int(rng.integers(3, 400))
        a = "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, n))
        rows.append((i, a, altered(rng, a, min(n, int(rng.integers(0, 1 + n // 10))))))
    pairs = spark.createDataFrame(rows, "id long, a string, b string")
    sketch = lambda c: line_dedup.bitmaps(line_dedup.window_tokens(pairs.select("id", F.col(c).alias("line")))).withColumnRenamed("sketch", f"s{c}")
    got = pairs.join(sketch("a"), "id").join(sketch("b"), "id").select(line_dedup.similar("a", "b", 80).alias("s"), line_dedup.similar("a", "b", 65).alias("t"), line_dedup.may_be_similar("sa", "sb", 80).alias("m")).collect()
    assert len(got) == 400 and sum(r.s for r in got) > 100 and all(r.m for r in got if r.s)
    far = [r.m for r in got if not r.t]
    assert len(far) > 50 and sum(far) < 0.05 * len(far)


def test_group_of_lines_below_the_limit_is_compared_little(spark, monkeypatch):
    """Lines of one pattern at 0.65 to 0.72, all of which share buckets: few pairs are left to be compared by their texts, and no line goes."""
    rng, asked = np.random.default_rng(8), []
    base = "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, 300))
    rows = [(i, altered(rng, base, 5 + i % 2)) for i in range(120)]
    cut = line_dedup.cut

    def counted(df, name):
        out = cut(df, name)
        if name == "to-verify":
            asked.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    w = [{t[i : i + 5] for i in range(len(t) - 4)} for _, t in rows]
    near = sum(len(w[i] & w[j]) >= 0.8 * len(w[i] | w[j]) for i in range(120) for j in range(i))
    assert len(got) == 120 and sum(r.n_removed for r in got) <= near
    assert sum(asked) < 10 * 120


def test_generated_methods_of_line_nodes_and_buckets_are_compiled(spark, monkeypatch, capsys):
    """The JVM leaves methods of more than 8,000 bytes uncompiled; minhashes and table keys of every line run in smaller ones."""
    sizes, cut = {}, line_dedup.cut

    def measured(df, name):
        capsys.readouterr()
        df.explain("codegen")
        sizes[name] = max((int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)), default=0)
        return cut(df, name)

    monkeypatch.setattr(line_dedup, "cut", measured)
    monkeypatch.setattr(linking, "cut", measured)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        line_dedup.line_hits(spark.createDataFrame([(1, "one line of words\nand another line"), (2, "one line of words")], "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert all(0 < sizes[n] <= 8000 for n in ("line-nodes", "shared-keys", "buckets"))


@pytest.mark.parametrize("count", [None, 1, 10**6])
def test_shared_keys(spark, count):
    rows = [(k % 40 if i % 3 else 1000 + 7 * i + k, i) for i in range(60) for k in range(5 * i, 5 * i + 4)]
    n = Counter(k for k, _ in rows)
    got = linking.shared_keys(spark.createDataFrame(rows, "key long, id long"), count).collect()
    assert sorted((r.key, r.id, r.n) for r in got) == sorted((k, i, n[k]) for k, i in rows if n[k] > 1)


def test_lists_carry_sketches_where_these_are_too_many_to_broadcast(spark, monkeypatch):
    names, cut = {}, linking.cut
    monkeypatch.setattr(linking, "cut", lambda df, name: names.update({name: df.columns}) or cut(df, name))
    for most in (0, 1000):
        monkeypatch.setattr(linking, "LATE_SKETCHES", most)
        test_linking_by_sketches_equals_brute_force(spark, 0)
        assert ("sketch" in names["lists"]) == (most == 0)

"""The training-data operators against brute force and on the cases that their docstrings define."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import license_digest, line_dedup, mixing, near_dedup, packing, pii, quality_model, quality_rules, vp_search, warc

SF = "/root/testdata/sf0.001"
ODD = [(None, None, "x", None), (1, "", None, 0), (2, None, "x", 0), (3, "one", "y", 3), (3, "one", "y", 3), (4, "w " * 30000, "y", 1), (5, "\n\n a\tb \n", "z", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeated rows, a long text, and columns whose names clash with outputs."""
    d = spark.createDataFrame(ODD, "doc_id long, text string, source string, kept int")
    return d.withColumn("size", F.lit("mine")).withColumn("score", F.lit("mine")).withColumn("n_words", F.lit("mine")).withColumn("spans", F.lit("mine"))


def test_quality_rules(spark, odd):
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == 0 and by[1].base_failed and by[4].n_repeat_words == 30000
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0
    assert quality_rules.repeated_words("a b c d e f a b c d e".split()) == 10


def test_quality_lines():
    junk = "home | shop | cart | about | help | more"
    prose = "The cat sat on the mat and looked at the moon for a long time."
    more = "Nobody else was awake in the quiet house at that late hour of the night."
    assert quality_rules.judge(f"{prose}\n{more}\n{junk}")[7]
    assert not quality_rules.judge("\n".join([prose] + [junk + str(i) for i in range(5)]))[7]
    assert quality_rules.judge(f"{prose}\n{junk}")[8] == prose


def test_mixing(spark, odd, docs):
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0
    rows = mixing.mix(docs).select("source", "size", "source_size", "target", "taken").collect()
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source, r.target] += r.taken
    assert all(abs(v - t) <= 1 for (_, t), v in taken.items())
    assert abs(sum(t for _, t in taken) - 1.5 * sum(r.size for r in rows)) < 1
    staged = mixing.stage(spark, docs, SF)
    assert staged.columns == docs.columns


def brute_components(sets):
    ids, root = sorted(sets), {}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_dedup(spark, docs, odd):
    got = {r.doc_id: r for r in near_dedup.near_components(docs, width=5).collect()}
    sets = {}
    for r in docs.collect():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    assert {i: r.component_id for i, r in got.items()} == brute_components(sets)
    assert near_dedup.near_components(odd).count() == len(ODD)
    assert near_dedup.near_components(odd.limit(0)).count() == 0


def test_near_dedup_chain_in_one_hot_group(spark):
    """A chain in which neighbours are near and the ends are not is one component, though all share buckets."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([f"x{j}" for j in range(8 * i)] + words[8 * i :])) for i in range(8)]
    comp = {r.component_id for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()}
    assert comp == {0}


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/x", "same"), (1, "http://a/y\n", "same"), (2, None, None), (None, "u", "same"), (7, "u", "WARC/1.1\r\n\r\n é"), (9, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(warc.resolve(pages), f"file://{tmp_path}/w")
    back = warc.read(spark, f"file://{tmp_path}/w", payload=True)
    got = {r.page_id: r for r in back.collect()}
    assert got[1].record_type == "response" and bytes(got[1].payload) == b"same" and got[3].refers_to == 1 and got[None].refers_to == 1
    assert bytes(got[7].payload) == rows[4][2].encode() and got[9].refers_to == 2
    for r in warc.resolved_records(back).collect():
        body = (dict((x[0], x[2]) for x in rows)[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    warc.write(warc.resolve(pages.limit(0)), f"file://{tmp_path}/e")


def test_pii(spark):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(k, m):
        d = re.sub("[^0-9]", "", m)
        if k == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if k == "card":
            return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
        return k != "phone" or 10 <= len(d) <= 15

    texts = ["a@b.com_x@y.com.z 1.2.3.4.5.6.7.8", None, "", "1 " * 20000 + "é@ü.a b@c.d-.e " + "x" * 20000 + "@", "+" * 50 + "1234567890123 😀 q@w.e 4111-1111-1111-1111 999.1.1.1", "1.2.3.4@5.6 10.0.0.1.2 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.sanitise(df).collect():
        t = texts[r.doc_id] or ""
        base = sorted((m.start(), k, m.end(), name) for k, name in enumerate(kinds) for m in re.finditer(kinds[name], t) if holds(name, m.group()))
        said = ",".join(f"{n}:{s}:{e}" for s, _, e, n in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == n for x in base) for n in kinds]


def test_pii_terms(spark):
    """A rare word that stands by one address in different contexts is removed there; common words stay."""
    filler = [(i, f"the weather of day {i} was fine for the people") for i in range(120)]
    own = [(1000 + i, f"note {i} zanzibarro writes from ann@site.example.org on the day {i}") for i in range(3)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(filler + own, "doc_id long, text string")).collect()}
    assert "zanzibarro" not in got[1000].clean_text and "[EMAIL]" in got[1000].clean_text and " the " in got[1000].clean_text
    assert all(got[i].spans == "" for i in range(120))


def test_pii_terms_in_copies_far_away_and_without_the_address(spark):
    """Copies count once, terms are weighed over the whole document, and a term that discloses an address goes from documents without it too."""
    filler = [(i, f"the weather of day {i} was fine for the people") for i in range(120)]
    far = "the weather was fine for the people " * 4
    a, b, c = f"zanzibarro said {far} ann@site.example.org", f"ann@site.example.org {far} asked zanzibarro", f"zanzibarro {far}"
    rows = filler + [(1000 + i, a) for i in range(40)] + [(2000, b), (2001, c)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any("zanzibarro" in r.clean_text for r in got.values()) and got[2001].spans == "remove:0:10"
    assert all(got[i].spans == "" for i in range(120))


def test_pii_terms_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        w = [f"w{int(x)}" for x in rng.zipf(1.3, 12) % 400]
        rows.append((i, " ".join(w + [f"10.0.0.{w[0][1:]}"] * (i % 4 == 0 and int(w[0][1:]) < 200) + w[:2])))
    rows += [(1000 + i, rows[4 * i][1]) for i in range(40)]
    texts = {t: (set(re.findall(r"[a-z0-9]+", t)), set(re.findall(r"10\.0\.0\.[0-9]+", t))) for _, t in rows}
    df, dfe, co, action = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for terms, es in texts.values():
        for t in terms:
            df[t] += 1
        for e in es:
            dfe[e] += 1
            for t in terms:
                co[e, t] += 1
    for (e, t), k in co.items():
        if k >= 2 and k / df[t] >= 0.2 and np.log2(k / df[t] / (dfe[e] / len(texts))) >= 4:
            action[t] = "remove" if k / df[t] >= 0.5 else action.get(t, "generalise")
    assert {"remove", "generalise"} == set(action.values())
    for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        ips = [m.span() for m in re.finditer(r"10\.0\.0\.[0-9]+", r.text)]
        words = [(m.start(), f"{action[m.group()]}:{m.start()}:{m.end()}") for m in re.finditer(r"[a-z0-9]+", r.text) if m.group() in action and not any(x < m.end() and m.start() < y for x, y in ips)]
        assert r.spans == ",".join(x for _, x in sorted(words + [(x, f"ip:{x}:{y}") for x, y in ips]))


def test_packing(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in docs.limit(60).collect()] + ["", " a  b", "x\n\ny \n z", "<|endoftext|> it's", "don't stop. ok,\tno", "１２ é😀 a.b,c. d", "a b   c"]
    enc = packing.encoder()
    for t in texts:
        assert list(np.frombuffer(enc.ids(t), "<u4")) == tok.encode(t, add_special_tokens=False).ids
    rows = packing.packed(docs).collect()
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for v in seq.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= 2048
    assert len(seq) <= -(-sum(r.length for r in rows) // 2048) * 1.05 + 1
    by = {(r.doc_id, r.piece): r for r in rows}
    first = docs.first()
    ids = list(tok.encode(first.text, add_special_tokens=False).ids) + [0]
    assert by[first.doc_id, 0].ids_crc32 == zlib.crc32(np.asarray(ids[: by[first.doc_id, 0].length], "<u4").tobytes())
    assert packing.packed(odd).filter("doc_id = 3").count() == 2 and packing.packed(odd.limit(0)).count() == 0


def test_packing_constraints():
    h = {700: 5, 300: 9, 10: 40}
    for rule in ("norm", "dot"):
        runs = packing.plan(h, 1000, max_docs=4, max_cost=700_000, rule=rule)
        bins = defaultdict(lambda: [0, 0, 0])
        for n, first, last, s, off, each in runs:
            for i in range(last - first + 1):
                b = bins[s + i // each]
                assert off + i % each * n == b[0]
                b[0] += n
                b[1] += 1
                b[2] += n * n
        assert sum(b[1] for b in bins.values()) == 54 and all(b[0] <= 1000 and b[1] <= 4 and b[2] <= 700_000 for b in bins.values())


def test_license(spark, odd):
    mit = license_digest.LICENSES["mit"]
    rows = [(1, "Copyright (c) 2020 Ann\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", " ,")), (2, mit + " extra"), (3, None), (4, "")]
    got = {r.doc_id: r for r in license_digest.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license_id == "mit" and got[2].license_id is None and got[3].canonical_digest is None and got[4].canonical_digest is None
    assert license_digest.license_scan(odd).count() == len(ODD)


def test_license_titles_and_long_texts(spark):
    rows = [(1, "MIT License\n\nCopyright (c) 2024 Ann\n\n" + license_digest.LICENSES["mit"]), (2, "ISC License\n\nCopyright 2024 Ann\n\n" + license_digest.LICENSES["isc"])]
    want = {1: "mit", 2: "isc"}
    for i, (name, licence) in enumerate({"Apache-2.0": "apache-2.0", "GPL-3": "gpl-3.0", "MPL-2.0": "mpl-2.0"}.items(), 3):
        path = Path("/usr/share/common-licenses", name)
        if path.exists():
            rows.append((i, path.read_text()))
            want[i] = licence
    got = license_digest.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.license_id for r in got} == want


def test_quality_model(spark, docs, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = quality_model.train(quality_model.training_rows(many, labels))
    s = quality_model.score(many, model).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert len(s) > 50 and sum(r.predicted == r.quality for r in s) / len(s) > 0.9
    got = quality_model.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.train([])[1] == 0


def test_line_dedup(spark, odd):
    base = "The quick brown fox jumps over the lazy dog near the old river bank at the break of day"
    near = base.replace("lazy", "hazy")
    rows = [(1, f"{base}\nfirst only line of this text"), (2, f"{near}\nsecond line stands alone here"), (3, base), (4, None), (5, "")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].clean_text == "second line stands alone here" and got[3].n_removed == 1 and got[4].clean_text is None and got[5].clean_text == ""
    assert line_dedup.line_dedup(odd).count() == len(ODD) and line_dedup.line_dedup(odd.limit(0)).count() == 0


def test_line_dedup_unspaced_lines(spark):
    """Lines without spaces that differ in the first character meet; lines that only begin alike don't share all buckets."""
    text = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(48))
    rows = [(1, text), (2, "龍" + text[1:]), (3, text[:7] + "".join(chr(0x6E00 + 41 * i % 3000) for i in range(41)))]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 1, 0]


def test_line_dedup_recall(spark):
    """Against true Jaccard: single pairs at 0.8 to 0.85, of short and unspaced lines, nearly all meet."""
    rng, rows, near = np.random.default_rng(3), [], 0
    for i in range(400):
        n = int(rng.integers(12, 60))
        a = "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, n))
        cut = int(np.ceil((n - 4) * 0.8)) + 4
        rows += [(2 * i, a), (2 * i + 1, a[:cut] if i % 2 else a[n - cut :])]
        near += 1
    nodes = line_dedup.line_components(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert nodes >= 0.98 * 2 * near


def test_vp_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).round(2)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in vp_search.nearest(v, v.filter("vec_id % 20 = 0"), shard_rows=200).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    f = x.astype(np.float32).astype(float)
    for q in range(0, 600, 20):
        s = np.zeros(600)
        for j in range(16):
            s += f[q, j] * f[:, j]
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert [(a, b) for a, b, _ in sorted(got[q])] == list(enumerate(best, 1))
    assert set(got) == set(range(0, 600, 20))
    relaxed = vp_search.Tree(f, np.arange(600), float(np.linalg.norm(f, axis=1).max()), leaf=32)
    relaxed.search(f[::20], np.arange(0, 600, 20), factor=50.0)
    assert relaxed.visited < 30 * 600
    assert vp_search.nearest(v.limit(0), v.limit(0)).count() == 0

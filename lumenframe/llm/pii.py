"""Personal data: exact kinds by pattern, and information-theoretic sanitisation of the words that give them away. DataFrame functions only.

Base kinds are e-mail addresses, IP addresses, card numbers and phone numbers. Each value found is a protected entity, and each word of a text is a term. All counts are
of different texts, so that copies of a document count once: co(t, e) counts the texts that hold term t and entity e, wherever they stand in it, df(t) those that hold t,
df(e) those that hold e, of n texts. The share co/df is P(e | t), and log2(P(e | t) / P(e)) is what t discloses about e in bits. Terms that share at least 2
different texts with an entity, disclosing at least 4 bits, are removed where P(e | t) is at least 0.5 and generalised to their shape where it is at least 0.2; from one text
alone nothing is estimated, for P(e | t) would be 1 for each word of its own. A term that discloses any entity is masked in every document that holds it, with or without the
entity, by the stronger of its actions.

Scale: documents are read once for spans, once for the frequencies of candidate terms and once for flagged terms; only the documents with spans, terms and counts are
shuffled, all counts by partial aggregation; a term or an entity in a third of all documents is one row of a count. Entities in more than a sixteenth of the texts
can't reach 4 bits, and terms in more than 5 times the texts of an entity can't reach a share of 0.2, so they are dropped before pairs are made.

Defined cases: a null text is empty; matches that fail their kind's rule are dropped without another try; overlapping spans of different kinds all stay;
rows with equal id and text get the same spans; an empty table gives no rows. Patterns use possessive loops, so very long texts neither overflow the stack nor go back.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_side, table, without

KINDS = ("email", "ip", "card", "phone")
#: Equal to the plain patterns in what they find; possessive, and tried only where a run starts or the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"[\p{L}\p{N}]++(?:['-][\p{L}\p{N}]++)*+"
MIN_TEXTS, MIN_BITS, REMOVE_SHARE, GENERALISE_SHARE = 2, 4.0, 0.5, 0.2
OWN = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean_text"]


def located(text: str, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<s,e,m>> of all matches of a pattern, or of those to keep: split gives the gaps, and gaps and matches add up to code-point offsets."""
    m, g = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda gap, hit: F.struct(F.length(gap).alias("g"), hit.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)").alias("out"))

    def add(acc, x):
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        more = F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))))
        return F.struct(e.alias("at"), (more if keep is None else F.when(keep(x["m"]), more).otherwise(acc["out"])).alias("out"))

    return F.aggregate(steps, start, add)["out"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _valid(kind: str):
    return lambda x: _holds(kind, x["m"])


def _tagged(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"))


def _of_kind(k: int):
    return lambda x: x["k"] == k


#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": None, "card": None, "phone": "+"}


def base_spans(text: str) -> Column:
    """array<struct<s,k,e,m>> of all base kinds in the order of start and kind; k is the kind's place in KINDS."""
    parts = []
    for k, kind in enumerate(KINDS):
        hint = F.contains(F.col(text), F.lit(HINTS[kind])) if HINTS[kind] else F.col(text).rlike(r"[0-9]\.[0-9]++\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){13}")
        spans = F.transform(F.filter(located(text, PATTERNS[kind]), _valid(kind)), _tagged(k))
        parts.append(F.when(hint, spans).otherwise(F.expr("cast(array() as array<struct<s:int,k:int,e:int,m:string>>)")))
    return F.array_sort(F.concat(*parts))


def terms_of(text: str) -> Column:
    """The different words of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def different(docs: DataFrame) -> tuple[DataFrame, int]:
    """One row (th, text) for each different text of docs (th, text), and their number. Only texts that occur twice are shuffled, a row a task."""
    counts = cut(docs.groupBy("th").agg(F.count("*").alias("times")), "pii-texts")
    again = small_side(counts.filter("times > 1").select("th"))
    once = docs.join(again, "th", "left_anti").select("th", "text")
    return once.union(docs.join(again, "th", "left_semi").select("th", "text").dropDuplicates(["th"])), counts.count()


def disclosing(base: DataFrame, docs: DataFrame) -> DataFrame:
    """(t, action) for the terms beyond a threshold. base: (th, es, terms) for each text with entities, docs: (th, text)."""
    texts, n = different(docs)
    held = base.select("th", F.explode("es").alias("e"))
    least = f"dfe >= {MIN_TEXTS} AND dfe * {2**MIN_BITS} <= {n}"
    entities = cut(held.groupBy("e").agg(F.count("*").alias("dfe")).filter(least), "pii-entities")
    held = cut(held.join(small_side(entities), "e"), "pii-held")
    most = held.agg(F.max("dfe")).first()[0] or 0
    words = base.join(held.select("th").distinct(), "th", "left_semi").select("th", F.explode("terms").alias("t"))
    near = cut(words.groupBy("t").agg(F.count("*").alias("c")).filter(f"c >= {MIN_TEXTS}").select("t"), "pii-terms")
    seen = texts.select(F.explode(terms_of("text")).alias("t")).join(small_side(near), "t", "left_semi")
    df = cut(seen.groupBy("t").agg(F.count("*").alias("df")).filter(f"df * {GENERALISE_SHARE} <= {most}"), "pii-df")
    pairs = held.join(words.join(small_side(df), "t"), "th").filter(f"df * {GENERALISE_SHARE} <= dfe")
    co = pairs.groupBy("e", "t").agg(F.count("*").alias("co"), F.first("df").alias("df"), F.first("dfe").alias("dfe")).filter(f"co >= {MIN_TEXTS}")
    share = F.col("co") / F.col("df")
    found = co.filter(F.log2(share / (F.col("dfe") / F.lit(float(max(n, 1))))) >= MIN_BITS).groupBy("t").agg(F.max(share).alias("share"))
    return found.select("t", F.when(F.col("share") >= REMOVE_SHARE, "remove").when(F.col("share") >= GENERALISE_SHARE, "generalise").alias("action")).filter("action IS NOT NULL")


def sanitise(df: DataFrame, with_text: bool = True) -> DataFrame:
    """df (doc_id, text and more) with the counts, base_sha256, spans and clean_text: base spans as [KIND], removed terms as nothing, generalised terms as their shape."""
    own = without(df, OWN)
    docs = df.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumn("th", F.xxhash64("text"))
    found = keyed.withColumn("spans", base_spans("text")).filter("size(spans) > 0")
    es = F.array_distinct(F.transform("spans", lambda x: F.xxhash64(x["k"], F.lower(x["m"]))))
    base = cut(found.select("doc_id", "th", F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("spans"), es.alias("es"), terms_of("text").alias("terms")), "pii-base")
    flagged = cut(disclosing(cut(base.select("th", "es", "terms").dropDuplicates(["th"]), "pii-distinct"), keyed.select("th", "text")), "pii-flagged")
    stand = keyed.select("doc_id", "th", F.explode(terms_of("text")).alias("t")).join(small_side(flagged), "t")
    marked = cut(stand.groupBy("doc_id", "th").agg(F.collect_set(F.when(F.col("action") == "remove", F.col("t"))).alias("gone"), F.collect_set(F.when(F.col("action") == "generalise", F.col("t"))).alias("shape")), "pii-marked")
    hit = keyed.join(small_side(marked.select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), "gone", "shape")), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")))
    terms = located("text", TERM, lambda m: F.array_contains(F.col("gone"), F.lower(m)) | F.array_contains(F.col("shape"), F.lower(m)))
    extra = hit.select("doc_id", "th", F.transform(terms, lambda x: F.struct(x["s"].alias("s"), F.when(F.array_contains(F.col("gone"), F.lower(x["m"])), 4).otherwise(5).alias("k"), x["e"].alias("e"))).alias("more"))
    extra = extra.dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("x_id"), F.col("th").alias("x_th"), "more")
    every = base.select("doc_id", "th", "spans").dropDuplicates(["doc_id", "th"]).join(extra, F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("th") == F.col("x_th")), "full")
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    # a document without base spans has terms only
    every = every.select(F.when(F.col("th").isNull(), F.col("x_id")).otherwise(F.col("doc_id")).alias("s_id"), F.coalesce("th", "x_th").alias("s_th"), F.coalesce("spans", none).alias("spans"), F.coalesce("more", none).alias("more"))
    clear = F.filter("more", lambda t: ~F.exists("spans", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    every = cut(every.select("s_id", "s_th", "spans", F.array_sort(F.concat("spans", clear)).alias("all_spans")), "pii-spans")
    rows = own.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("__row"), "doc_id", F.coalesce("text", F.lit("")).alias("__t")).withColumn("__th", F.xxhash64("__t"))
    if not with_text:
        rows = rows.drop("__t")
    out = rows.join(small_side(every), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("__th") == F.col("s_th")), "left")
    out = out.withColumn("__b", F.coalesce("spans", none)).withColumn("__a", F.coalesce("all_spans", none))
    names = F.array(*[F.lit(x) for x in (*KINDS, "remove", "generalise")])
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    counts = [F.size(F.filter("__b", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    clean = [_masked("__t", "__a").alias("clean_text")] if with_text else []
    return out.select("__row.*", *counts, F.sha2(said("__b"), 256).alias("base_sha256"), said("__a").alias("spans"), *clean)


def _masked(text: str, spans: str) -> Column:
    """The text with its spans replaced; of overlapping spans the first counts and the rest of the others is cut."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def shape(x):
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\p{Lu}", "X"), r"[\p{L}&&[^\p{Lu}]]", "x"), r"\p{N}", "0")

    def add(acc, x):
        at = F.greatest(acc["at"], x["s"])
        piece = F.substring(F.col(text), x["s"] + 1, x["e"] - x["s"])
        put = F.when(x["s"] < acc["at"], "").when(x["k"] == 4, "").when(x["k"] == 5, shape(piece)).otherwise(F.concat(F.lit("["), F.element_at(F.array(*[F.lit(k.upper()) for k in KINDS]), F.least(x["k"], F.lit(3)) + 1), F.lit("]")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, at - acc["at"]), put).alias("out"))

    return F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).drop("text")


SQL = None

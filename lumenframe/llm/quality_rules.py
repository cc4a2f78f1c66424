"""Line-first quality rules: each line passes punctuation, navigation and boilerplate rules or goes; a document that loses too many words goes too.

Defined cases: a null or empty text has no words, fails the base and is not kept. Blank lines are neither judged nor counted.
Repeated rows and null ids are judged each alone; texts of any length are taken whole; an empty table gives an empty result. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, without

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "›", "·", "•")
#: A line ends well with one of these marks, and closing quotes or brackets after it.
END = re.compile("[.!?…:;。！？][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*$")
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in to",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign up for",
    "subscribe to",
    "terms of service",
    "terms of use",
    "uses cookies",
)
BOILERPLATE_RE = re.compile("|".join(BOILERPLATE))
#: Boilerplate phrases condemn a line of at most so many words; longer lines are prose that mentions them.
BOILERPLATE_WORDS = 30
#: A document goes if it loses more than this percentage of its words.
MAX_LOST_PERCENT = 40
#: Text that a worker judges and holds at a time.
SLICE_BYTES = 2 << 20

FIELDS = pa.struct(
    [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("lost_words", pa.int64()), ("kept", pa.bool_()), ("clean_text", pa.string())]
)
TYPE = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,lost_words:bigint,kept:boolean,clean_text:string>"


def line_fails(line: str, words: list[str]) -> bool:
    n = len(words)
    if not END.search(line):
        return True
    if 2 * sum(map(line.count, SYMBOLS)) >= n and n >= 3:
        return True
    if 5 * (line.count("!!") + line.count("??")) >= n and n >= 3:
        return True
    seps = sum(map(words.count, SEPARATORS))
    if seps >= 2 and 5 * seps >= n:
        return True
    return n <= BOILERPLATE_WORDS and bool(BOILERPLATE_RE.search(line.lower()))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 5-word window found at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    times: dict = {}
    for x in windows:
        times[x] = times.get(x, 0) + 1
    covered = reached = 0
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered += i + 5 - max(i, reached)
            reached = i + 5
    return covered


def judge(text: str | None, max_lost: int = MAX_LOST_PERCENT) -> tuple:
    words: list[str] = []
    seen: set[str] = set()
    kept: list[str] = []
    dup = lost = 0
    text = text or ""
    for line in text.split("\n"):
        own = WORDS.findall(line)
        if not own:
            kept.append(line)
            continue
        words += own
        dup += line in seen
        seen.add(line)
        if line_fails(line, own):
            lost += len(own)
        else:
            kept.append(line)
    n, repeated = len(words), repeated_words(words)
    failed = n < 10 or 100 * repeated > 20 * n
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated, failed, lost, not failed and 100 * lost <= max_lost * n, "\n".join(kept)


def quality_rules(df: DataFrame, text: str = "text", max_lost: int = MAX_LOST_PERCENT, with_text: bool = True) -> DataFrame:
    """df with the counts, the verdict `kept` and, if asked for, `clean_text`, which holds the lines that passed."""

    @F.arrow_udf(TYPE)
    def rules(texts: pa.Array) -> pa.Array:
        rows = [judge(x, max_lost) for x in texts.to_pylist()]
        columns = list(zip(*rows)) or [[] for _ in FIELDS]
        if not with_text:
            columns[-1] = [None] * len(rows)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS)], fields=list(FIELDS))

    names = [f.name for f in FIELDS]
    base = df.select(F.col(f"`{text}`").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in without(df, names).columns]).alias("__row"))
    out = base.select("__row", rules("__text").alias("__rules")).select("__row.*", "__rules.*")
    return out if with_text else out.drop("clean_text")


def kept_rows(df: DataFrame, max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """The rows (doc_id, text and more) that the rules keep, with the lines that passed as text and their length as n_chars, if that is a column.

    Each text is judged once. A worker holds one slice of SLICE_BYTES, or one text if that is longer, and the clean texts of what is kept of it.
    """
    names = df.columns
    at = [c.lower() for c in names]
    text, chars = at.index("text"), at.index("n_chars") if "n_chars" in at else None

    def run(batches):
        for batch in batches:
            start = 0
            while start < len(batch):
                n = slice_rows(batch.column(text), start)
                part = batch.slice(start, n)
                start += n
                rows, clean = [], []
                for i, x in enumerate(part.column(text)):
                    verdict = judge(x.as_py(), max_lost)
                    if verdict[7]:
                        rows.append(i)
                        clean.append(verdict[8])
                if rows:
                    columns = part.take(pa.array(rows, pa.int64())).columns
                    columns[text] = pa.array(clean, columns[text].type)
                    if chars is not None:
                        columns[chars] = pa.array(list(map(len, clean)), pa.int64()).cast(columns[chars].type)
                    yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(run, df.schema)


def slice_rows(texts: pa.Array, start: int) -> int:
    """How many rows from start hold SLICE_BYTES of text at most; one at least."""
    total = n = 0
    for x in texts.slice(start):
        total += x.as_buffer().size if x.is_valid else 0
        if n and total > SLICE_BYTES:
            break
        n += 1
    return n


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, each with the lines that passed."""
    return kept_rows(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, with_text=False).drop("text")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
lw AS (SELECT *, regexp_extract_all(line, '{WORD}') AS w FROM l),
lj AS (
  SELECT rid, len(w) AS n, row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS dup,
    NOT regexp_matches(line, '[.!?…:;。！？]["''”’»)\]]*[\x20\x09-\x0D]*$')
    OR (2 * len(regexp_extract_all(line, '[#*$%&|<>]')) >= len(w) AND len(w) >= 3)
    OR (5 * (len(regexp_extract_all(line, '!!')) + len(regexp_extract_all(line, '\?\?'))) >= len(w) AND len(w) >= 3)
    OR (len(list_filter(w, lambda x: x IN ('|', '»', '›', '·', '•'))) >= 2 AND 5 * len(list_filter(w, lambda x: x IN ('|', '»', '›', '·', '•'))) >= len(w))
    OR (len(w) <= {BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')) AS fails
  FROM lw WHERE len(w) > 0),
la AS (SELECT rid, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(n) FILTER (fails), 0)::BIGINT AS lost_words FROM lj GROUP BY rid),
dw AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
win AS (SELECT rid, i, w[i:i+4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(5) AS r(k) GROUP BY rid),
a AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM dw LEFT JOIN la USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND 100 * lost_words <= {MAX_LOST_PERCENT} * n_words AS kept FROM b
"""

"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1. Its integral gives the source's cumulative token demand; inverting that demand at a
document's token offset within its source gives the document's training position, and documents are range-sorted by position.

Targets: sources by code point, null last, share `budget` times all sizes by weight; a target stops at `max_repeat` times its source's size and the excess is
shared anew by weight until none is above. A source's words are taken in whole passes over its documents in the order of md5(id), then a last partial pass, in
which the document at the end is taken in part; so a source's taken words are its target rounded.

Scale: one aggregation by source, one by (source, bucket), where a bucket is a prefix of md5(id) that is lengthened as the largest source grows; running sums
are windows over one bucket each, so that a source with a third of all rows is summed in many tasks. Only tables of sources are put in one task.

Defined cases: a null text has size 0 and takes 0; null sources are one source, the last; null ids sort first in their bucket; repeated rows each take part; texts of
any length count whole; an empty table gives an empty result. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table, without, word_count

WEIGHTS = (3, 1, 2)
#: Schedules by the place of a source's weight: knots (time, weight), linear between. The first falls, the second rises, the third is level.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
BUDGET, MAX_REPEAT = 1.5, 2
#: Rows that a bucket holds on average at most.
BUCKET_ROWS = 20_000
OWN = ["size", "source_size", "target", "taken", "position", "passes", "positions"]


def segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(time, weight, slope, area before, area after) of each piece; the areas are shares of the whole."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        after = before + (t1 - t0) * (w0 + w1) / 2 / area
        out.append((t0, w0 / area, (w1 - w0) / (t1 - t0) / area, before, after))
        before = after
    return out


def inverted(share: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which the cumulative demand of schedule number `place` reaches `share` (0 to 1)."""
    out = F.lit(None).cast("double")
    for k, knots in reversed(list(enumerate(schedules))):
        parts = segments(knots)
        own = F.lit(None).cast("double")
        for i, (t, w, slope, before, after) in reversed(list(enumerate(parts))):
            rest = share - F.lit(before)
            root = F.lit(w) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + F.lit(2 * slope) * rest))
            at = F.lit(t) + F.when(root > 0, F.lit(2.0) * rest / root).otherwise(F.lit(0.0))
            own = at if i == len(parts) - 1 else F.when(share < F.lit(after), at).otherwise(own)
        out = F.when(place == k, own).otherwise(out)
    return out


def targets(by_source: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """by_source has __source and __size, a row a source. Adds __place (of its weight) and __target."""
    everything = Window.partitionBy(F.lit(0))
    ranked = by_source.withColumn("__place", ((F.row_number().over(everything.orderBy(F.col("__source").asc_nulls_last())) - 1) % len(weights)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("__place") + 1)
    ranked = ranked.withColumn("__weight", weight).withColumn("__cap", F.col("__size") * F.lit(float(max_repeat)))
    by_ratio = everything.orderBy(F.col("__cap") / F.col("__weight"), F.col("__source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.lit(float(budget)) * F.sum("__size").over(everything)
    capped = F.col("__cap") * (F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))) <= F.col("__weight") * (whole - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    out = ranked.withColumn("__whole", whole).withColumn("__capped", capped)
    spent, left = F.sum(F.when(F.col("__capped"), F.col("__cap")).otherwise(0.0)).over(everything), F.sum(F.when(F.col("__capped"), 0.0).otherwise(F.col("__weight"))).over(everything)
    target = F.when(F.col("__capped"), F.col("__cap")).otherwise(F.col("__weight") * (F.col("__whole") - spent) / left)
    return out.withColumn("__target", target).select("__source", "__size", "__place", "__target")


def mix(df: DataFrame, id: str = "doc_id", source: str = "source", size: Column | None = None, text: str = "text", weights=WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """df with size, source_size, target, taken, passes (times that the document starts), position (of the first pass; null if there is none) and positions (of all)."""
    own = without(df, OWN)
    base = df.select((word_count(F.col(f"`{text}`")) if size is None else size).alias("__n"), F.col(f"`{source}`").alias("__source"), F.col(f"`{id}`").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("__row"))
    base = base.withColumn("__md5", F.md5(F.coalesce(F.col("__id").cast("string"), F.lit(""))))
    sums = cut(base.groupBy("__source", F.substring("__md5", 1, 4).alias("__b4")).agg(F.sum("__n").alias("__s"), F.count("*").alias("__c")), "mix-sums")
    by_source = sums.groupBy("__source").agg(F.sum("__s").alias("__size"), F.sum("__c").alias("__c"))
    most = by_source.agg(F.max("__c")).first()[0] or 0
    width = max(1, math.ceil(math.log(max(1, most / BUCKET_ROWS), 16)))
    goals = targets(by_source.drop("__c"), weights, budget, max_repeat)
    bucket = F.substring("__md5", 1, width).alias("__bucket")
    by_bucket = base.groupBy("__source", bucket).agg(F.sum("__n").alias("__s")) if width > 4 else sums.groupBy("__source", F.substring("__b4", 1, width).alias("__bucket")).agg(F.sum("__s").alias("__s"))
    offsets = by_bucket.withColumn("__before", F.coalesce(F.sum("__s").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = cut(
        offsets.join(goals, offsets["__source"].eqNullSafe(goals["__source"])).select(offsets["__source"].alias("__psource"), F.col("__bucket").alias("__pbucket"), "__before", "__size", "__place", "__target"), "mix-plan"
    )
    within = Window.partitionBy("__source", "__bucket").orderBy("__md5", "__id", "__n").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("__bucket", bucket).withColumn("__in", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    joined = placed.join(plan, F.col("__source").eqNullSafe(F.col("__psource")) & (F.col("__bucket") == F.col("__pbucket")))
    words = F.floor(F.col("__target") + 0.5).cast("long")
    start = F.col("__before") + F.col("__in")
    full = F.when(F.col("__size") > 0, F.expr("CAST(floor(__target + 0.5) AS BIGINT) div __size")).otherwise(F.lit(0))
    rest = F.least(F.greatest(words - full * F.col("__size") - start, F.lit(0)), F.col("__n"))
    out = joined.withColumn("__full", full).withColumn("__start", start).withColumn("__rest", rest).withColumn("__words", words)
    passes = F.when(F.col("__n") > 0, F.col("__full") + (F.col("__rest") > 0).cast("int")).otherwise(F.lit(0))
    at = lambda k: F.round(inverted((F.col("__start") + k * F.col("__size")).cast("double") / F.col("__words"), F.col("__place"), schedules), 6)
    out = out.withColumn("passes", passes.cast("int"))
    positions = F.transform(F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>")), at)
    return out.select(
        "__row.*", F.col("__n").alias("size"), F.col("__size").alias("source_size"), F.col("__target").alias("target"), (F.col("__full") * F.col("__n") + F.col("__rest")).alias("taken"), "passes", positions.alias("positions"), F.col("__rest").alias("__partial")
    ).withColumn("position", F.get("positions", F.lit(0)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as training reads it: a row for each pass over a document, in the order of positions. A last, partial pass holds the words taken."""
    return passes_of(mix(docs)).select(*docs.columns)


def passes_of(mixed: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """A row for each pass over each document of mix's result, range-sorted by position, the text of a last, partial pass cut to the words taken; n_chars is the text's length."""
    rows = mixed.select("*", F.posexplode("positions").alias("__k", "__at"))
    last = (F.col("__k") == F.col("passes") - 1) & (F.col("__partial") > 0) & (F.col("__partial") < F.col("size"))
    head = F.when(last, cut_words(F.col(text), F.col("__partial"))).otherwise(F.col(text))
    out = rows.withColumn(text, head).withColumn("n_chars", F.length(text).cast("long"))
    return out.repartitionByRange(F.col("__at"), F.col(id), F.col("__k")).sortWithinPartitions(F.col("__at"), F.col(id), F.col("__k")).drop("__k", "__at")


def cut_words(text: Column, n: Column) -> Column:
    """The first n words of a text, joined by spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n.cast("int")), " ")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("__size0")), "mix-sizes")
    out = mix(sized, size=F.col("__size0"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position", F.get("positions", F.lit(1)).alias("second_position")).repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][place + 1]::DOUBLE AS weight, ss * 2.0::DOUBLE AS cap FROM r),
c AS (
  SELECT *, 1.5::DOUBLE * sum(ss) OVER () AS whole,
    cap * (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) <= weight * (1.5::DOUBLE * sum(ss) OVER () - coalesce(sum(cap) OVER o, 0)) AS capped
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, CASE WHEN capped THEN cap ELSE weight * (whole - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ()) / sum(CASE WHEN capped THEN 0.0 ELSE weight END) OVER () END::DOUBLE AS target FROM c),
p AS (
  SELECT d.doc_id, d.size, t.ss, t.place, t.target, floor(t.target + 0.5)::BIGINT AS words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN ss > 0 THEN words // ss ELSE 0 END AS full_passes FROM p),
k AS (SELECT *, least(greatest(words - full_passes * ss - start, 0), size) AS rest, start::DOUBLE / words AS share, (start + ss)::DOUBLE / words AS again FROM q),
v AS (SELECT *, CASE place WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w0, CASE place WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS slope FROM k)
SELECT doc_id, size, ss AS source_size, target, (full_passes * size + rest)::BIGINT AS taken,
  CASE WHEN size > 0 AND (full_passes > 0 OR rest > 0) THEN round(2.0::DOUBLE * share / (w0 + sqrt(w0 * w0 + 2.0::DOUBLE * slope * share)), 6) END AS position,
  CASE WHEN size > 0 AND full_passes + (CASE WHEN rest > 0 THEN 1 ELSE 0 END) > 1 THEN round(2.0::DOUBLE * again / (w0 + sqrt(greatest(0.0::DOUBLE, w0 * w0 + 2.0::DOUBLE * slope * again))), 6) END AS second_position
FROM v
"""

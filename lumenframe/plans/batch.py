"""Queries of batches, names, parsing, and review analytics."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .. import catalog as C
from ..functions import stats, text
from ..sources.scenes import table


def batch_items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items over their customers as defaults, field by field: the item's value where set, else the default's, else the engine's."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.expr("nullif(o_orderkey % 5, 0) * 10").alias("tolerance"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0.5D + (o_orderkey % 50) / 100.0D END").alias("fill_ratio"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END").alias("profile"))
    c = table(spark, d, "customer").select("c_custkey", F.expr("nullif(c_custkey % 7, 0)").alias("d_tolerance"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 0.9D END").alias("d_fill"), F.col("c_mktsegment").alias("d_profile"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("id", F.coalesce("tolerance", "d_tolerance", F.lit(12)).alias("tolerance"), F.coalesce("fill_ratio", "d_fill", F.lit(0.85)).alias("fill_ratio"), F.coalesce("profile", "d_profile").alias("profile"))


ITEMS_SQL = """SELECT o_orderkey AS id, coalesce(nullif(o_orderkey % 5, 0) * 10, nullif(c_custkey % 7, 0), 12) AS tolerance,
  coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE END, CASE WHEN c_custkey % 2 = 0 THEN 0.9::DOUBLE END, 0.85::DOUBLE) AS fill_ratio,
  coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, c_mktsegment) AS profile FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""

_STATUS = "CASE WHEN o_orderkey % 23 = 0 THEN 'error' WHEN o_orderkey % 11 = 0 THEN 'rejected' ELSE 'ok' END"


def batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.expr(_STATUS).alias("s"), F.expr("o_orderkey % 3").alias("w"))
    n = o.groupBy(F.col("o_custkey").alias("batch")).agg(F.count_if(F.col("s") == "ok").alias("succeeded"), F.count_if(F.col("s") == "error").alias("failed"), F.count_if(F.col("s") == "rejected").alias("rejected"), F.count_if((F.col("s") == "ok") & (F.col("w") > 0)).alias("with_warnings"))
    return n.withColumn("exit", F.when(F.col("failed") > 0, 4).when(F.col("rejected") > 0, 5).otherwise(0))


ROLLUP_SQL = f"""WITH o AS (SELECT o_custkey AS batch, {_STATUS} AS s, o_orderkey % 3 AS w FROM orders), n AS (SELECT batch, count(*) FILTER (s = 'ok') AS succeeded, count(*) FILTER (s = 'error') AS failed, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'ok' AND w > 0) AS with_warnings FROM o GROUP BY batch)
SELECT *, CASE WHEN failed > 0 THEN 4 WHEN rejected > 0 THEN 5 ELSE 0 END AS exit FROM n"""


def set_fill(spark: SparkSession, d: str) -> DataFrame:
    """The set's target is the interpolating median of its items' occupancy, 1 at most; sets aligned by height ask more of wide content, which may be beyond the canvas."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.expr("CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey * 37 % 900 + 100) / 1000.0D END").alias("occupancy"), F.expr("CAST(200 + o_orderkey * 37 % 900 AS DOUBLE)").alias("cw"), F.expr("CAST(200 + o_orderkey * 53 % 700 AS DOUBLE)").alias("ch"))
    # least would take 1 where no item of the set has an occupancy
    middle = stats.middle_median(F.col("a"))
    m = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("occupancy")).alias("a")).select("o_custkey", F.when(middle > 1, F.lit(1.0)).otherwise(middle).alias("target"))
    by_height = F.col("target") * F.greatest(F.lit(1.0), F.lit(800.0) * F.col("cw") / (F.lit(1000.0) * F.col("ch")))
    j = o.join(m, "o_custkey").withColumn("fill", F.when(F.col("o_custkey") % 2 == 0, by_height).otherwise(F.col("target")))
    return j.select("id", stats.round_scaled(F.col("target"), 6).alias("target"), stats.round_scaled(F.col("fill"), 6).alias("fill"), (F.col("fill") > 1).alias("beyond"))


SET_SQL = """WITH o AS (SELECT o_custkey, o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey * 37 % 900 + 100) / 1000.0::DOUBLE END AS occupancy, (200 + o_orderkey * 37 % 900)::DOUBLE AS cw, (200 + o_orderkey * 53 % 700)::DOUBLE AS ch FROM orders),
m AS (SELECT o_custkey, CASE WHEN median(occupancy) > 1 THEN 1.0::DOUBLE ELSE median(occupancy) END AS target FROM o GROUP BY o_custkey),
f AS (SELECT id, target, CASE WHEN o_custkey % 2 = 0 THEN target * greatest(1.0::DOUBLE, 800.0::DOUBLE * cw / (1000.0::DOUBLE * ch)) ELSE target END AS fill FROM o JOIN m USING (o_custkey))
SELECT id, round(target, 6) AS target, round(fill, 6) AS fill, fill > 1 AS beyond FROM f"""


def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") * 7919 % 3_000_000
    return table(spark, d, "orders").select("o_orderkey", text.human_bytes(n).alias("size"), text.human_bytes(F.col("o_orderkey") % 2000).alias("small"))


_HUMAN = "CASE WHEN {n} >= 1048576 THEN printf('%.1f MB', {n} / 1048576.0::DOUBLE) WHEN {n} >= 1024 THEN printf('%.1f KB', {n} / 1024.0::DOUBLE) ELSE ({n})::VARCHAR || ' B' END"
BYTES_SQL = f"SELECT o_orderkey, {_HUMAN.format(n='(o_orderkey * 7919 % 3000000)')} AS size, {_HUMAN.format(n='(o_orderkey % 2000)')} AS small FROM orders"


def output_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Outputs whose paths are equal without case, with the first and second item of each."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("Out")).otherwise("out"), F.expr("CAST(page_id % 97 AS STRING)"), F.lit(".png")).alias("path"))
    g = p.groupBy(F.lower("path").alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("page_id")).alias("ids")).filter("n > 1")
    return g.select("key", "n", F.col("ids")[0].alias("first"), F.col("ids")[1].alias("second"))


COLLISIONS_SQL = """WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Out' ELSE 'out' END || (page_id % 97)::VARCHAR || '.png' AS path FROM pages)
SELECT lower(path) AS key, count(*) AS n, list_sort(list(page_id))[1] AS first, list_sort(list(page_id))[2] AS second FROM p GROUP BY lower(path) HAVING count(*) > 1"""


def names(spark: SparkSession, d: str) -> DataFrame:
    """Stems, extensions, rendered names, and whether a template is valid."""
    p = table(spark, d, "pages").select("page_id", "url", F.expr("element_at(array('{stem}-{index}.{ext}', '{stem}_{width}x{height}', '{bad}.png', 'a/{stem}', '{stem'), 1 + CAST(page_id % 5 AS INT))").alias("t"))
    vals = {"stem": text.stem(F.col("url")), "index": F.col("page_id").cast("string"), "width": F.lit("800"), "height": F.lit("600"), "ext": F.lit("png"), "role": F.lit("main")}
    ok = text.valid_template(F.col("t"))
    return p.select("page_id", text.stem(F.col("url")).alias("stem"), ok.alias("valid"), F.when(ok, text.render_name(F.col("t"), vals)).alias("name"), text.xml_escape(F.concat(F.lit("<&\"'>"), "url")).alias("escaped"))


NAMES_SQL = r"""WITH p AS (SELECT page_id, url, ['{stem}-{index}.{ext}', '{stem}_{width}x{height}', '{bad}.png', 'a/{stem}', '{stem'][1 + (page_id % 5)::INT] AS t, regexp_extract(url, '([^/]*?)(?:\.[^./]*)?$', 1) AS stem FROM pages),
v AS (SELECT *, NOT regexp_matches(regexp_replace(t, '\{(?:stem|index|width|height|ext|role)\}', '', 'g'), '[{}/\\]') AS valid FROM p)
SELECT page_id, stem, valid, CASE WHEN valid THEN replace(replace(replace(replace(replace(t, '{stem}', stem), '{index}', page_id::VARCHAR), '{width}', '800'), '{height}', '600'), '{ext}', 'png') END AS name,
  replace(replace(replace(replace(replace('<&"''>' || url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM v"""


def closest_keys(spark: SparkSession, d: str) -> DataFrame:
    """Setting names with a typing error, and the setting that is meant."""
    n = len(C.SETTING_KEYS)
    keys = F.array(*[F.lit(k) for k in C.SETTING_KEYS])
    p = table(spark, d, "part").select("p_partkey", F.element_at(keys, F.expr(f"1 + CAST(p_partkey % {n} AS INT)")).alias("k"))
    typed = p.select("p_partkey", F.expr("concat(substring(k, 1, CAST(p_partkey % 3 AS INT)), CASE WHEN p_partkey % 4 = 0 THEN 'zzz' ELSE 'x' END, substring(k, 2 + CAST(p_partkey % 3 AS INT), 99))").alias("typed"))
    return typed.select("p_partkey", "typed", text.closest(F.col("typed"), C.SETTING_KEYS).alias("meant"))


CLOSEST_SQL = f"""WITH k AS (SELECT unnest({C.SETTING_KEYS!r}) AS key, generate_subscripts({C.SETTING_KEYS!r}, 1) AS i), p AS (SELECT p_partkey, {C.SETTING_KEYS!r}[1 + (p_partkey % {len(C.SETTING_KEYS)})::INT] AS k FROM part),
t AS (SELECT p_partkey, substr(k, 1, (p_partkey % 3)::INT) || CASE WHEN p_partkey % 4 = 0 THEN 'zzz' ELSE 'x' END || substr(k, 2 + (p_partkey % 3)::INT, 99) AS typed FROM p),
r AS (SELECT p_partkey, typed, key, levenshtein(typed, key) AS dist, row_number() OVER (PARTITION BY p_partkey ORDER BY levenshtein(typed, key), i) AS rn FROM t, k)
SELECT p_partkey, typed, CASE WHEN dist <= 2 THEN key END AS meant FROM r WHERE rn = 1"""


def parsers(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, colours, byte limits and boxes read from strings made of table values; null is refused."""
    p = table(spark, d, "part").select(
        "p_partkey",
        F.expr("concat(CAST(p_size % 9 AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN concat('x', CAST(p_size AS STRING)) ELSE 'y3' END)").alias("size_s"),
        F.expr("concat(CASE WHEN p_partkey % 2 = 0 THEN '#' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN 'fa3' WHEN p_partkey % 5 = 1 THEN 'xyz' ELSE lower(lpad(hex(p_partkey * 7919 % 16777216), 6, '0')) END)").alias("color_s"),
        F.expr("concat(CAST(p_size % 12 AS STRING), element_at(array('kb', 'MiB', '', 'm', 'q'), 1 + CAST(p_partkey % 5 AS INT)))").alias("bytes_s"),
        F.expr("concat(CAST(p_partkey % 10 AS STRING), ',1,', CAST(p_size % 20 AS STRING), ',5.5')").alias("bbox_s"),
    )
    s, c, b = text.parse_size(F.col("size_s")), text.parse_hex_color(F.col("color_s")), text.parse_bbox(F.col("bbox_s"))
    return p.select("p_partkey", s["w"].alias("w"), s["h"].alias("h"), c[0].alias("r"), c[1].alias("g"), c[2].alias("b"), text.parse_max_bytes(F.col("bytes_s")).alias("max_bytes"), b[0].alias("x1"), b[2].alias("x2"))


PARSERS_SQL = """WITH p AS (SELECT p_partkey, p_size % 9 AS n, p_size AS m, p_partkey % 3 AS k3, CASE WHEN p_partkey % 5 = 0 THEN 'ffaa33' WHEN p_partkey % 5 = 1 THEN NULL ELSE lower(lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0')) END AS c,
  (p_size % 12)::BIGINT AS q, [1000, 1048576, 1, 1000000, NULL][1 + (p_partkey % 5)::INT] AS u, (p_partkey % 10)::DOUBLE AS x1, (p_size % 20)::DOUBLE AS x2 FROM part)
SELECT p_partkey, CASE WHEN k3 = 0 AND n > 0 THEN n WHEN k3 = 1 AND n > 0 AND m > 0 THEN n END AS w, CASE WHEN k3 = 0 AND n > 0 THEN n WHEN k3 = 1 AND n > 0 AND m > 0 THEN m END AS h,
  ('0x' || substr(c, 1, 2))::INT AS r, ('0x' || substr(c, 3, 2))::INT AS g, ('0x' || substr(c, 5, 2))::INT AS b, CASE WHEN q > 0 THEN q * u END AS max_bytes, CASE WHEN x1 < x2 THEN x1 END AS x1, CASE WHEN x1 < x2 THEN x2 END AS x2 FROM p"""


@F.pandas_udf(LongType())
def _adler32(pages: pd.Series) -> pd.Series:
    return pages.map(lambda x: zlib.adler32(x.encode()), na_action="ignore")


def digests(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 and Adler-32 of page bytes: of the whole html as UTF-8."""
    p = table(spark, d, "pages")
    return p.select("page_id", F.sha2("html", 256).alias("sha256"), _adler32("html").alias("adler32"))


DIGESTS_SQL = """WITH p AS (SELECT page_id, html, hex(encode(html)) AS x FROM pages), c AS (SELECT page_id, unnest(range(1, length(x) // 2 + 1)) AS i, x FROM p),
s AS (SELECT page_id, count(*) AS n, sum(('0x' || substr(x, (2 * i - 1)::INT, 2))::INT)::BIGINT AS t, sum((length(x) // 2 - i + 1) * ('0x' || substr(x, (2 * i - 1)::INT, 2))::INT)::BIGINT AS w FROM c GROUP BY page_id)
SELECT p.page_id, CASE WHEN html IS NOT NULL THEN sha256(html) END AS sha256, CASE WHEN html IS NOT NULL THEN ((coalesce(n, 0) + coalesce(w, 0)) % 65521) * 65536 + (1 + coalesce(t, 0)) % 65521 END AS adler32 FROM p LEFT JOIN s ON s.page_id = p.page_id"""


def latest_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each image; the later id wins ties. max_by aggregates partially, so a hot image is a row a task."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("image")).agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("r"), F.count("*").alias("versions")).select("image", F.col("r.event_id").alias("event_id"), F.col("r.event_type").alias("event_type"), "versions")


LATEST_SQL = "SELECT image, event_id, event_type, versions FROM (SELECT user_id AS image, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS versions FROM events) WHERE rn = 1"


def review_rows(spark: SparkSession, d: str) -> DataFrame:
    """Regions of images with a warning code, a score, a rectangle, a person's verdict and one suggested by a known truth, either of which may be missing."""
    e = table(spark, d, "events")
    hit = "CASE WHEN event_id % 3 = 0 THEN 2000 + 8 * (event_id * 7919 % 1000) ELSE 10 * (event_id * 7919 % 1000) END / 10000.0D"
    suggest = "CASE event_id % 7 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' END"
    return e.selectExpr("event_id", "user_id AS image", "event_id % 5 AS code", "CASE WHEN event_id % 3 = 0 THEN 'hit' WHEN event_id % 3 = 1 THEN 'miss' END AS verdict", f"{suggest} AS suggest", f"{hit} AS score", "event_id % 40 AS x1", "event_id * 3 % 40 AS y1", "event_id % 40 + 10 AS x2", "event_id * 3 % 40 + 8 AS y2")


def label_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles that a person drew for a kind of fault; labels of the whole image match nothing."""
    return table(spark, d, "events").filter("event_id % 4 = 1 AND event_id % 11 != 0").selectExpr("event_id AS label_id", "user_id AS image", "event_id div 4 % 5 AS code", "event_id * 5 % 40 AS lx1", "event_id * 7 % 40 AS ly1", "event_id * 5 % 40 + 12 AS lx2", "event_id * 7 % 40 + 12 AS ly2")


_RR = """r AS (SELECT event_id, user_id AS image, event_id % 5 AS code, CASE WHEN event_id % 3 = 0 THEN 'hit' WHEN event_id % 3 = 1 THEN 'miss' END AS verdict, CASE event_id % 7 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' END AS suggest,
  CASE WHEN event_id % 3 = 0 THEN 2000 + 8 * (event_id * 7919 % 1000) ELSE 10 * (event_id * 7919 % 1000) END / 10000.0::DOUBLE AS score, event_id % 40 AS x1, event_id * 3 % 40 AS y1, event_id % 40 + 10 AS x2, event_id * 3 % 40 + 8 AS y2 FROM events)"""
_LR = "lb AS (SELECT event_id AS label_id, user_id AS image, event_id // 4 % 5 AS code, event_id * 5 % 40 AS lx1, event_id * 7 % 40 AS ly1, event_id * 5 % 40 + 12 AS lx2, event_id * 7 % 40 + 12 AS ly2 FROM events WHERE event_id % 4 = 1 AND event_id % 11 <> 0)"
_MEET = "lx1 < x2 AND x1 < lx2 AND ly1 < y2 AND y1 < ly2"


def calibration(spark: SparkSession, d: str) -> DataFrame:
    """By warning code: regions by what decides them, first a person's verdict, then a label of the code's kind that overlaps, then the truth; labels and how many a region meets; spread of hits' scores.

    Scores have four decimals, so the quantile's partial results are bounded."""
    r, lb = review_rows(spark, d).alias("r"), label_rows(spark, d).alias("lb")
    meet = F.expr(f"r.image = lb.image AND r.code = lb.code AND {_MEET}")
    implied = r.filter("verdict IS NULL").join(lb, meet, "left_semi").select("event_id", F.lit(True).alias("implied"))
    j = review_rows(spark, d).join(implied, "event_id", "left").withColumn("state", F.expr("CASE WHEN verdict IS NOT NULL THEN verdict WHEN implied THEN 'implied' WHEN suggest IS NOT NULL THEN concat('truth_', suggest) ELSE 'unjudged' END"))
    names = ["hit", "miss", "implied", "truth_hit", "truth_miss", "unjudged"]
    score = "CASE WHEN state IN ('hit', 'implied', 'truth_hit') THEN score END"
    by = j.withColumn("hit_score", F.expr(score)).groupBy("code").agg(F.count("*").alias("regions"), *[F.count_if(F.col("state") == n).alias(n) for n in names], F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY hit_score)").alias("lower_median"), F.min("hit_score").alias("low"), F.max("hit_score").alias("high"))
    matched = lb.join(r, meet, "left_semi").groupBy("code").agg(F.count("*").alias("matched"))
    labels = label_rows(spark, d).groupBy("code").agg(F.count("*").alias("labels"))
    return by.join(labels, "code", "left").join(matched, "code", "left").withColumns({"labels": F.coalesce("labels", F.lit(0)), "matched": F.coalesce("matched", F.lit(0))})


CALIBRATION_SQL = f"""WITH {_RR}, {_LR}, met AS (SELECT r.event_id, lb.label_id, r.verdict FROM r JOIN lb ON r.image = lb.image AND r.code = lb.code WHERE {_MEET}), i AS (SELECT DISTINCT event_id FROM met WHERE verdict IS NULL), ml AS (SELECT DISTINCT label_id FROM met),
s AS (SELECT r.code, CASE WHEN verdict IS NOT NULL THEN verdict WHEN i.event_id IS NOT NULL THEN 'implied' WHEN suggest IS NOT NULL THEN 'truth_' || suggest ELSE 'unjudged' END AS state, score FROM r LEFT JOIN i ON i.event_id = r.event_id),
g AS (SELECT code, count(*) AS regions, {", ".join(f"count(*) FILTER (state = '{n}') AS {n}" for n in ("hit", "miss", "implied", "truth_hit", "truth_miss", "unjudged"))},
  quantile_disc(CASE WHEN state IN ('hit', 'implied', 'truth_hit') THEN score END, 0.5) AS lower_median, min(CASE WHEN state IN ('hit', 'implied', 'truth_hit') THEN score END) AS low, max(CASE WHEN state IN ('hit', 'implied', 'truth_hit') THEN score END) AS high FROM s GROUP BY code),
l AS (SELECT code, count(*) AS labels, count(ml.label_id) AS matched FROM lb LEFT JOIN ml ON ml.label_id = lb.label_id GROUP BY code)
SELECT g.*, coalesce(labels, 0) AS labels, coalesce(matched, 0) AS matched FROM g LEFT JOIN l ON l.code = g.code"""


def propose_threshold(spark: SparkSession, d: str) -> DataFrame:
    """For each code the midpoint of neighbouring scores with the best F1, the lower of equals, if it beats keeping all regions. Counts are taken by distinct score
    first, of four decimals, and summed by a window over those."""
    r = review_rows(spark, d).filter("verdict IS NOT NULL")
    by = r.groupBy("code", "score").agg(F.count_if(F.col("verdict") == "hit").alias("h"), F.count_if(F.col("verdict") == "miss").alias("m"))
    w = Window.partitionBy("code")
    up = w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    t = by.withColumns({"kept_hits": F.sum("h").over(up), "kept_misses": F.sum("m").over(up), "hits": F.sum("h").over(w), "misses": F.sum("m").over(w), "below": F.lag("score").over(w.orderBy("score"))})
    t = t.filter("below IS NOT NULL AND hits > 0 AND misses > 0").withColumn("threshold", F.round((F.col("score") + F.col("below")) / 2, 5))
    t = t.withColumn("f1", F.round(F.col("kept_hits") * 2.0 / (F.col("kept_hits") + F.col("kept_misses") + F.col("hits")), 9)).withColumn("now", F.round(F.col("hits") * 2.0 / (F.col("hits") * 2 + F.col("misses")), 9))
    best = t.filter("f1 > now").withColumn("rn", F.row_number().over(w.orderBy(F.desc("f1"), "threshold"))).filter("rn = 1")
    return best.select("code", "threshold", "kept_hits", "kept_misses")


THRESHOLD_SQL = f"""WITH {_RR}, b AS (SELECT code, score, count(*) FILTER (verdict = 'hit') AS h, count(*) FILTER (verdict = 'miss') AS m FROM r WHERE verdict IS NOT NULL GROUP BY code, score),
t AS (SELECT code, score, sum(h) OVER u AS kept_hits, sum(m) OVER u AS kept_misses, sum(h) OVER (PARTITION BY code) AS hits, sum(m) OVER (PARTITION BY code) AS misses, lag(score) OVER (PARTITION BY code ORDER BY score) AS below FROM b WINDOW u AS (PARTITION BY code ORDER BY score DESC)),
f AS (SELECT code, round((score + below) / 2, 5) AS threshold, kept_hits::BIGINT AS kept_hits, kept_misses::BIGINT AS kept_misses, round(kept_hits * 2.0::DOUBLE / (kept_hits + kept_misses + hits), 9) AS f1, round(hits * 2.0::DOUBLE / (hits * 2 + misses), 9) AS now FROM t WHERE below IS NOT NULL AND hits > 0 AND misses > 0)
SELECT code, threshold, kept_hits, kept_misses FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY f1 DESC, threshold) AS rn FROM f WHERE f1 > now) WHERE rn = 1"""


def prune_plan(spark: SparkSession, d: str) -> DataFrame:
    """Files to delete by customer: orphans past the grace time, and the oldest referenced files while the total is over the cap."""
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderdate").alias("made"), F.floor("o_totalprice").alias("size"), (F.col("o_orderkey") % 6 == 0).alias("orphan"), (F.col("o_orderkey") % 4 != 0).alias("past"))
    w = Window.partitionBy("o_custkey", "orphan").orderBy(F.desc("made"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    s = f.withColumn("kept", F.sum("size").over(w))
    gone = F.when(F.col("orphan"), F.col("past")).otherwise(F.col("kept") > 400000)
    return s.filter(gone).select("id", F.when(F.col("orphan"), "orphan").otherwise("over_cap").alias("reason"))


PRUNE_SQL = """WITH f AS (SELECT o_orderkey AS id, o_custkey, o_orderdate AS made, floor(o_totalprice)::BIGINT AS size, o_orderkey % 6 = 0 AS orphan, o_orderkey % 4 <> 0 AS past FROM orders),
s AS (SELECT *, sum(size) OVER (PARTITION BY o_custkey, orphan ORDER BY made DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM f) SELECT id, CASE WHEN orphan THEN 'orphan' ELSE 'over_cap' END AS reason FROM s WHERE CASE WHEN orphan THEN past ELSE kept > 400000 END"""


def open_comments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_id") % 4 != 0).alias("open"), F.count("*").alias("n")).filter("open > 0")


OPEN_SQL = "SELECT user_id, count(*) FILTER (event_id % 4 <> 0) AS open, count(*) AS n FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 4 <> 0) > 0"


def stale_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots that the list referenced before and no longer does: an anti-join of two lists."""
    e = table(spark, d, "events")
    before, now = e.filter("event_id % 97 = 0").select(F.concat_ws("-", "user_id", "event_type").alias("snapshot")), e.filter("event_id % 89 = 0").select(F.concat_ws("-", "user_id", "event_type").alias("snapshot"))
    return before.distinct().join(now.distinct(), "snapshot", "left_anti")


STALE_SQL = """SELECT DISTINCT user_id || '-' || event_type AS snapshot FROM events WHERE event_id % 97 = 0 AND user_id || '-' || event_type NOT IN (SELECT user_id || '-' || event_type FROM events WHERE event_id % 89 = 0)"""


def derivations(spark: SparkSession, d: str) -> DataFrame:
    """Every page's outputs: sizes x formats in declared order, with names; one explode, nothing shuffled."""
    p = table(spark, d, "pages").select("page_id", text.stem(F.col("url")).alias("stem"))
    grid = F.array(*[F.struct(F.lit(i * 3 + j).alias("pos"), F.lit(s).alias("size"), F.lit(f).alias("format")) for i, s in enumerate((400, 800)) for j, f in enumerate(("png", "jpeg", "webp"))])
    return p.withColumn("o", F.explode(grid)).select("page_id", "o.pos", F.concat("stem", F.lit("-"), F.col("o.size").cast("string"), F.lit("."), "o.format").alias("name"), (F.col("o.size") > 500).alias("upscaled"))


DERIVE_SQL = r"""SELECT page_id, (i * 3 + j)::INT AS pos, regexp_extract(url, '([^/]*?)(?:\.[^./]*)?$', 1) || '-' || s || '.' || f AS name, s::INT > 500 AS upscaled FROM pages, (VALUES (0, '400'), (1, '800')) AS a(i, s), (VALUES (0, 'png'), (1, 'jpeg'), (2, 'webp')) AS b(j, f)"""

QUERIES = {
    "batch_items": (batch_items, ITEMS_SQL),
    "batch_rollup": (batch_rollup, ROLLUP_SQL),
    "set_fill": (set_fill, SET_SQL),
    "byte_sizes": (byte_sizes, BYTES_SQL),
    "output_collisions": (output_collisions, COLLISIONS_SQL),
    "names": (names, NAMES_SQL),
    "closest_keys": (closest_keys, CLOSEST_SQL),
    "parsers": (parsers, PARSERS_SQL),
    "digests": (digests, DIGESTS_SQL),
    "latest_reviews": (latest_reviews, LATEST_SQL),
    "calibration": (calibration, CALIBRATION_SQL),
    "propose_threshold": (propose_threshold, THRESHOLD_SQL),
    "prune_plan": (prune_plan, PRUNE_SQL),
    "open_comments": (open_comments, OPEN_SQL),
    "stale_snapshots": (stale_snapshots, STALE_SQL),
    "derivations": (derivations, DERIVE_SQL),
}

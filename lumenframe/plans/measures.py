"""Queries of thresholds, layers, file headers, search adoption and batch checks. Inputs are integer formulas over whole tables, so that every verdict occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, layers, limits
from ..operators import adoption
from ..sources.scenes import table

# Each text is read by Spark and by the SQL alike; 1e0 is a double in both.
CUTS = """SELECT p_partkey AS id, p_partkey % 61 * 1e0 AS tolerance, p_partkey * 7 % 300 / 1e1 AS p50, (p_partkey * 7 % 300 + p_partkey * 3 % 100) / 1e1 AS p90,
  CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 30 / 2e0 END AS requested, 200 + p_partkey * 37 % 6000 AS w, 200 + p_partkey * 53 % 6000 AS h, (800 + p_partkey * 11 % 200) / 1e3 AS uniformity,
  CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'flat' ELSE 'field' END AS asked, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS subject_high, p_partkey * 13 % 400 / 1e1 AS subject_delta FROM part"""


def from_sql(spark: SparkSession, d: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=table(spark, d, name))


def cut_limits(spark: SparkSession, d: str) -> DataFrame:
    t = from_sql(spark, d, "part", CUTS)
    rounded = lambda x, n: F.round(x, 9).alias(n)
    return t.select(
        "id", rounded(limits.core_tolerance("tolerance", "p90"), "core"), limits.shadow_reach("w", "h").alias("reach"), rounded(limits.edge_threshold("requested", "p50", "p90"), "edge"), rounded(limits.scale_at_1000("w", "h"), "scale"),
        rounded(limits.halo_gate("p90"), "halo_from"), limits.background_model("asked", "uniformity").alias("model"), limits.colour_fails("uniformity", "subject_high", "subject_delta", "p50").alias("colour_fails"),
    )


CUT_LIMITS_SQL = f"""WITH t AS ({CUTS}), k AS (SELECT *, CASE WHEN tolerance / 3e0 < 1e0 THEN (CASE WHEN tolerance < 1e0 THEN tolerance ELSE 1e0 END) ELSE tolerance / 3e0 END AS most, round(p90 * 15e0) / 1e1 AS raised FROM t)
SELECT id, round(CASE WHEN most <= 0 THEN 0e0 WHEN 2e0 * p90 > most THEN most WHEN 2e0 * p90 < (CASE WHEN most < 1e0 THEN most ELSE 1e0 END) THEN (CASE WHEN most < 1e0 THEN most ELSE 1e0 END) ELSE 2e0 * p90 END, 9) AS core,
  CAST(CASE WHEN least(w, h) // 24 < 16 THEN 16 WHEN least(w, h) // 24 > 64 THEN 64 ELSE least(w, h) // 24 END AS INT) AS reach,
  round(CASE WHEN requested IS NOT NULL THEN requested WHEN p50 < 8e0 OR raised <= 8e0 THEN 8e0 ELSE raised END, 9) AS edge,
  round(CASE WHEN w <= 1000 AND h <= 1000 THEN 1e0 WHEN w > h THEN w / 1e3 ELSE h / 1e3 END, 9) AS scale, round(CASE WHEN p90 < 1.5e0 THEN 3e0 ELSE p90 * 2e0 END, 9) AS halo_from,
  CASE WHEN asked <> 'auto' THEN asked WHEN uniformity < 9e-1 THEN 'field' ELSE 'flat' END AS model,
  CASE WHEN uniformity >= 9e-1 OR subject_high IS NULL THEN false WHEN subject_high THEN subject_delta <= p50 ELSE true END AS colour_fails FROM k"""

GAINS = """SELECT o_orderkey AS id, (100 + o_orderkey * 37 % 900) / 4e2 AS r, (100 + o_orderkey * 53 % 900) / 4e2 AS g, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (100 + o_orderkey * 71 % 900) / 4e2 END AS b, (50 + o_orderkey * 13 % 200) / 1e2 AS k FROM orders"""


def gain_limits(spark: SparkSession, d: str) -> DataFrame:
    t = from_sql(spark, d, "orders", GAINS).select("id", *[(F.col(x) * F.col("k")).alias(x) for x in "rgb"])
    return t.select("id", *[F.round(x, 9).alias(x) for x in "rgb"], limits.out_of_range("r", "g", "b").alias("refused"))


GAIN_LIMITS_SQL = f"""WITH t AS ({GAINS}) SELECT id, round(r * k, 9) AS r, round(g * k, 9) AS g, round(b * k, 9) AS b,
  coalesce(NOT (r * k BETWEEN 25e-2 AND 4e0 AND g * k BETWEEN 25e-2 AND 4e0 AND b * k BETWEEN 25e-2 AND 4e0), true) AS refused FROM t"""

COLOURS = """SELECT o_orderkey AS id, o_orderkey * 37 % 100000 / 1e3 AS l, o_orderkey * 13 % 12000 / 1e3 - 6e0 AS a, o_orderkey * 29 % 12000 / 1e3 - 6e0 AS b, 60e0 + o_orderkey * 7 % 40 AS gl, o_orderkey * 3 % 60 / 1e1 - 3e0 AS ga, o_orderkey * 11 % 60 / 1e1 - 3e0 AS gb, o_orderkey % 6 * 8e0 AS tolerance FROM orders"""


def shadow_colours(spark: SparkSession, d: str) -> DataFrame:
    names = ["l", "a", "b", "gl", "ga", "gb"]
    t = from_sql(spark, d, "orders", COLOURS).select("id", "tolerance", *[limits.quantised(x).alias(x) for x in names])
    return t.select("id", *names, F.round(limits.quantised_delta(names[:3], names[3:]), 6).alias("delta"), limits.is_shadow(names[:3], names[3:], "tolerance").alias("shadow"))


SHADOW_COLOURS_SQL = f"""WITH t AS ({COLOURS}), q AS (SELECT id, tolerance, {', '.join(f'CAST(trunc(CAST({x} AS FLOAT) * 256) AS INT) AS {x}' for x in ('l', 'a', 'b', 'gl', 'ga', 'gb'))} FROM t)
SELECT id, l, a, b, gl, ga, gb, round(sqrt((l - gl) * (l - gl) + (a - ga) * (a - ga) + (b - gb) * (b - gb)) / 256e0, 6) AS delta,
  tolerance > 0 AND gl > l AND gl - l <= tolerance * 256 AND (a - ga) * (a - ga) + (b - gb) * (b - gb) <= 1024 * 1024 AS shadow FROM q"""

LAYERS = """SELECT l_orderkey AS id, l_linenumber AS layer, l_partkey % 900 * 1e0 AS x, l_suppkey % 500 * 1e0 AS y, 100e0 + l_partkey % 300 AS w, 40e0 + l_suppkey % 100 AS h,
  l_partkey % 900 + (l_partkey % 7 - 3) / 128e0 AS px, l_suppkey % 500 - l_suppkey % 3 * 1e0 AS py, 100e0 + l_partkey % 290 AS pw, 40e0 + l_suppkey % 90 AS ph,
  CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_partkey % 80 / 1e1 END AS contrast, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 50 / 1e3 END AS overlap,
  CASE WHEN l_orderkey % 3 = 0 THEN 1280 ELSE 600 + l_orderkey * 37 % 1500 END AS cw, CASE WHEN l_orderkey % 3 = 0 THEN 670 ELSE 400 + l_orderkey * 53 % 900 END AS ch FROM lineitem"""


def compose_layers(spark: SparkSession, d: str) -> DataFrame:
    """Overflow, safe area, aspect and warnings of each layer; meets: whether it shares area with a subject in the middle."""
    rect, placed, area = ["x", "y", "w", "h"], ["px", "py", "pw", "ph"], ["sx", "sy", "sw", "sh"]
    t = from_sql(spark, d, "lineitem", LAYERS)
    t = t.withColumns(dict(zip(area, layers.safe_area("cw", "ch"))) | {"over": layers.overflow(rect, placed), "off_aspect": layers.aspect_mismatch("cw", "ch")})
    t = t.withColumns({"beyond": layers.outside(area, placed), "meets": layers.meets(placed, [F.lit(400.0), F.lit(200.0), F.lit(300.0), F.lit(250.0)])})
    codes = F.array_join(layers.layer_warnings("over", "contrast", "overlap", "beyond"), ",")
    return t.select("id", "layer", F.round("over", 6).alias("overflow"), "off_aspect", *[F.round(a, 9).alias(a) for a in area], "beyond", "meets", codes.alias("codes"))


COMPOSE_LAYERS_SQL = f"""WITH t AS ({LAYERS}),
s AS (SELECT *, abs((cw / (ch * 1e0)) / (1280e0 / 67e1) - 1e0) >= 5e-3 AS off_aspect, CASE WHEN cw / 1280e0 < ch / 67e1 THEN cw / 1280e0 ELSE ch / 67e1 END AS z FROM t),
a AS (SELECT *, CASE WHEN off_aspect THEN (cw - 1280e0 * z) / 2e0 ELSE 0e0 END AS sx, CASE WHEN off_aspect THEN (ch - 67e1 * z) / 2e0 + z * 108e0 ELSE ch / 67e1 * 108e0 END AS sy,
  CASE WHEN off_aspect THEN z * 1280e0 ELSE cw / 1280e0 * 1280e0 END AS sw, CASE WHEN off_aspect THEN z * 454e0 ELSE ch / 67e1 * 454e0 END AS sh FROM s),
m AS (SELECT *, greatest(px + pw - (x + w), py + ph - (y + h), x - px, y - py) AS worst, greatest(px + pw - (sx + sw), py + ph - (sy + sh), sx - px, sy - py) > 1e0 / 64e0 AS beyond FROM a),
o AS (SELECT *, CASE WHEN worst > 1e0 / 64e0 THEN worst ELSE 0e0 END AS over FROM m)
SELECT id, layer, round(over, 6) AS overflow, off_aspect, round(sx, 9) AS sx, round(sy, 9) AS sy, round(sw, 9) AS sw, round(sh, 9) AS sh, beyond, px < 700 AND px + pw > 400 AND py < 450 AND py + ph > 200 AS meets,
  concat_ws(',', CASE WHEN over > 0 THEN 'TEXT_OVERFLOW' END, CASE WHEN contrast < 45e-1 THEN 'TEXT_CONTRAST_LOW' END, CASE WHEN overlap > 2e-2 THEN 'LAYERS_OVERLAP' END, CASE WHEN beyond THEN 'OUTSIDE_SAFE_AREA' END) AS codes FROM o"""

CANVASES = "SELECT p_partkey AS id, 16 + p_partkey * 37 % 3000 AS w, 16 + p_partkey * 53 % 3000 AS h, p_partkey % 101 / 1e2 AS coverage FROM part"


def display_plan(spark: SparkSession, d: str) -> DataFrame:
    """Each canvas at the display widths narrower than it: height, font size and stroke that stay legible, class of a glyph pixel's coverage."""
    t = from_sql(spark, d, "part", CANVASES).withColumn("width", F.explode(F.array(*[F.lit(v) for v in layers.C.COMPOSE_PROFILE["displays"].values()]))).filter("width < w")
    return t.select("id", "width", layers.display_height("w", "h", "width").alias("height"), layers.required_size("w", "width").alias("size"), layers.required_stroke("w", "width").alias("stroke"), layers.coverage_class("coverage").alias("class"))


DISPLAY_PLAN_SQL = f"""WITH t AS ({CANVASES}) SELECT id, v.width AS width, CAST(greatest(round(h * 1e0 * v.width / w), 1) AS INT) AS height, CAST(ceil(11e0 * w / v.width) AS BIGINT) AS size, CAST(ceil(w * 1e0 / v.width) AS BIGINT) AS stroke,
  CASE WHEN coverage < 5e-2 THEN 'background' WHEN coverage < 5e-1 THEN 'partial' ELSE 'foreground' END AS class FROM t, (VALUES (192), (144)) v(width) WHERE v.width < w"""

BRANDS = ["isom", "mif1", "heic", "avif", "avis", "msf1", "mp42"]


def file_brands(spark: SparkSession, d: str) -> DataFrame:
    """The family of headers made from order keys: major brand, minor version, up to four compatible brands, up to three bytes more; some are cut short or no ftyp box."""
    names = F.array(*[F.lit(b) for b in BRANDS])
    brand = lambda at: F.get(names, F.expr(at).cast("int"))
    more = [F.when(F.expr(f"o_orderkey % 5 > {k}"), brand(f"(o_orderkey * {k + 2} + {k}) % 7")).otherwise("") for k in range(4)]
    text = F.concat(F.when(F.expr("o_orderkey % 11 = 0"), "free").otherwise("ftyp"), brand("o_orderkey % 7"), brand("o_orderkey * 5 % 7"), *more, F.expr("repeat('a', CAST(o_orderkey % 4 AS INT))"))
    content = F.unhex(F.concat(F.lit("000000"), F.lpad(F.hex(F.expr("o_orderkey * 7 % 64")), 2, "0"), F.hex(text)))
    content = F.when(F.expr("o_orderkey % 13 = 0"), F.substring(content, 1, 12)).otherwise(content)
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), content.alias("content"))
    return t.select("id", F.length("content").alias("bytes"), formats.file_family("content").alias("family"))


FILE_BRANDS_SQL = f"""WITH t AS (SELECT o_orderkey AS k, {BRANDS!r} AS b, CASE WHEN o_orderkey % 13 = 0 THEN 12 ELSE 16 + 4 * (o_orderkey % 5) + o_orderkey % 4 END AS n FROM orders),
e AS (SELECT *, CASE WHEN k * 7 % 64 < 16 THEN 16 WHEN k * 7 % 64 < n THEN k * 7 % 64 ELSE n END AS stop FROM t),
c AS (SELECT *, list_filter([b[k % 7 + 1], CASE WHEN k % 5 > 0 AND stop >= 20 THEN b[k * 2 % 7 + 1] END, CASE WHEN k % 5 > 1 AND stop >= 24 THEN b[(k * 3 + 1) % 7 + 1] END, CASE WHEN k % 5 > 2 AND stop >= 28 THEN b[(k * 4 + 2) % 7 + 1] END, CASE WHEN k % 5 > 3 AND stop >= 32 THEN b[(k * 5 + 3) % 7 + 1] END], lambda x: x IS NOT NULL) AS seen FROM e)
SELECT k AS id, CAST(n AS INT) AS bytes, CASE WHEN n < 16 OR k % 11 = 0 THEN NULL WHEN list_has_any(seen, ['avif', 'avis']) THEN 'avif' WHEN list_has_any(seen, ['mif1', 'heic', 'msf1']) THEN 'heif' END AS family FROM c"""

NAMINGS = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'colr' ELSE 'sequence_header' END AS source, CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 9 ELSE 1 END AS primaries,
  CASE o_orderkey % 9 WHEN 0 THEN 2 WHEN 1 THEN 16 ELSE 13 END AS transfer, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 6 END AS matrix, o_orderkey % 3 > 0 AS full_range FROM orders"""


def cicp_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return from_sql(spark, d, "orders", NAMINGS).select("id", formats.cicp_verdict("source", "primaries", "transfer", "matrix", "full_range").alias("verdict"))


CICP_SQL = f"""SELECT id, CASE WHEN source IS NULL THEN 'unmeasurable' WHEN [primaries, transfer, matrix] = [1, 13, 6] AND full_range THEN 'pass' WHEN list_contains([primaries, transfer, matrix], 2) THEN 'unmeasurable' ELSE 'fail' END AS verdict FROM ({NAMINGS})"""


def _score(p: str, a: int, b: int) -> str:
    """Columns of a cut's measures and warning counts by formula."""
    return f"""CASE WHEN p_partkey % {a} = 0 THEN NULL ELSE p_partkey * {b} % 50 / 1e3 END AS {p}_rim, CASE WHEN p_partkey % {a + 2} = 0 THEN NULL ELSE p_partkey * {b + 2} % 40 / 1e2 END AS {p}_rough,
  CASE WHEN p_partkey % {a + 6} = 0 THEN NULL ELSE p_partkey * {b + 4} % 30 / 1e2 END AS {p}_halo, p_partkey * {b} % 400 / 1e1 AS {p}_sep"""


TRIALS = f"""SELECT p_partkey AS id, {_score('f', 5, 3)}, {_score('w', 7, 11)}, p_partkey % 3 AS f_fatal, CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END AS lasting, CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS box_hint,
  CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS poor, p_partkey % 10 = 0 AS collapsed FROM part"""


def search_adoption(spark: SparkSession, d: str) -> DataFrame:
    """Whether a search's winner replaces the first cut, and whether its score alone is better."""
    t = from_sql(spark, d, "part", TRIALS).withColumn("w_fatal", F.col("lasting") + F.col("box_hint"))
    score = lambda p: F.struct(F.col(f"{p}_fatal").alias("fatal"), adoption.unmeasured(f"{p}_rim", f"{p}_rough", f"{p}_halo").alias("unmeasured"), adoption.quality(f"{p}_rim", f"{p}_rough", f"{p}_halo").alias("quality"), F.col(f"{p}_sep").alias("separability"))
    t = t.select("id", "lasting", "poor", "collapsed", score("f").alias("f"), score("w").alias("w"))
    return t.select("id", F.round("w.quality", 9).alias("quality"), F.col("w.unmeasured").alias("unmeasured"), adoption.improves("w", "f").alias("improves"), adoption.adopted("f", "w", "lasting", "poor", "collapsed").alias("adopted"))


ADOPTION_SQL = f"""WITH t AS (SELECT *, lasting + box_hint AS w_fatal FROM ({TRIALS})),
s AS (SELECT *, {', '.join(f"coalesce({p}_rim / 2e-2, 1e0) + coalesce({p}_rough / 16e-2, 1e0) + coalesce({p}_halo / 1e-1, 1e0) AS {p}_q, 3 - ({p}_rim IS NOT NULL)::INT - ({p}_rough IS NOT NULL)::INT - ({p}_halo IS NOT NULL)::INT AS {p}_u" for p in 'fw')} FROM t),
i AS (SELECT *, CASE WHEN w_fatal <> f_fatal THEN w_fatal < f_fatal WHEN w_u <> f_u THEN w_u < f_u WHEN w_q <> f_q THEN w_q < f_q ELSE w_sep > f_sep END AS improves FROM s)
SELECT id, round(w_q, 9) AS quality, w_u AS unmeasured, improves, CASE WHEN lasting > 0 OR collapsed THEN false WHEN w_fatal = 0 AND poor = 0 THEN true WHEN w_fatal > 0 THEN w_fatal < f_fatal ELSE improves END AS adopted FROM i"""

BATCHES = "SELECT c_custkey AS batch, c_custkey % 3 > 0 AS has_set, CASE WHEN c_custkey % 7 = 0 THEN 9e-1 END AS default_fill FROM customer"
SPECS = "SELECT o_custkey AS batch, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 8e-1 END AS fill_ratio FROM orders"


def set_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return adoption.set_conflicts(from_sql(spark, d, "customer", BATCHES), from_sql(spark, d, "orders", SPECS))


SET_CONFLICTS_SQL = f"""WITH b AS ({BATCHES}), i AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY id) - 1 AS nth FROM ({SPECS})), f AS (SELECT batch, min(nth) AS nth FROM i WHERE fill_ratio IS NOT NULL GROUP BY batch)
SELECT b.batch AS batch, CASE WHEN default_fill IS NOT NULL THEN 'defaults' ELSE 'items[' || f.nth || ']' END AS location FROM b LEFT JOIN f ON f.batch = b.batch WHERE has_set AND (default_fill IS NOT NULL OR f.nth IS NOT NULL)"""

OUTPUTS = "SELECT o_orderkey AS id, concat('out/', CAST(o_orderkey % 7 AS STRING), '.png') AS path, concat('out/', CAST(o_orderkey % 5 AS STRING), '.png') AS preview, concat('out/', CAST(o_orderkey % 3 AS STRING), '.png') AS mask FROM orders"


def reserved_paths(spark: SparkSession, d: str) -> DataFrame:
    """Outputs whose path a side output would overwrite, with the first option that does."""
    t = from_sql(spark, d, "orders", OUTPUTS).withColumn("flag", adoption.reserved_flag("path", [("--preview", F.col("preview")), ("--save-mask", F.col("mask"))]))
    return t.filter("flag IS NOT NULL").select("id", "path", "flag")


RESERVED_SQL = f"SELECT id, path, CASE WHEN path = preview THEN '--preview' ELSE '--save-mask' END AS flag FROM ({OUTPUTS}) WHERE path IN (preview, mask)"

QUERIES = {
    "cut_limits": (cut_limits, CUT_LIMITS_SQL),
    "gain_limits": (gain_limits, GAIN_LIMITS_SQL),
    "shadow_colours": (shadow_colours, SHADOW_COLOURS_SQL),
    "compose_layers": (compose_layers, COMPOSE_LAYERS_SQL),
    "display_plan": (display_plan, DISPLAY_PLAN_SQL),
    "file_brands": (file_brands, FILE_BRANDS_SQL),
    "cicp_verdicts": (cicp_verdicts, CICP_SQL),
    "search_adoption": (search_adoption, ADOPTION_SQL),
    "set_conflicts": (set_conflicts, SET_CONFLICTS_SQL),
    "reserved_paths": (reserved_paths, RESERVED_SQL),
}

"""Queries of rules, gates, search and ladders over measures of the scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import geometry
from ..functions.color import delta_e, with_lab
from ..operators import pixels as P
from ..operators import rules as R
from ..sources.scenes import SIDE, scene_px, table
from .pixels import BORDER_SQL, SCENE_SQL, STATS_SQL, delta_sql

# Measures of the parts by integer formulas, so that every verdict occurs: null means not measured.
MEASURES_EXPR = {
    "foreground_ratio": "(p_partkey * 37 % 1001) / 1000.0D",
    "separability": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey * 13 % 400) / 10.0D END",
    "halo_ratio": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey * 7 % 300) / 1000.0D END",
    "edge_width": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 90) / 10.0D END",
    "contour_roughness": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_partkey * 5 % 400) / 1000.0D END",
    "rim_contamination": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey * 3 % 50) / 1000.0D END",
    "touches_edge": "CASE WHEN p_partkey % 19 = 0 THEN 1.0D ELSE 0.0D END",
}
NAMES = list(MEASURES_EXPR)
# What warnings read besides the metrics.
CONTEXT_EXPR = {
    "uniformity": "0.80D + (p_partkey * 11 % 200) / 1000.0D",
    "residual_p50": "(p_partkey * 17 % 200) / 10.0D",
    "bbox_given": "CASE WHEN p_partkey % 2 = 0 THEN 1.0D ELSE 0.0D END",
    "subject_high": "CASE WHEN p_partkey % 3 = 0 THEN 0.0D ELSE 1.0D END",
}
M_SQL = "m AS (SELECT p_partkey AS id, " + ", ".join(f"{e.replace('0D', '0::DOUBLE')} AS {n}" for n, e in (MEASURES_EXPR | CONTEXT_EXPR).items()) + " FROM part)"


def measures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[F.expr(e).alias(n) for n, e in (MEASURES_EXPR | CONTEXT_EXPR).items()])


CODES_SQL = """list_filter([CASE WHEN uniformity < 0.90::DOUBLE THEN 'LOW_UNIFORMITY' END, CASE WHEN foreground_ratio < 0.01 THEN 'FOREGROUND_TOO_SMALL' END, CASE WHEN foreground_ratio > 0.99 THEN 'FOREGROUND_TOO_LARGE' END,
  CASE WHEN touches_edge = 1 THEN CASE WHEN uniformity < 0.90::DOUBLE AND bbox_given = 0 AND subject_high = 1 THEN 'BBOX_RECOMMENDED' ELSE 'SUBJECT_TOUCHES_EDGE' END END, CASE WHEN halo_ratio > 0.10 THEN 'HALO_REMAINS' END, CASE WHEN contour_roughness > 0.16 THEN 'CONTOUR_ROUGH' END, CASE WHEN rim_contamination > 0.02 THEN 'RIM_CONTAMINATED' END,
  CASE WHEN foreground_ratio > 0.01 AND foreground_ratio < 0.99 AND separability < residual_p50 THEN 'NOT_SEPARABLE' END], lambda x: x IS NOT NULL)"""


def warnings(spark: SparkSession, d: str) -> DataFrame:
    w = R.warnings(measures(spark, d))
    return w.select("id", F.posexplode("warnings").alias("place", "w")).select("id", "place", F.col("w.code").alias("code"), F.col("w.actual").alias("actual"))


WARNINGS_SQL = f"""WITH {M_SQL}, c AS (SELECT *, {CODES_SQL} AS codes FROM m), u AS (SELECT *, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS place FROM c)
SELECT id, place::INT AS place, code, CASE code WHEN 'LOW_UNIFORMITY' THEN uniformity WHEN 'BBOX_RECOMMENDED' THEN foreground_ratio WHEN 'FOREGROUND_TOO_SMALL' THEN foreground_ratio WHEN 'FOREGROUND_TOO_LARGE' THEN foreground_ratio WHEN 'NOT_SEPARABLE' THEN separability WHEN 'SUBJECT_TOUCHES_EDGE' THEN touches_edge
  WHEN 'HALO_REMAINS' THEN halo_ratio WHEN 'CONTOUR_ROUGH' THEN contour_roughness ELSE rim_contamination END AS actual FROM u"""

GATE = "halo_ratio>0.08, separability<=20,touches_edge,edge_width>=4,foreground_ratio<0.2"


def gate_explicit(spark: SparkSession, d: str) -> DataFrame:
    rules = R.parse_fail_on(spark.createDataFrame([(GATE,)], "spec string"))
    return R.gate(R.warnings(measures(spark, d)), rules)



_LONG_SQL = "l AS (" + " UNION ALL ".join(f"SELECT id, '{n}' AS metric, {n} AS actual FROM m" for n in NAMES) + ")"
GATE_SQL = f"""WITH {M_SQL}, {_LONG_SQL},
r AS (SELECT * FROM (VALUES ('halo_ratio', '>', 0.08::DOUBLE), ('separability', '<=', 20.0), ('touches_edge', NULL, NULL), ('edge_width', '>=', 4.0), ('foreground_ratio', '<', 0.2)) AS t(metric, operator, threshold))
SELECT id, metric, operator, threshold, actual, CASE WHEN actual IS NULL THEN 'unmeasurable' WHEN (operator IS NULL AND actual = 1) OR (operator = '>' AND actual > threshold) OR (operator = '<' AND actual < threshold)
  OR (operator = '>=' AND actual >= threshold) OR (operator = '<=' AND actual <= threshold) THEN 'fail' ELSE 'pass' END AS status FROM l JOIN r USING (metric)"""


def gate_default(spark: SparkSession, d: str) -> DataFrame:
    return R.default_gate(R.warnings(measures(spark, d)), C.metrics(spark))


_CODE_SQL = "k AS (SELECT * FROM (VALUES " + ", ".join(f"('{m[0]}', {m[1]}, '{c}')" for m in C.METRICS for c in m[5]) + ") AS t(metric, place, code))"
DEFAULT_SQL = f"""WITH {M_SQL}, c AS (SELECT id, {CODES_SQL} AS codes FROM m), {_LONG_SQL}, {_CODE_SQL}
SELECT l.id, l.metric, k.code, CASE WHEN actual IS NULL AND l.metric <> 'touches_edge' THEN 'unmeasurable' WHEN list_contains(codes, code) THEN 'fail' ELSE 'pass' END AS status FROM l JOIN k USING (metric) JOIN c ON c.id = l.id"""


def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    return gate_explicit(spark, d).groupBy("id").agg(F.bool_and(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "unmeasurable").alias("unmeasurable"))


VERDICT_SQL = f"WITH g AS ({GATE_SQL}) SELECT id, bool_and(status = 'pass') AS passed, count(*) FILTER (status = 'unmeasurable') AS unmeasurable FROM g GROUP BY id"


def gate_combined(spark: SparkSession, d: str) -> DataFrame:
    """The default rule with an explicit one in place of its check of the halo."""
    rules = R.parse_fail_on(spark.createDataFrame([("default, halo_ratio>0.05",)], "spec string"))
    return R.evaluate(R.warnings(measures(spark, d)), rules, C.metrics(spark))


COMBINED_SQL = f"""WITH g AS ({DEFAULT_SQL}), {M_SQL} SELECT id, metric, code, status FROM g WHERE metric <> 'halo_ratio'
UNION ALL SELECT id, 'halo_ratio', NULL, CASE WHEN halo_ratio IS NULL THEN 'unmeasurable' WHEN halo_ratio > 0.05 THEN 'fail' ELSE 'pass' END FROM m"""


def fail_on_parse(spark: SparkSession, d: str) -> DataFrame:
    """Gate specifications made of table values, with the reason of refusal."""
    spec = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("concat(element_at(array('halo_ratio', 'separability', 'touches_edge', 'colour', 'foreground_ratio'), 1 + CAST(p_partkey % 5 AS INT)), element_at(array('>', '<=', '', '<', '>='), 1 + CAST(p_partkey % 4 AS INT)), CASE WHEN p_partkey % 6 = 0 THEN '' ELSE CAST(p_size / 25.0D AS STRING) END)").alias("spec"))
    return R.parse_fail_on(spec, "id").select("id", "metric", "operator", "threshold", "error")


FAIL_ON_SQL = """WITH s AS (SELECT p_partkey AS id, (p_partkey % 5)::INT AS m, (p_partkey % 4)::INT AS o, p_partkey % 6 = 0 AS none, p_size / 25.0::DOUBLE AS v FROM part),
n AS (SELECT id, ['halo_ratio', 'separability', 'touches_edge', 'colour', 'foreground_ratio'][m + 1] AS name, nullif(['>', '<=', '', '<'][o + 1], '') AS op, CASE WHEN NOT none THEN v END AS v, none FROM s),
k AS (SELECT id, CASE WHEN op IS NULL AND NOT none THEN name || v::VARCHAR ELSE name END AS token, name, op, v, none FROM n),
e AS (SELECT *, CASE WHEN op IS NULL AND none AND name = 'touches_edge' THEN NULL WHEN op IS NULL AND none AND name <> 'colour' THEN 'needs_threshold' WHEN op IS NULL OR name = 'colour' THEN 'unknown_metric' WHEN name = 'touches_edge' THEN 'flag_takes_no_threshold'
  WHEN none THEN 'not_a_number' WHEN name <> 'separability' AND v > 1 THEN 'out_of_range' WHEN op = '>' AND name <> 'separability' AND v >= 1 THEN 'never_fires' WHEN op = '<' AND v <= 0 THEN 'never_fires' END AS error FROM k)
SELECT id, CASE WHEN error IS NULL THEN name END AS metric, CASE WHEN error IS NULL THEN op END AS operator, CASE WHEN error IS NULL AND op IS NOT NULL THEN v END AS threshold, error FROM e"""


def compose_gate(spark: SparkSession, d: str) -> DataFrame:
    """Worst measures over the layers of an order against calibrated thresholds; metrics that don't apply are skipped, which passes."""
    li = table(spark, d, "lineitem")
    layers = li.select(
        F.col("l_orderkey").alias("id"),
        F.expr("CASE WHEN l_quantity > 25 THEN l_discount * 10 ELSE 0.0D END").alias("text_overflow"),
        F.expr("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 3 + l_tax * 50 END").alias("text_contrast"),
        F.expr("l_discount").alias("text_obscured"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax / 3 END").alias("layer_overlap"),
    )
    return R.compose_gate(layers, ["text_overflow", "text_contrast", "text_obscured", "layer_overlap"], {"text_contrast"})


COMPOSE_SQL = """WITH y AS (SELECT l_orderkey AS id, CASE WHEN l_quantity > 25 THEN l_discount * 10 ELSE 0.0 END::DOUBLE AS text_overflow, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 3 + l_tax * 50 END::DOUBLE AS text_contrast,
  l_discount AS text_obscured, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax / 3 END::DOUBLE AS layer_overlap FROM lineitem),
g AS (SELECT id, max(text_overflow) AS text_overflow, min(text_contrast) AS text_contrast, max(text_obscured) AS text_obscured, max(layer_overlap) AS layer_overlap FROM y GROUP BY id),
l AS (SELECT id, 'text_overflow' AS metric, text_overflow AS worst, '>' AS op, 0.0::DOUBLE AS t FROM g UNION ALL SELECT id, 'text_contrast', text_contrast, '<', 4.5 FROM g UNION ALL SELECT id, 'text_obscured', text_obscured, '>', 0.10 FROM g UNION ALL SELECT id, 'layer_overlap', layer_overlap, '>', 0.02 FROM g)
SELECT id, metric, round(worst, 6) AS worst, CASE WHEN worst IS NULL THEN 'skipped' WHEN (op = '>' AND worst > t) OR (op = '<' AND worst < t) THEN 'fail' ELSE 'pass' END AS status FROM l"""

FACTS = "CAST(300 + p_partkey * 91 % 11000 AS INT)"


def facts(spark: SparkSession, d: str) -> DataFrame:
    """What a profile check must know of each part's picture, by formulas; null is not measured."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.expr(FACTS).alias("width"),
        F.expr(f"CASE WHEN p_partkey % 3 = 0 THEN {FACTS} ELSE CAST(400 + p_partkey * 53 % 7000 AS INT) END").alias("height"),
        F.expr("element_at(array('jpeg', 'png', 'webp', 'avif'), 1 + CAST(p_partkey % 4 AS INT))").alias("format"),
        F.expr("p_partkey * 104729 % 30000000").alias("file_size"),
        F.expr("CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_partkey % 5 = 0 END").alias("has_alpha"),
        F.expr("CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 9 <> 0 END").alias("srgb"),
        F.expr("CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE (p_partkey * 3 % 60) / 10.0D END").alias("background_delta"),
        F.expr("CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE (p_partkey * 7 % 101) / 100.0D END").alias("fill_ratio"),
    )


def lint(spark: SparkSession, d: str) -> DataFrame:
    return R.lint(facts(spark, d), C.profiles(spark))


FACTS_SQL = """f AS (SELECT p_partkey AS id, (300 + p_partkey * 91 % 11000)::INT AS width, CASE WHEN p_partkey % 3 = 0 THEN (300 + p_partkey * 91 % 11000)::INT ELSE (400 + p_partkey * 53 % 7000)::INT END AS height,
  ['jpeg', 'png', 'webp', 'avif'][1 + (p_partkey % 4)::INT] AS format, p_partkey * 104729 % 30000000 AS file_size, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_partkey % 5 = 0 END AS has_alpha, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 9 <> 0 END AS srgb,
  CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE (p_partkey * 3 % 60) / 10.0::DOUBLE END AS background_delta, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE (p_partkey * 7 % 101) / 100.0::DOUBLE END AS fill_ratio FROM part),
p AS (SELECT * FROM (VALUES ('amazon', 500, 10000, NULL::BIGINT, false, true, 0.85::DOUBLE, NULL::BIGINT, ['jpeg', 'png'], false, true), ('shopify', NULL, 5000, 25000000, false, false, NULL, 19999999, ['png', 'jpeg', 'webp'], true, false), ('square-white', 1000, NULL, NULL, true, true, 0.85, NULL, ['jpeg', 'png'], false, true))
  AS t(profile, lmin, lmax, max_pixels, square, bg, fill_min, max_bytes, formats, alpha_ok, srgb_req)),
j AS (SELECT * FROM f, p),
c AS (
  SELECT id, profile, 'format' AS item, list_contains(formats, format) AS ok, true AS regulated, false AS pixel FROM j
  UNION ALL SELECT id, profile, 'longest_side', greatest(width, height) >= coalesce(lmin, 0) AND greatest(width, height) <= coalesce(lmax, 2147483647), lmin IS NOT NULL OR lmax IS NOT NULL, false FROM j
  UNION ALL SELECT id, profile, 'max_pixels', width::BIGINT * height <= max_pixels, max_pixels IS NOT NULL, false FROM j
  UNION ALL SELECT id, profile, 'square', width = height, square, false FROM j
  UNION ALL SELECT id, profile, 'file_size', file_size <= max_bytes, max_bytes IS NOT NULL, false FROM j
  UNION ALL SELECT id, profile, 'alpha', NOT has_alpha, NOT alpha_ok, true FROM j
  UNION ALL SELECT id, profile, 'color_space', srgb, srgb_req, false FROM j
  UNION ALL SELECT id, profile, 'background', background_delta <= 2.0, bg, true FROM j
  UNION ALL SELECT id, profile, 'fill_ratio', fill_ratio >= fill_min, fill_min IS NOT NULL, true FROM j)"""
LINT_SQL = f"WITH {FACTS_SQL} SELECT id, profile, item, CASE WHEN ok THEN 'pass' WHEN ok IS NULL THEN CASE WHEN pixel THEN 'skipped' ELSE 'unmeasurable' END ELSE 'fail' END AS status FROM c WHERE regulated"


def lint_verdict(spark: SparkSession, d: str) -> DataFrame:
    return lint(spark, d).groupBy("id", "profile").agg(F.bool_and(F.col("status") == "pass").alias("passed"), F.count("*").alias("checks"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "skipped", F.col("item")))), ",").alias("uncheckable"))


LINT_VERDICT_SQL = f"WITH g AS ({LINT_SQL}) SELECT id, profile, bool_and(status = 'pass') AS passed, count(*) AS checks, coalesce(string_agg(CASE WHEN status = 'skipped' THEN item END, ',' ORDER BY item), '') AS uncheckable FROM g GROUP BY id, profile"


def scene_lint(spark: SparkSession, d: str) -> DataFrame:
    """Border colour, its difference to white, fill and alpha of each scene against the profile that asks for white and 85 %."""
    px = scene_px(spark, d)
    bg = P.background(P.border(px, SIDE))
    stats = P.mask_stats(P.mask_of(px, bg), SIDE)
    alpha = px.groupBy("image_id").agg((F.min("a") < 255).alias("has_alpha"))
    white = with_lab(bg.withColumn("white", F.lit(255)), ("bg_r", "bg_g", "bg_b"), "p")
    bg = with_lab(white, ("white", "white", "white"), "q").withColumn("background_delta", F.round(delta_e("p", "q"), 4)).select(*bg.columns, "background_delta")
    j = bg.join(stats, "image_id").join(alpha, "image_id")
    fill = F.round(F.greatest((F.col("x2") - F.col("x1") + 1) / 24.0, (F.col("y2") - F.col("y1") + 1) / 24.0), 4)
    return j.select("image_id", "bg_r", "uniformity", "background_delta", fill.alias("fill_ratio"), "has_alpha", (~F.col("has_alpha") & (F.col("background_delta") <= C.BACKGROUND_TOLERANCE) & (fill >= 0.85)).alias("passed"))


_WHITE_DELTA = f"round({delta_sql(('bg_r', 'bg_g', 'bg_b'), ('255', '255', '255'))}, 4)"
SCENE_LINT_SQL = f"""WITH b AS ({BORDER_SQL}), s AS ({STATS_SQL}), {SCENE_SQL}, a AS (SELECT image_id, min(a) < 255 AS has_alpha FROM scene_px GROUP BY image_id)
SELECT image_id, bg_r, uniformity, {_WHITE_DELTA} AS background_delta, round(greatest((x2 - x1 + 1) / 24.0::DOUBLE, (y2 - y1 + 1) / 24.0::DOUBLE), 4) AS fill_ratio, has_alpha,
  NOT has_alpha AND {_WHITE_DELTA} <= 2.0 AND round(greatest((x2 - x1 + 1) / 24.0::DOUBLE, (y2 - y1 + 1) / 24.0::DOUBLE), 4) >= 0.85 AS passed FROM b JOIN s USING (image_id) JOIN a USING (image_id)"""


def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each part (tolerances x models), collapse of the foreground, and the order of the search."""
    t = R.candidates(table(spark, d, "part").select(F.col("p_partkey").alias("id")), models=["auto", "flat"], boxes=[False, True])
    t = t.withColumn("foreground_ratio", F.expr("((id * 31 + rank * 7 + tolerance * (id % 9)) % 1000) / 1000.0D")).withColumn("fatal", F.expr("CAST((id + tolerance) % 3 AS INT)")).withColumn("unmeasured", F.expr("CAST((id * tolerance) % 2 AS INT)"))
    t = t.withColumn("separability", F.expr("CASE WHEN (id + tolerance) % 7 = 0 THEN NULL ELSE CAST((id * tolerance) % 97 AS DOUBLE) END")).withColumn("quality", F.expr("((id + tolerance * 3) % 50) / 25.0D"))
    return R.rank_search(R.penalise_collapse(t)).select("id", "bbox", "model", "tolerance", "collapsed", "place", "final_place")


CANDIDATE_SQL = """WITH t AS (SELECT p_partkey AS id, b.bbox, m.model, m.rank, o.tolerance FROM part, (VALUES (false), (true)) AS b(bbox), (VALUES ('auto', 0), ('flat', 1)) AS m(model, rank), (VALUES (12), (20), (30), (45), (60)) AS o(tolerance)),
v AS (SELECT *, ((id * 31 + rank * 7 + tolerance * (id % 9)) % 1000) / 1000.0::DOUBLE AS ratio, (id + tolerance) % 3 AS fatal, (id * tolerance) % 2 AS unmeasured, CASE WHEN (id + tolerance) % 7 = 0 THEN NULL ELSE ((id * tolerance) % 97)::DOUBLE END AS separability, ((id + tolerance * 3) % 50) / 25.0::DOUBLE AS quality FROM t),
l AS (SELECT *, lag(ratio) OVER w AS before FROM v WINDOW w AS (PARTITION BY id, bbox, model ORDER BY tolerance)),
c AS (SELECT *, max(CASE WHEN before > 0 AND ratio < before * 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY id, bbox, model ORDER BY tolerance ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS collapsed FROM l)
SELECT id, bbox, model, tolerance, collapsed, row_number() OVER (PARTITION BY id ORDER BY fatal + CASE WHEN collapsed THEN 1 ELSE 0 END, coalesce(separability, -1e308) DESC, tolerance, bbox, rank)::INT AS place,
  row_number() OVER (PARTITION BY id ORDER BY fatal + CASE WHEN collapsed THEN 1 ELSE 0 END, unmeasured, quality, coalesce(separability, 0) DESC, tolerance, bbox, rank)::INT AS final_place FROM c"""


def canvas_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The largest rung that the subject fills, within the profile's limits."""
    s = facts(spark, d).select("id", F.greatest("width", "height").alias("subject"))
    return R.canvas_for(s, C.profiles(spark))


LADDER_SQL = """WITH s AS (SELECT p_partkey AS id, greatest((300 + p_partkey * 91 % 11000)::INT, CASE WHEN p_partkey % 3 = 0 THEN (300 + p_partkey * 91 % 11000)::INT ELSE (400 + p_partkey * 53 % 7000)::INT END) AS subject FROM part),
p AS (SELECT * FROM (VALUES ('amazon', 500, 10000, NULL::INT, 0.86::DOUBLE), ('shopify', NULL, 5000, 5000, 1.0), ('square-white', 1000, NULL, NULL, 0.86)) AS t(profile, lmin, lmax, cap, fill)),
r AS (SELECT id, profile, subject, lmin, lmax, cap, max(rung) FILTER (rung * fill <= subject) AS rung FROM s, p, (VALUES (1000), (1500), (2000), (2500), (3000)) AS l(rung) GROUP BY ALL)
SELECT id, profile, subject, least(greatest(coalesce(rung, 1000), coalesce(lmin, 0)), coalesce(lmax, 2147483647), coalesce(cap, 2147483647))::INT AS side FROM r"""


def quality_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The first rung, strictly below the quality asked for, whose encoding fits; else the first encoding and the smallest seen."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("CAST(20 + o_orderkey % 81 AS INT)").alias("quality"), F.expr("CAST(floor(o_totalprice) AS BIGINT)").alias("size"), F.expr("CAST(o_orderkey * 7919 % 60000 AS BIGINT)").alias("max_bytes"))
    return R.fit_quality(o, lambda q: F.expr("size") * (q + 10) / 110)


QUALITY_SQL = """WITH i AS (SELECT o_orderkey AS id, (20 + o_orderkey % 81)::INT AS quality, floor(o_totalprice)::BIGINT AS size, (o_orderkey * 7919 % 60000)::BIGINT AS max_bytes FROM orders),
t AS (SELECT id, quality, max_bytes, 0 AS rung, quality AS q, floor(size * (quality + 10) / 110.0::DOUBLE)::BIGINT AS bytes FROM i
  UNION ALL SELECT id, quality, max_bytes, k, v, floor(size * (v + 10) / 110.0::DOUBLE)::BIGINT FROM i, (VALUES (1, 85), (2, 75), (3, 65), (4, 55), (5, 45), (6, 35), (7, 25)) AS l(k, v) WHERE v < quality),
g AS (SELECT id, min(rung) FILTER (bytes <= max_bytes) AS hit, min(bytes) AS smallest, max(CASE WHEN rung = 0 THEN bytes END) AS first_bytes, max(quality) AS quality FROM t GROUP BY id)
SELECT g.id, coalesce(t.q, g.quality)::INT AS used_quality, coalesce(t.bytes, first_bytes) AS bytes, CASE WHEN hit IS NULL THEN 'MAX_BYTES_UNREACHABLE' WHEN hit > 0 THEN 'QUALITY_REDUCED' END AS warning, CASE WHEN hit IS NULL THEN smallest END AS smallest FROM g LEFT JOIN t ON t.id = g.id AND t.rung = hit"""


def geometry_plans(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select("id", "width", "height")
    w, h = F.col("width"), F.col("height")
    out = f.select(
        "id",
        *[geometry.resize_plan(w, h, F.lit(800), F.lit(600), k).alias(k) for k in ("contain", "cover", "exact")],
        geometry.rotate_plan(w, h, F.expr("CAST((id % 8) * 45 AS DOUBLE)")).alias("turn"),
        geometry.canvas_plan(w, h, F.lit(1000), F.lit(1000), F.lit(0.85)).alias("canvas"),
        *[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), geometry.bbox_to_pixels([F.expr(e) for e in ("id % 40 - 3.5D", "id % 30 + 0.25D", "id % 900 + 50.5D", "id % 700 + 60.75D")], w, h))],
        geometry.nearest(F.expr("id % 300"), w, F.lit(256)).alias("near"),
    )
    return out.select("id", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("contain", "cover", "exact") for c in ("w", "h", "x", "y", "upscaled")], F.col("turn.turns").alias("turns"), F.col("turn.w").alias("turn_w"), F.col("turn.h").alias("turn_h"), *[F.col(f"canvas.{c}").alias(f"canvas_{c}") for c in ("w", "h", "x", "y")], "x1", "y1", "x2", "y2", "near")


def _fit(k: str, agg: str) -> str:
    w, h = ("800", "600") if k == "exact" else tuple(f"greatest(round({v} * {agg}(800::DOUBLE / width, 600::DOUBLE / height)), 1)::INT" for v in ("width", "height"))
    x, y = (f"greatest(floor(({w} - 800) / 2.0::DOUBLE), 0)::INT", f"greatest(floor(({h} - 600) / 2.0::DOUBLE), 0)::INT") if k == "cover" else ("0", "0")
    return f"{w} AS {k}_w, {h} AS {k}_h, {x} AS {k}_x, {y} AS {k}_y, {w} > width OR {h} > height AS {k}_upscaled"


GEOMETRY_SQL = f"""WITH f AS (SELECT p_partkey AS id, (300 + p_partkey * 91 % 11000)::INT AS width, CASE WHEN p_partkey % 3 = 0 THEN (300 + p_partkey * 91 % 11000)::INT ELSE (400 + p_partkey * 53 % 7000)::INT END AS height FROM part),
a AS (SELECT *, ((id % 8) * 45)::DOUBLE AS ang, greatest(round(width * least(850.0::DOUBLE / width, 850.0::DOUBLE / height)), 1)::INT AS cw, greatest(round(height * least(850.0::DOUBLE / width, 850.0::DOUBLE / height)), 1)::INT AS ch FROM f),
b AS (SELECT *, CASE WHEN ang % 90 = 0 THEN (ang / 90)::INT END AS turns, ceil(round(abs(width * cos(radians(ang))) + abs(height * sin(radians(ang))), 9))::INT AS bw, ceil(round(abs(width * sin(radians(ang))) + abs(height * cos(radians(ang))), 9))::INT AS bh,
  greatest(floor(id % 40 - 3.5), 0)::INT AS x1, greatest(floor(id % 30 + 0.25), 0)::INT AS y1 FROM a)
SELECT id, {_fit("contain", "least")}, {_fit("cover", "greatest")}, {_fit("exact", "")}, turns, CASE WHEN turns IS NULL THEN bw WHEN turns % 2 = 1 THEN height ELSE width END AS turn_w, CASE WHEN turns IS NULL THEN bh WHEN turns % 2 = 1 THEN width ELSE height END AS turn_h,
  cw AS canvas_w, ch AS canvas_h, floor((1000 - cw) / 2.0::DOUBLE)::INT AS canvas_x, floor((1000 - ch) / 2.0::DOUBLE)::INT AS canvas_y, x1, y1, greatest(least(ceil(id % 900 + 50.5), width - 1), x1)::INT AS x2, greatest(least(ceil(id % 700 + 60.75), height - 1), y1)::INT AS y2,
  least(greatest(round((id % 300 + 0.5::DOUBLE) * 256 / width - 0.5::DOUBLE), 0), 255)::INT AS near FROM b"""

QUERIES = {
    "warnings": (warnings, WARNINGS_SQL),
    "gate_explicit": (gate_explicit, GATE_SQL),
    "gate_default": (gate_default, DEFAULT_SQL),
    "gate_verdict": (gate_verdict, VERDICT_SQL),
    "gate_combined": (gate_combined, COMBINED_SQL),
    "fail_on_parse": (fail_on_parse, FAIL_ON_SQL),
    "compose_gate": (compose_gate, COMPOSE_SQL),
    "lint": (lint, LINT_SQL),
    "lint_verdict": (lint_verdict, LINT_VERDICT_SQL),
    "scene_lint": (scene_lint, SCENE_LINT_SQL),
    "candidate_rank": (candidate_rank, CANDIDATE_SQL),
    "canvas_ladder": (canvas_ladder, LADDER_SQL),
    "quality_ladder": (quality_ladder, QUALITY_SQL),
    "geometry_plans": (geometry_plans, GEOMETRY_SQL),
}

"""Warnings, gates, profile checks, candidate ranking and ladders. Rule tables have a few rows each and are broadcast; measures are never shuffled for a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C

MEASURES = [m[0] for m in C.METRICS]


def warnings(measures: DataFrame) -> DataFrame:
    """Adds warnings, an array of code and the measure that fired it, in the order of rules.

    Contact with the edge is read as a failed background, not a cropped subject, where the background isn't uniform, no box was given and a subject was found with confidence.
    No parameter separates a subject whose difference is below the background's own median difference; that is judged only where something was cut and something left.
    """
    uneven = F.col("uniformity") < C.MIN_UNIFORMITY
    touches = F.col("touches_edge") == 1
    misread = touches & uneven & (F.col("bbox_given") == 0) & (F.col("subject_high") == 1)
    cut = (F.col("foreground_ratio") > C.FOREGROUND_MIN) & (F.col("foreground_ratio") < C.FOREGROUND_MAX)

    def warn(code: str, measure: str, fires: Column) -> Column:
        return F.when(fires, F.struct(F.lit(code).alias("code"), F.col(measure).alias("actual")))

    rules = [
        warn("LOW_UNIFORMITY", "uniformity", uneven),
        warn("FOREGROUND_TOO_SMALL", "foreground_ratio", F.col("foreground_ratio") < C.FOREGROUND_MIN),
        warn("FOREGROUND_TOO_LARGE", "foreground_ratio", F.col("foreground_ratio") > C.FOREGROUND_MAX),
        warn("BBOX_RECOMMENDED", "foreground_ratio", misread),
        warn("SUBJECT_TOUCHES_EDGE", "touches_edge", touches & ~misread),
        warn("HALO_REMAINS", "halo_ratio", F.col("halo_ratio") > C.HALO_WARN),
        warn("CONTOUR_ROUGH", "contour_roughness", F.col("contour_roughness") > C.ROUGH_WARN),
        warn("RIM_CONTAMINATED", "rim_contamination", F.col("rim_contamination") > C.RIM_WARN),
        warn("NOT_SEPARABLE", "separability", cut & (F.col("separability") < F.col("residual_p50"))),
    ]
    return measures.withColumn("warnings", F.array_compact(F.array(*rules)))


OPERATORS = (">=", "<=", ">", "<")


def parse_fail_on(specs: DataFrame, *keep: str) -> DataFrame:
    """A row for each token of `spec`: metric, operator, threshold or the error. A flag has neither operator nor threshold; `default` stands for the default rule.

    Empty tokens and a second rule on a metric are errors.
    """
    tokens = specs.select(*keep, "spec", F.posexplode(F.transform(F.split("spec", ","), lambda x: F.trim(x))).alias("pos", "token"))
    op = F.coalesce(*[F.when(F.col("token").contains(o), F.lit(o)) for o in OPERATORS])
    t = tokens.withColumn("op", op).withColumn("name", F.when(F.col("op").isNull(), F.col("token")).otherwise(F.trim(F.element_at(F.split(F.col("token"), "[<>]=?"), 1))))
    t = t.withColumn("value", F.when(F.col("op").isNotNull(), F.trim(F.element_at(F.split(F.col("token"), "[<>]=?", 2), 2)))).withColumn("number", F.col("value").try_cast("double"))
    known = F.broadcast(C.metrics(specs.sparkSession).select(F.col("metric").alias("name"), "is_flag", "low", "high"))
    t = t.join(known, "name", "left")
    before = F.row_number().over(Window.partitionBy(*keep, "spec", "name").orderBy("pos"))
    t = t.withColumn("nth", before)
    error = (
        F.when(F.col("token") == "", "empty")
        .when((F.col("nth") > 1) & (F.col("is_flag").isNotNull() | (F.col("token") == "default")), "duplicate")
        .when(F.col("token") == "default", F.lit(None))
        .when(F.col("is_flag").isNull(), "unknown_metric")
        .when(F.col("op").isNull() & ~F.col("is_flag"), "needs_threshold")
        .when(F.col("op").isNull(), F.lit(None))
        .when(F.col("is_flag"), "flag_takes_no_threshold")
        .when(F.col("number").isNull() | F.isnan("number"), "not_a_number")
        .when((F.col("number") < F.col("low")) | (F.col("number") > F.coalesce("high", F.lit(float("inf")))), "out_of_range")
        .when((F.col("op") == ">") & (F.col("number") >= F.col("high")), "never_fires")
        .when((F.col("op") == "<") & (F.col("number") <= F.col("low")), "never_fires")
    )
    t = t.withColumn("error", error)
    ok = F.col("error").isNull()
    return t.select(*keep, F.when(ok, F.col("name")).alias("metric"), F.when(ok, F.col("op")).alias("operator"), F.when(ok, F.col("number")).alias("threshold"), "error")


def long_form(measures: DataFrame, names: list[str]) -> DataFrame:
    """A row for each measure: id, metric, actual."""
    return measures.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("actual")) for n in names])).alias("m")).select("id", "m.metric", "m.actual")


def touched(op: Column, actual: Column, threshold: Column) -> Column:
    return F.when(op == ">", actual > threshold).when(op == "<", actual < threshold).when(op == ">=", actual >= threshold).when(op == "<=", actual <= threshold).otherwise(actual == 1)


def gate(measures: DataFrame, rules: DataFrame) -> DataFrame:
    """Explicit rules: pass, fail or unmeasurable, which is no pass."""
    j = long_form(measures, MEASURES).join(F.broadcast(rules.filter("metric IS NOT NULL").select("metric", "operator", "threshold")), "metric")
    status = F.when(F.col("actual").isNull() | F.isnan("actual") | (F.abs("actual") == float("inf")), "unmeasurable").when(touched(F.col("operator"), F.col("actual"), F.col("threshold")), "fail").otherwise("pass")
    return j.select("id", "metric", "operator", "threshold", "actual", status.alias("status"))


def default_gate(measures: DataFrame, metrics: DataFrame) -> DataFrame:
    """The default rule: a check for each calibrated code of each metric. A number that wasn't measured is unmeasurable, whatever fired."""
    fired = F.transform("warnings", lambda w: w["code"])
    own = measures.select("id", fired.alias("fired"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("actual")) for n in MEASURES])).alias("m")).select("id", "fired", "m.metric", "m.actual")
    j = own.join(F.broadcast(metrics.select("metric", "is_flag", F.explode("codes").alias("code"))), "metric")
    status = F.when(~F.col("is_flag") & F.col("actual").isNull(), "unmeasurable").when(F.array_contains(F.col("fired"), F.col("code")), "fail").otherwise("pass")
    return j.select("id", "metric", "code", status.alias("status"))


def evaluate(measures: DataFrame, rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """All checks of a parsed specification: an explicit rule takes the place of the default rule's checks of its metric."""
    explicit = gate(measures, rules.filter("metric != 'default'")).select("id", "metric", F.lit(None).cast("string").alias("code"), "status")
    left = metrics.join(F.broadcast(rules.select("metric")), "metric", "left_anti").join(F.broadcast(rules.filter("metric = 'default'").select(F.lit(True).alias("asked"))))
    return explicit.union(default_gate(measures, left))


def compose_gate(layers: DataFrame, names: list[str], lowest: set[str]) -> DataFrame:
    """The worst of each metric over an id's layers, against the calibrated threshold; not measured anywhere is skipped."""
    worst = layers.groupBy("id").agg(*[(F.min if n in lowest else F.max)(n).alias(n) for n in names])
    rule = {m[0]: (m[2], m[3]) for m in C.COMPOSE_METRICS}
    out = long_form(worst, names)
    fails = F.lit(False)
    for n in names:
        op, t = rule[n]
        fails = F.when(F.col("metric") == n, touched(F.lit(op), F.col("actual"), F.lit(t))).otherwise(fails)
    return out.select("id", "metric", F.round("actual", 6).alias("worst"), F.when(F.col("actual").isNull(), "skipped").when(fails, "fail").otherwise("pass").alias("status"))


def lint(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Nine checks by profile, only those that the profile regulates. Pixel checks without pixels are skipped, which is no pass."""
    j = facts.join(F.broadcast(profiles.withColumnRenamed("name", "profile").withColumnsRenamed({"fill_ratio_min": "fill_min", "square": "must_square"})))
    long = F.greatest("width", "height")

    def check(item: str, regulated: Column, ok: Column, pixel: bool = False) -> Column:
        status = F.when(ok, "pass").when(ok.isNull(), "skipped" if pixel else "unmeasurable").otherwise("fail")
        return F.when(regulated, F.struct(F.lit(item).alias("item"), status.alias("status")))

    col = F.col
    checks = [
        check("format", F.lit(True), F.array_contains(col("formats"), col("format"))),
        check("longest_side", col("longest_side_min").isNotNull() | col("longest_side_max").isNotNull(), (long >= F.coalesce("longest_side_min", F.lit(0))) & (long <= F.coalesce("longest_side_max", F.lit(2**31 - 1)))),
        check("max_pixels", col("max_pixels").isNotNull(), col("width").cast("long") * col("height") <= col("max_pixels")),
        check("square", col("must_square"), col("width") == col("height")),
        check("file_size", col("max_bytes").isNotNull(), col("file_size") <= col("max_bytes")),
        check("alpha", ~col("alpha_allowed"), ~col("has_alpha"), True),
        check("color_space", col("srgb_required"), col("srgb")),
        check("background", col("background").isNotNull(), col("background_delta") <= C.BACKGROUND_TOLERANCE, True),
        check("fill_ratio", col("fill_min").isNotNull(), col("fill_ratio") >= col("fill_min"), True),
    ]
    return j.select("id", "profile", F.explode(F.array_compact(F.array(*checks))).alias("c")).select("id", "profile", "c.item", "c.status")


def candidates(items: DataFrame, models: list[str], boxes: list[bool]) -> DataFrame:
    """Each item with every box choice, model and tolerance."""
    grid = [F.struct(F.lit(b).alias("bbox"), F.lit(m).alias("model"), F.lit(r).alias("rank"), F.lit(t).alias("tolerance")) for b in boxes for r, m in enumerate(models) for t in C.SEARCH_TOLERANCES]
    return items.withColumn("c", F.explode(F.array(*grid))).select(*items.columns, "c.*")


def penalise_collapse(trials: DataFrame) -> DataFrame:
    """Within a box choice and model, by tolerance: from the first foreground below 70 % of the one before on, trials are collapsed."""
    w = Window.partitionBy("id", "bbox", "model").orderBy("tolerance")
    before = F.lag("foreground_ratio").over(w)
    drop = F.coalesce((before > 0) & (F.col("foreground_ratio") < before * (1 - C.FOREGROUND_COLLAPSE)), F.lit(False)).cast("int")
    return trials.withColumn("__drop", drop).withColumn("collapsed", F.max("__drop").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("__drop")


def rank_search(trials: DataFrame) -> DataFrame:
    """place: order of the coarse search; final_place: order of full-size results."""
    fatal = F.col("fatal") + F.col("collapsed").cast("int")
    ties = [F.col("tolerance"), F.col("bbox"), F.col("rank")]
    w = Window.partitionBy("id")
    coarse = w.orderBy(fatal, F.coalesce("separability", F.lit(-1e308)).desc(), *ties)
    final = w.orderBy(fatal, "unmeasured", "quality", F.coalesce("separability", F.lit(0.0)).desc(), *ties)
    return trials.withColumn("place", F.row_number().over(coarse)).withColumn("final_place", F.row_number().over(final))


def canvas_for(subjects: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, profile, subject, side): a range lookup in the ladder, then the profile's limits."""
    j = subjects.join(F.broadcast(profiles.withColumnRenamed("name", "profile")))
    fill = F.coalesce(F.least(F.col("fill_ratio_min") + C.FILL_MARGIN, F.lit(1.0)), F.lit(1.0))
    fits = F.filter(F.array(*[F.lit(r) for r in C.CANVAS_LADDER]), lambda r: r * F.round(fill, 9) <= F.col("subject"))
    side = F.greatest(F.coalesce(F.array_max(fits), F.lit(C.CANVAS_LADDER[0])), F.coalesce("longest_side_min", F.lit(0)))
    side = F.least(side, F.coalesce("longest_side_max", F.lit(2**31 - 1)), F.coalesce(F.floor(F.sqrt("max_pixels")).cast("int"), F.lit(2**31 - 1)))
    return j.select("id", "profile", "subject", side.cast("int").alias("side"))


def fit_quality(items: DataFrame, size_at: Callable[[Column], Column]) -> DataFrame:
    """items (id, quality, max_bytes and more): the first attempt that fits, by array functions in the row; nothing is exploded or shuffled."""
    rungs = F.filter(F.array(*[F.lit(q) for q in C.QUALITY_LADDER]), lambda q: q < F.col("quality"))
    tries = F.transform(F.concat(F.array("quality"), rungs), lambda q: F.struct(q.alias("q"), F.floor(size_at(q)).alias("bytes")))
    t = items.withColumn("tries", tries)
    t = t.withColumn("fit", F.filter("tries", lambda x: x["bytes"] <= F.col("max_bytes")))
    hit, first = F.get("fit", F.lit(0)), F.col("tries")[0]
    code = F.when(hit.isNull(), "MAX_BYTES_UNREACHABLE").when(hit["q"] != F.col("quality"), "QUALITY_REDUCED")
    return t.select("id", F.coalesce(hit["q"], F.col("quality")).alias("used_quality"), F.coalesce(hit["bytes"], first["bytes"]).alias("bytes"), code.alias("warning"), F.when(hit.isNull(), F.array_min(F.transform("tries", lambda x: x["bytes"]))).alias("smallest"))

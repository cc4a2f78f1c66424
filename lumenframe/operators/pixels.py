"""Measures and windows over pixel relations (image_id, y, x, ...). All keys start with image_id, so one exchange by image serves a whole chain of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import ALPHA_FG, MASK_FG, UNIFORM_DELTA_E
from ..functions.color import delta_e, luma, with_lab
from ..functions.stats import nearest_rank, upper_median


def border(px: DataFrame, side: int, width: int = 2) -> DataFrame:
    """The perimeter ring: opaque pixels where an image has any there, else all."""
    ring = px.filter((F.col("x") < width) | (F.col("y") < width) | (F.col("x") >= side - width) | (F.col("y") >= side - width))
    some = F.max((F.col("a") >= ALPHA_FG).cast("int")).over(Window.partitionBy("image_id"))
    return ring.withColumn("some", some).filter((F.col("a") >= ALPHA_FG) | (F.col("some") == 0)).drop("some")


def background(ring: DataFrame, digits: int = 4) -> DataFrame:
    """Upper median colour of each image's ring, the share within the uniform difference and nearest-rank quantiles of the differences."""
    # a ring is bounded by an image's perimeter, and the arrays stay in the exchange of the groupBy
    medians = ring.groupBy("image_id").agg(*[upper_median(F.sort_array(F.collect_list(c))).alias(f"bg_{c}") for c in "rgb"])
    # the background's Lab is worked out once an image, before the join
    d = with_lab(ring, ("r", "g", "b"), "p").join(_background_lab(medians), "image_id").withColumn("d", delta_e("p", "q"))
    own = d.groupBy("image_id", "bg_r", "bg_g", "bg_b").agg(F.count("*").alias("samples"), F.avg((F.col("d") <= UNIFORM_DELTA_E).cast("int")).alias("uniformity"), F.sort_array(F.collect_list(F.round("d", digits))).alias("ds"))
    return own.select("image_id", "bg_r", "bg_g", "bg_b", "samples", F.round("uniformity", digits).alias("uniformity"), nearest_rank(F.col("ds"), 0.5).alias("p50"), nearest_rank(F.col("ds"), 0.9).alias("p90"), F.array_max("ds").alias("d_max"))


def _background_lab(bg: DataFrame) -> DataFrame:
    return with_lab(bg.select("image_id", "bg_r", "bg_g", "bg_b"), ("bg_r", "bg_g", "bg_b"), "q")


def differences(px: DataFrame, bg: DataFrame) -> DataFrame:
    """px with d, the difference of each pixel to its image's background."""
    return with_lab(px, ("r", "g", "b"), "p").join(_background_lab(bg), "image_id").select(*px.columns, delta_e("p", "q").alias("d"))


def mask_of(px: DataFrame, bg: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """(image_id, y, x, m): 255 where a pixel is opaque and differs from its image's background by more than the tolerance."""
    return differences(px, bg).select("image_id", "y", "x", F.when((F.col("d") > tolerance) & (F.col("a") >= MASK_FG), 255).otherwise(0).alias("m"))


def mask_stats(mask: DataFrame, side: int, level: int = MASK_FG) -> DataFrame:
    on = F.col("m") >= level
    pick = lambda f, c: f(F.when(on, F.col(c)))
    own = mask.groupBy("image_id").agg(F.avg(on.cast("int")).alias("ratio"), pick(F.min, "x").alias("x1"), pick(F.min, "y").alias("y1"), pick(F.max, "x").alias("x2"), pick(F.max, "y").alias("y2"))
    edge = (F.col("x1") == 0) | (F.col("y1") == 0) | (F.col("x2") == side - 1) | (F.col("y2") == side - 1)
    return own.select("image_id", F.round("ratio", 4).alias("foreground_ratio"), "x1", "y1", "x2", "y2", F.coalesce(edge, F.lit(False)).alias("touches_edge"))


def _near(value: Column, axis: str, other: str, by: int) -> Column:
    return F.lag(value, by).over(Window.partitionBy("image_id", other).orderBy(axis))


def contour(mask: DataFrame, level: int = MASK_FG) -> DataFrame:
    """Foreground pixels with a background pixel among their four neighbours."""
    on = F.col("m") >= level
    rows, cols = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    low = F.least(*[F.coalesce(f(F.col("m")).over(w), F.lit(255)) for w in (rows, cols) for f in (F.lag, F.lead)])
    return mask.withColumn("low", low).filter(on & (F.col("low") < level)).drop("low")


def _frame(axis: str, other: str, r: int):
    return Window.partitionBy("image_id", other).orderBy(axis).rowsBetween(-r, r)


def box_mean(px: DataFrame, value: str, r: int) -> DataFrame:
    """Separable box mean, rounded after each pass, with windows that shrink at the borders."""
    out = px
    for axis, other in (("x", "y"), ("y", "x")):
        w = _frame(axis, other, r)
        out = out.withColumn("__s", F.sum(value).over(w)).withColumn("__n", F.count("*").over(w)).withColumn(value, F.expr("CAST((__s + __n div 2) div __n AS INT)")).drop("__s", "__n")
    return out


def erode(px: DataFrame, value: str, r: int) -> DataFrame:
    return _slide(px, value, r, F.min)


def dilate(px: DataFrame, value: str, r: int) -> DataFrame:
    return _slide(px, value, r, F.max)


def _slide(px: DataFrame, value: str, r: int, f) -> DataFrame:
    for axis, other in (("x", "y"), ("y", "x")):
        px = px.withColumn(value, f(value).over(_frame(axis, other, r)))
    return px


def opening(px: DataFrame, value: str, r: int) -> DataFrame:
    return dilate(erode(px, value, r), value, r)


def closing(px: DataFrame, value: str, r: int) -> DataFrame:
    return erode(dilate(px, value, r), value, r)


def summed_area(px: DataFrame, value: str) -> DataFrame:
    rows = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    cols = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return px.withColumn("sat", F.sum(value).over(rows)).withColumn("sat", F.sum("sat").over(cols))


def gradients(px: DataFrame, value: str) -> DataFrame:
    """gx, gy, magnitude of Sobel/4 with repeated border pixels, and the direction sector 0 to 3."""
    rows, cols = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    v = F.col(value)
    out = px.withColumn("up", F.coalesce(F.lag(v).over(cols), v)).withColumn("down", F.coalesce(F.lead(v).over(cols), v))
    for name in ("up", value, "down"):
        out = out.withColumn(f"{name}_l", F.coalesce(F.lag(name).over(rows), F.col(name))).withColumn(f"{name}_r", F.coalesce(F.lead(name).over(rows), F.col(name)))
    gx = (F.col("up_r") + F.col(f"{value}_r") * 2 + F.col("down_r") - F.col("up_l") - F.col(f"{value}_l") * 2 - F.col("down_l")) / 4.0
    gy = (F.col("down_l") + F.col("down") * 2 + F.col("down_r") - F.col("up_l") - F.col("up") * 2 - F.col("up_r")) / 4.0
    out = out.withColumn("gx", gx).withColumn("gy", gy).withColumn("mag", F.sqrt(gx * gx + gy * gy))
    ax, ay = F.abs("gx"), F.abs("gy")
    sector = F.when(ay <= ax * 0.41421356237309503, 0).when(ay >= ax * 2.414213562373095, 2).when(F.col("gx") * F.col("gy") > 0, 1).otherwise(3)
    return out.withColumn("sector", sector)


def ridges(px: DataFrame, value: str, threshold: float) -> DataFrame:
    """Pixels over the threshold that are maxima across their gradient: at least the one behind, more than the one ahead."""
    g = gradients(px, value).select("image_id", "y", "x", "mag", "sector")
    rows, cols = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    g = g.withColumn("u", F.lag("mag").over(cols)).withColumn("d", F.lead("mag").over(cols))
    for n in ("u", "d"):
        g = g.withColumn(f"{n}l", F.lag(n).over(rows)).withColumn(f"{n}r", F.lead(n).over(rows))
    g = g.withColumn("l", F.lag("mag").over(rows)).withColumn("r", F.lead("mag").over(rows))
    back = F.when(F.col("sector") == 0, F.col("l")).when(F.col("sector") == 2, F.col("u")).when(F.col("sector") == 1, F.col("ul")).otherwise(F.col("ur"))
    ahead = F.when(F.col("sector") == 0, F.col("r")).when(F.col("sector") == 2, F.col("d")).when(F.col("sector") == 1, F.col("dr")).otherwise(F.col("dl"))
    return g.filter((F.col("mag") > threshold) & (F.col("mag") >= F.coalesce(back, F.lit(0.0))) & (F.col("mag") > F.coalesce(ahead, F.lit(0.0)))).select("image_id", "y", "x", F.round("mag", 4).alias("mag"))


def tallies(px: DataFrame, hit: Column, cell: int) -> DataFrame:
    """Counts, hits and bounding box by grid cell."""
    return px.groupBy("image_id", F.expr(f"y div {cell}").alias("cy"), F.expr(f"x div {cell}").alias("cx")).agg(
        F.sum(hit.cast("int")).alias("num"), F.count("*").alias("den"), *[f(F.when(hit, F.col(c))).alias(n) for n, f, c in (("x1", F.min, "x"), ("y1", F.min, "y"), ("x2", F.max, "x"), ("y2", F.max, "y"))]
    )


def with_luma(px: DataFrame) -> DataFrame:
    return px.withColumn("luma", luma("r", "g", "b"))

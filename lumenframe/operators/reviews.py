"""Review lists: images that join or leave a list, regions still to judge, the rows that count. Windows run over one session's list, whose length the caller bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: images that a list holds.
MAX_IMAGES = 64


def merge_images(images: DataFrame, most: int = MAX_IMAGES) -> DataFrame:
    """images (session, path, prev, loaded: places in the old list and among the loaded, or null; commented, replace), a row an image of either. Gives (session, path, place); no place: dropped.

    Replacing, the loaded come first, then old ones with comments, and the others leave without being dropped. Else the old keep their places and new ones follow.
    Beyond `most` images, old ones that are neither loaded nor commented are dropped from the front, then whatever stands last.
    """
    rows = images.withColumn("__new", F.col("loaded").isNotNull()).filter("NOT replace OR __new OR commented")
    order = F.when(F.col("replace"), F.struct((~F.col("__new")).alias("late"), F.coalesce("loaded", "prev").alias("at"))).otherwise(F.struct(F.col("prev").isNull().alias("late"), F.coalesce("prev", "loaded").alias("at")))
    rows = rows.withColumns({"__order": order, "__spare": (~F.col("__new") & ~F.col("commented")).cast("int")})
    every = Window.partitionBy("session")
    upto = every.orderBy("__order", "path").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__over": F.count("*").over(every) - most, "__nth": F.sum("__spare").over(upto)})
    rows = rows.withColumn("__stays", (~((F.col("__spare") == 1) & (F.col("__nth") <= F.col("__over")))).cast("int"))
    place = F.sum("__stays").over(upto) - 1
    return rows.withColumn("__place", place).select("session", "path", F.when((F.col("__stays") == 1) & (F.col("__place") < most), F.col("__place")).alias("place"))


def pending_regions(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(session, path, index, place): regions neither judged nor skipped, image by image from the one shown on, around the list. An image shown that isn't in the list: from the first.

    images (session, path, at: place in the list from 0, shown: boolean), regions (session, path, index, judged, skipped).
    """
    every = Window.partitionBy("session")
    turned = images.withColumns({"__n": F.count("*").over(every), "__first": F.coalesce(F.min(F.when(F.col("shown"), F.col("at"))).over(every), F.lit(0))})
    turned = turned.select("session", "path", F.pmod(F.col("at") - F.col("__first"), F.col("__n")).alias("__turn"))
    left = regions.filter("NOT judged AND NOT skipped").join(turned, ["session", "path"])
    return left.withColumn("place", F.row_number().over(every.orderBy("__turn", "index")) - 1).select("session", "path", "index", "place")


def latest_rows(rows: DataFrame) -> DataFrame:
    """(image, id, regions) of rows (image, at, id, truth_only, regions: array of structs with code, rect and truth): each image's latest, the later id winning ties.

    Rows that only bring truths don't replace others: they fill truths that are missing, region by region, and stand for an image that has no other row.
    max_by aggregates partially, so an image with many rows is a row a task.
    """
    newest = lambda only: F.max_by(F.when(F.col("truth_only") == F.lit(only), F.struct("id", "regions")), F.when(F.col("truth_only") == F.lit(only), F.struct("at", "id")))
    both = rows.groupBy("image").agg(newest(False).alias("base"), newest(True).alias("extra"))
    own = lambda r: F.get(F.filter("extra.regions", lambda x: (x["code"] == r["code"]) & (x["rect"] == r["rect"])), F.lit(0))
    filled = F.transform("base.regions", lambda r: r.withField("truth", F.coalesce(r["truth"], own(r)["truth"])))
    regions = F.when(F.col("base").isNull(), F.col("extra.regions")).when(F.col("extra").isNull(), F.col("base.regions")).otherwise(filled)
    return both.select("image", F.coalesce("base.id", "extra.id").alias("id"), regions.alias("regions"))

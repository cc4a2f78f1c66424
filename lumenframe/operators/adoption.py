"""Scores of cuts and whether a search's winner replaces the first cut; checks over the items of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.color import c


def quality(rim, rough, halo) -> Column:
    """Measures over their warning limits, added up; one not measured counts 1."""
    terms = [F.coalesce(c(v) / w, F.lit(1.0)) for v, w in ((rim, C.RIM_WARN), (rough, C.ROUGH_WARN), (halo, C.HALO_WARN))]
    return terms[0] + terms[1] + terms[2]


def unmeasured(rim, rough, halo) -> Column:
    return sum((c(v).isNull().cast("int") for v in (rough, halo)), c(rim).isNull().cast("int"))


def improves(a: str, b: str) -> Column:
    """Whether score a (a struct of fatal, unmeasured, quality, separability) is better than b; a tie isn't."""
    p, q = F.col(a), F.col(b)
    out = p["separability"] > q["separability"]
    for k in ("quality", "unmeasured", "fatal"):
        out = (p[k] < q[k]) | ((p[k] == q[k]) & out)
    return out


def adopted(first: str, winner: str, lasting, poor, collapsed) -> Column:
    """Whether the winner replaces the first cut. lasting: fatal codes left other than the hint to give a box; poor: quality codes left."""
    fatal = F.col(winner)["fatal"]
    won = F.when((fatal == 0) & (c(poor) == 0), F.lit(True)).when(fatal > 0, fatal < F.col(first)["fatal"]).otherwise(improves(winner, first))
    return F.when((c(lasting) > 0) | c(collapsed), F.lit(False)).otherwise(won)


def set_conflicts(batches: DataFrame, items: DataFrame) -> DataFrame:
    """(batch, location) of batches (batch, has_set, default_fill) with a set and a fill ratio besides, which can't be combined: that of the defaults, else of the first of items (batch, id, fill_ratio)."""
    place = items.withColumn("__i", F.row_number().over(Window.partitionBy("batch").orderBy("id")) - 1)
    first = place.filter("fill_ratio IS NOT NULL").groupBy("batch").agg(F.min("__i").alias("__i"))
    j = batches.filter("has_set").join(first, "batch", "left")
    where = F.when(F.col("default_fill").isNotNull(), "defaults").otherwise(F.concat(F.lit("items["), F.col("__i").cast("string"), F.lit("]")))
    return j.select("batch", where.alias("location")).filter("location IS NOT NULL")


def reserved_flag(path, reserved: list[tuple[str, Column]]) -> Column:
    """The first option whose side output has an output's path, or null."""
    return F.coalesce(*[F.when(p == c(path), flag) for flag, p in reserved])

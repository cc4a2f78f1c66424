"""Deterministic scenes made from the standard tables: a 24 x 24 product picture for each part, an 8 x 8 tile for each embedding."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 24
#: Parts a task, before they become pictures.
TASK_PARTS = 2500
#: Keys from 0 to this are regular; their colours are bytes.
LAST_KEY = 1 << 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scene_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, r, g, b, a). Rows come from one explode; nothing is shuffled."""
    return px_of(parts(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, s): key and size of each part, from which its scene is made."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))


def spread(part: DataFrame, rows: int) -> DataFrame:
    """The parts dealt by key over tasks: a file of a few MB, which one task reads, is a thousand times as large in pixels."""
    return part.repartition(max(1, math.ceil(rows / TASK_PARTS)), "k")


def regular(part: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The parts, spread, that make one picture of bytes each; and the others, whose key is null, negative, huge or repeated, or None if there are none."""
    own = part.groupBy("k").agg(F.count("*").alias("n")).withColumn("odd", F.expr(f"k IS NULL OR k NOT BETWEEN 0 AND {LAST_KEY} OR n > 1"))
    rows, odd = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if("odd")).first()
    if not odd:
        return spread(part, rows), None
    strange = own.filter("odd").select(F.col("k").alias("__k"))
    is_odd = F.col("k").eqNullSafe(F.col("__k"))
    return spread(part.join(strange, is_odd, "left_anti"), rows), part.join(strange, is_odd, "left_semi")


def px_of(part: DataFrame) -> DataFrame:
    at = part.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)))).selectExpr("k AS image_id", f"i div {SIDE} AS y", f"i % {SIDE} AS x", "4 + s % 8 AS sx", "4 + s div 8 AS sy")
    inside = "x >= 12 - sx AND x < 12 + sx AND y >= 12 - sy AND y < 12 + sy"
    bg = lambda n: f"236 + (image_id + x + y + {n}) % 9"
    return at.selectExpr(
        "image_id",
        "CAST(y AS INT) AS y",
        "CAST(x AS INT) AS x",
        *[f"CAST(CASE WHEN {inside} THEN (image_id * {m} + (x + y) % 3) % 200 ELSE {bg(n)} END AS INT) AS {c}" for c, m, n in (("r", 37, 0), ("g", 59, 1), ("b", 83, 2))],
        f"CASE WHEN image_id % 7 = 0 AND (x IN (0, {SIDE - 1}) OR y IN (0, {SIDE - 1})) THEN 0 ELSE 255 END AS a",
    )


_Y, _X = np.mgrid[:SIDE, :SIDE]
#: Background levels by key % 9 for the red channel (green is one further on, blue two), and levels inside by key * m % 200.
_BACK = np.stack([236 + (k + _X + _Y) % 9 for k in range(9)]).astype(np.uint8)
_FRONT = np.stack([(k + (_X + _Y) % 3) % 200 for k in range(200)]).astype(np.uint8)
_RIM = (_X == 0) | (_X == SIDE - 1) | (_Y == 0) | (_Y == SIDE - 1)


def scene_planes(k: np.ndarray, s: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    """Planes r, g, b and a, bytes, of the scenes of regular keys k and sizes s; where a size isn't known, all is background."""
    s = s.astype(np.int64)
    sx, sy = (4 + np.fmod(s, 8))[:, None], (4 + np.sign(s) * (np.abs(s) // 8))[:, None]
    at = np.arange(SIDE)[None]
    wide, high = (at >= 12 - sx) & (at < 12 + sx) & known[:, None], (at >= 12 - sy) & (at < 12 + sy)
    inside = high[:, :, None] & wide[:, None, :]
    rgb = [np.where(inside, _FRONT[k % 200 * m % 200], _BACK[(k + n) % 9]) for m, n in ((37, 0), (59, 1), (83, 2))]
    return [*rgb, np.where((k % 7 == 0)[:, None, None] & _RIM, 0, 255).astype(np.uint8)]


def tile_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, v): an embedding's 64 numbers as an 8 x 8 grey tile."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return e.selectExpr("vec_id AS image_id", "i div 8 AS y", "i % 8 AS x", "CAST(least(greatest(floor((CAST(e AS DOUBLE) + 1) * 127.5), 0), 255) AS INT) AS v")


_IN = "x >= 12 - sx AND x < 12 + sx AND y >= 12 - sy AND y < 12 + sy"
#: The same relations as common table expressions.
SCENE_SQL = f"""scene_px AS (SELECT image_id, y, x,
  {", ".join(f"CAST(CASE WHEN {_IN} THEN (image_id * {m} + (x + y) % 3) % 200 ELSE 236 + (image_id + x + y + {n}) % 9 END AS INT) AS {c}" for c, m, n in (("r", 37, 0), ("g", 59, 1), ("b", 83, 2)))},
  CASE WHEN image_id % 7 = 0 AND (x IN (0, 23) OR y IN (0, 23)) THEN 0 ELSE 255 END AS a
  FROM (SELECT p_partkey AS image_id, (i // 24)::INT AS y, (i % 24)::INT AS x, 4 + p_size % 8 AS sx, 4 + p_size // 8 AS sy FROM part, range(576) AS t(i)))"""
TILE_SQL = """tile_px AS (SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, least(greatest(floor((e::DOUBLE + 1) * 127.5), 0), 255)::INT AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"""

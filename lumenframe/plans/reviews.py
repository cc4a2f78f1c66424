"""Queries of review lists and of free room in pictures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import layout
from ..operators import reviews
from ..operators.rasters import through
from ..sources.scenes import TILE_SQL, table
from .rasters import tiles

IMAGES = """SELECT user_id % 50 AS session, event_id AS path, CASE WHEN event_id % 3 > 0 THEN event_id END AS prev, CASE WHEN event_id % 2 = 0 THEN event_id * 7919 % 100003 END AS loaded,
  event_id % 5 = 0 AS commented, user_id % 50 % 4 = 0 AS replace FROM events WHERE event_id % 3 > 0 OR event_id % 2 = 0"""


def events(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events", "FROM {e}"), e=table(spark, d, "events"))


def merged_images(spark: SparkSession, d: str) -> DataFrame:
    return reviews.merge_images(events(spark, d, IMAGES))


MERGED_SQL = f"""WITH i AS (SELECT *, CASE WHEN replace THEN loaded IS NULL ELSE prev IS NULL END AS late, CASE WHEN replace THEN coalesce(loaded, prev) ELSE coalesce(prev, loaded) END AS ord,
    loaded IS NULL AND NOT commented AS spare FROM ({IMAGES}) WHERE NOT replace OR loaded IS NOT NULL OR commented),
n AS (SELECT *, count(*) OVER (PARTITION BY session) - 64 AS over_n, count(*) FILTER (spare) OVER (PARTITION BY session ORDER BY late, ord, path ROWS UNBOUNDED PRECEDING) AS nth FROM i),
s AS (SELECT session, path, row_number() OVER (PARTITION BY session ORDER BY late, ord, path) - 1 AS place FROM n WHERE NOT (spare AND nth <= over_n))
SELECT i.session AS session, i.path AS path, CASE WHEN s.place < 64 THEN s.place END AS place FROM i LEFT JOIN s ON s.session = i.session AND s.path = i.path"""

LISTED = "SELECT user_id % 50 AS session, event_id AS path, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1 AS at_n, event_id % 37 = 0 AND user_id % 50 % 5 > 0 AS shown FROM events"
REGIONS = "SELECT user_id % 50 AS session, event_id AS path, k AS index, (event_id + k) % 3 = 0 AS judged, (event_id * 3 + k) % 7 = 0 AS skipped FROM events"


def pending_regions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    regions = e.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr("user_id % 50 AS session", "event_id AS path", "k AS index", "(event_id + k) % 3 = 0 AS judged", "(event_id * 3 + k) % 7 = 0 AS skipped")
    return reviews.pending_regions(events(spark, d, LISTED).withColumnRenamed("at_n", "at"), regions)


PENDING_SQL = f"""WITH i AS ({LISTED}), f AS (SELECT session, count(*) AS n, coalesce(min(CASE WHEN shown THEN at_n END), 0) AS first_n FROM i GROUP BY session),
r AS ({REGIONS.replace('FROM events', 'FROM events, (VALUES (0), (1)) v(k)')})
SELECT r.session AS session, r.path AS path, r.index AS index, row_number() OVER (PARTITION BY r.session ORDER BY (CASE WHEN at_n >= first_n THEN at_n - first_n ELSE at_n - first_n + n END), r.index) - 1 AS place
FROM r JOIN i ON i.session = r.session AND i.path = r.path JOIN f ON f.session = r.session WHERE NOT judged AND NOT skipped"""


def truth_filled(spark: SparkSession, d: str) -> DataFrame:
    """Each image's latest review with the truths that other rows bring, a row a region."""
    region = lambda k: f"named_struct('code', (event_id * {k + 2} + {k}) % 4, 'rect', event_id % 3 + {k}, 'truth', CASE (event_id + {k}) % 4 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' END)"
    rows = table(spark, d, "events").selectExpr("user_id AS image", "date_trunc('DAY', ts) AS at", "event_id AS id", "event_id % 3 = 1 AS truth_only", f"array({region(0)}, {region(1)}) AS regions")
    return reviews.latest_rows(rows).select("image", "id", F.posexplode("regions").alias("index", "r")).select("image", "id", "index", "r.code", "r.rect", "r.truth")


def _region_sql(k: int) -> str:
    return f"SELECT user_id AS image, event_id AS id, {k} AS index, (event_id * {k + 2} + {k}) % 4 AS code, event_id % 3 + {k} AS rect, CASE (event_id + {k}) % 4 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' END AS truth FROM events"


TRUTH_SQL = f"""WITH e AS (SELECT user_id AS image, event_id AS id, event_id % 3 = 1 AS extra, row_number() OVER (PARTITION BY user_id, event_id % 3 = 1 ORDER BY date_trunc('day', ts) DESC, event_id DESC) AS rn FROM events),
b AS (SELECT image, id FROM e WHERE rn = 1 AND NOT extra), x AS (SELECT image, id FROM e WHERE rn = 1 AND extra), r AS ({_region_sql(0)} UNION ALL {_region_sql(1)}),
own AS (SELECT image, id FROM b UNION ALL SELECT image, id FROM x WHERE image NOT IN (SELECT image FROM b))
SELECT r.image AS image, r.id AS id, r.index AS index, r.code AS code, r.rect AS rect,
  coalesce(r.truth, (SELECT arg_min(q.truth, q.index) FROM r q JOIN x ON x.image = q.image AND x.id = q.id WHERE q.image = r.image AND q.code = r.code AND q.rect = r.rect)) AS truth
FROM r JOIN own ON own.image = r.image AND own.id = r.id"""

#: Grey from which a tile's pixel is taken, and the tiles' cell and margin.
TAKEN, TILE_CELL, TILE_MARGIN = 155, 2, 1
BOX = "image_id long, x int, y int, width int, height int"


def free_rectangles(spark: SparkSession, d: str) -> DataFrame:
    """All maximal free rectangles of each tile."""
    return through(tiles(spark, d), lambda p: layout.free_rectangles(p[..., 0] >= TAKEN, (0, 0, 8, 8), TILE_MARGIN, (2, 2), TILE_CELL), BOX)


FREE_SQL = f"""WITH {TILE_SQL}, c AS (SELECT range AS c FROM range(4)),
f AS (SELECT image_id, i.c AS i, j.c AS j, max(CASE WHEN v >= {TAKEN} AND x BETWEEN 2 * i.c - 1 AND 2 * i.c + 2 AND y BETWEEN 2 * j.c - 1 AND 2 * j.c + 2 THEN 1 ELSE 0 END) AS taken FROM tile_px, c i, c j GROUP BY ALL),
a AS (SELECT f.image_id AS image_id, l.c AS l, t.c AS t, r.c AS r, b.c AS b FROM f, c l, c t, c r, c b WHERE l.c <= r.c AND t.c <= b.c AND f.i BETWEEN l.c AND r.c AND f.j BETWEEN t.c AND b.c GROUP BY ALL HAVING sum(f.taken) = 0)
SELECT image_id, (2 * l)::INT AS x, (2 * t)::INT AS y, (2 * (r - l + 1))::INT AS width, (2 * (b - t + 1))::INT AS height FROM a
WHERE NOT EXISTS (SELECT 1 FROM a o WHERE o.image_id = a.image_id AND o.l <= a.l AND o.t <= a.t AND o.r >= a.r AND o.b >= a.b AND (o.l, o.t, o.r, o.b) != (a.l, a.t, a.r, a.b))"""


def free_regions(spark: SparkSession, d: str) -> DataFrame:
    """The free rectangles that are reported, with their rank and share of the tile."""

    def kernel(p: np.ndarray) -> list[tuple]:
        kept = layout.free_regions(layout.free_rectangles(p[..., 0] >= TAKEN, (0, 0, 8, 8), TILE_MARGIN, (2, 2), TILE_CELL))
        return [(k, *r, r[2] * r[3] / 64) for k, r in enumerate(kept)]

    return through(tiles(spark, d), kernel, BOX.replace("image_id long,", "image_id long, rank int,") + ", share double")


QUERIES = {
    "merged_images": (merged_images, MERGED_SQL),
    "pending_regions": (pending_regions, PENDING_SQL),
    "truth_filled": (truth_filled, TRUTH_SQL),
    "free_rectangles": (free_rectangles, FREE_SQL),
    "free_regions": (free_regions, None),
}

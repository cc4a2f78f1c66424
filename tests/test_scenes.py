"""Measures of scenes, batch by batch, against SQL on odd parts, and what their plans must not hold."""

import duckdb
import numpy as np
import pytest

from lumenframe.kernels import raster as K
from lumenframe.plans import registry
from lumenframe.sources.scenes import TASK_PARTS, scene_planes

#: Queries that measure each scene where it is made.
IN_BATCHES = [
    "reflection",
    "shadow_alpha",
    "composite_over",
    "cell_tallies",
    "contour_pixels",
    "separability",
]
#: Keys that make no picture of bytes, and sizes beyond the picture, negative or unknown.
ODD = [(1, 5), (7, None), (14, 200), (3, -60), (-5, 12), (-14, 30), (None, 9), ((1 << 50) + 3, 17), (200, 49)]


def parts_in(spark, path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    return str(path)


def equals_sql(spark, path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{path}/part.parquet/*.parquet'")
    q = registry.queries()[name](spark, path)
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(repr(tuple(r)) for r in q.select(*columns).collect()) == sorted(repr(r) for r in want.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", IN_BATCHES)
def test_odd_parts(spark, tmp_path, name):
    equals_sql(spark, parts_in(spark, tmp_path, ODD), name)


@pytest.mark.parametrize("name", [n for n in IN_BATCHES if n in ("reflection", "composite_over")])
def test_repeated_parts(spark, tmp_path, name):
    equals_sql(spark, parts_in(spark, tmp_path, [(1, 5), (2, 9), (2, 30), (3, 4), (3, 4)]), name)


@pytest.mark.parametrize("name", IN_BATCHES)
def test_no_pixel_is_shuffled_or_joined(spark, name):
    plan = plan_of(registry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert not [x for x in ("Generate", "Join", "Window", "collect_list") if x in plan]


def test_rotated_gathers_no_picture(spark, tmp_path):
    q = registry.queries()["rotated"]
    assert "collect_list" not in plan_of(q(spark, "/root/testdata/sf0.001"))
    path = parts_in(spark, tmp_path, [(1, 5), (7, None), (14, 200)])
    planes = scene_planes(np.array([1, 7, 14]), np.array([5, 0, 200]), np.array([True, False, True]))
    want = {(k, y, x): tuple(v) for k, p in zip((1, 7, 14), np.stack(planes, axis=-1)) for (y, x), v in pixels(K.rotate(p, 30.0))}
    assert {(r.image_id, r.y, r.x): (r.r, r.g, r.b, r.a) for r in q(spark, path).collect()} == want


def pixels(p):
    return [(at, p[at].tolist()) for at in np.ndindex(p.shape[:2])]


def test_colour_scalars_once_a_colour(spark, tmp_path):
    many = parts_in(spark, tmp_path / "many", [(k, k % 50) for k in range(TASK_PARTS + 1)])
    plan = plan_of(registry.queries()["colour_scalars"](spark, many))
    # parts are dealt over tasks before they become pixels
    assert "BroadcastHashJoin" in plan and "hashpartitioning(k" in plan
    equals_sql(spark, parts_in(spark, tmp_path, [(1, 5), (7, None), (14, 200), (3, -60)]), "colour_scalars")

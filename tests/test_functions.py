"""Column functions and operators on hand-made values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import color, geometry, stats, text
from lumenframe.plans import registry


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_medians_differ(spark):
    a = F.array(*[F.lit(x) for x in (1, 2, 3, 4)])
    r = one(spark, u=stats.upper_median(a), l=stats.lower_median(a), m=stats.middle_median(a), q=stats.nearest_rank(a, 0.5), none=stats.upper_median(F.expr("cast(array() as array<int>)")))
    assert (r.u, r.l, r.m, r.q, r.none) == (3, 2, 2.5, 3, None)


def test_parsers(spark):
    r = one(spark, a=text.parse_size(F.lit("800x600")), b=text.parse_size(F.lit("0")), c=text.parse_hex_color(F.lit("#fA3")), d=text.parse_max_bytes(F.lit("2MiB")), e=text.parse_max_bytes(F.lit("1.5m")), f=text.parse_bbox(F.lit("1,2,1,4")), g=text.parse_pairs(F.lit("a=1, b=x=y")), h=text.parse_pairs(F.lit("a=1,a=2")))
    assert tuple(r.a) == (800, 600) and r.b is None and r.c == [255, 170, 51] and r.d == 2097152 and r.e is None and r.f is None
    assert r.g == {"a": "1", "b": "x=y"} and r.h is None


def test_closest_key(spark):
    r = one(spark, a=text.closest(F.lit("tolerence"), ["input", "tolerance"]), b=text.closest(F.lit("xxxxxxxx"), ["input", "tolerance"]))
    assert (r.a, r.b) == ("tolerance", None)


def test_over_and_round_trip(spark):
    px = spark.createDataFrame([(255, 0, 0, 128, 0, 0, 255, 255), (9, 9, 9, 0, 1, 2, 3, 0)], "sr int, sg int, sb int, sa int, r int, g int, b int, a int")
    out = [tuple(x) for x in px.select(*color.over(("sr", "sg", "sb", "sa"), ("r", "g", "b", "a"))).collect()]
    assert out == [(128, 0, 127, 255), (0, 0, 0, 0)]
    assert spark.range(256).filter(color.to_srgb_u8(color.to_linear("id")) != F.col("id")).count() == 0


def test_box_widths():
    assert geometry.box_widths(0) == [1, 1, 1]
    assert all(w % 2 for w in geometry.box_widths(2.5))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "part supplier customer orders lineitem events documents pages embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = registry.queries()[name](spark, d)
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == want

"""Cases of thresholds, layers, headers and adoption, worked out by hand."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumenframe.functions import formats, layers, limits
from lumenframe.operators import adoption


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_limits(spark):
    core = lambda t, p: value(spark, limits.core_tolerance(F.lit(float(t)), F.lit(float(p))))
    # a third of 60 is the most; twice 2 lies below; 1 is the least; no tolerance, no core; a tolerance under 1 is itself the most
    assert [core(60, 50), core(60, 2), core(60, 0), core(0, 9), core(0.5, 9)] == [20.0, 4.0, 1.0, 0.0, 0.5]
    reach = lambda w, h: value(spark, limits.shadow_reach(F.lit(w), F.lit(h)))
    assert [reach(100, 5000), reach(960, 2000), reach(4000, 4000)] == [16, 40, 64]
    edge = lambda r, a, b: value(spark, limits.edge_threshold(F.lit(r).cast("double"), F.lit(float(a)), F.lit(float(b))))
    assert [edge(3.0, 20, 20), edge(None, 7.9, 20), edge(None, 8, 20), edge(None, 8, 5)] == [3.0, 8.0, 30.0, 8.0]
    gains = lambda *g: value(spark, limits.out_of_range(*[F.lit(x).cast("double") for x in g]))
    assert [gains(1.0, 0.25, 4.0), gains(1.0, 0.2, 1.0), gains(1.0, 4.1, 1.0), gains(1.0, float("nan"), 1.0), gains(1.0, None, 1.0)] == [False, True, True, True, True]


def test_shadow_is_darker_and_of_like_chroma(spark):
    q = lambda *lab: [limits.quantised(F.lit(float(x))) for x in lab]
    is_shadow = lambda lab, tol: value(spark, limits.is_shadow(q(*lab), q(90, 0, 0), F.lit(float(tol))))
    assert [is_shadow((80, 0, 0), 12), is_shadow((77, 0, 0), 12), is_shadow((90, 0, 0), 12), is_shadow((80, 4, 0), 12), is_shadow((80, 4, 1), 12), is_shadow((80, 0, 0), 0)] == [True, False, False, True, False, False]
    assert value(spark, limits.quantised(F.lit(-1.999))) == -511 and value(spark, limits.quantised(F.lit(200.0))) == 32767


def test_layers(spark):
    rect = lambda *r: [F.lit(float(x)) for x in r]
    over = lambda p: value(spark, layers.overflow(rect(0, 0, 100, 50), rect(*p)))
    assert [over((0, 0, 100, 50)), over((0, 0, 100 + 1 / 64, 50)), over((-3, 0, 105, 51))] == [0.0, 0.0, 3.0]
    assert not value(spark, layers.meets(rect(0, 0, 10, 10), rect(10, 0, 5, 5))) and value(spark, layers.meets(rect(0, 0, 10, 10), rect(9, 9, 5, 5)))
    # 1280 x 720 loses 25 rows above and below the profile's aspect
    assert value(spark, F.array(*layers.safe_area(F.lit(1280), F.lit(720)))) == [0.0, 133.0, 1280.0, 454.0]
    assert value(spark, F.array(*layers.safe_area(F.lit(2560), F.lit(1340)))) == [0.0, 216.0, 2560.0, 908.0]
    assert value(spark, layers.layer_warnings(F.lit(0.5), F.lit(4.4), F.lit(0.02), F.lit(True))) == ["TEXT_OVERFLOW", "TEXT_CONTRAST_LOW", "OUTSIDE_SAFE_AREA"]
    assert value(spark, layers.layer_warnings(*[F.lit(None).cast(t) for t in ("double", "double", "double", "boolean")])) == []
    assert [value(spark, layers.coverage_class(F.lit(x))) for x in (0.5, 0.05, 0.049)] == ["foreground", "partial", "background"]
    assert value(spark, layers.required_size(F.lit(1280), F.lit(192))) == 74 and value(spark, layers.display_height(F.lit(16384), F.lit(16), F.lit(192))) == 1


@pytest.mark.parametrize(
    ("content", "family"),
    [
        (b"\0\0\0\x18ftypheic\0\0\0\0mif1heic", "heif"),
        (b"\0\0\0\x18ftypmif1\0\0\0\0mif1avif", "avif"),
        (b"\0\0\0\x14ftypmif1\0\0\0\0mif1avif", "heif"),  # the box ends before the last brand
        (b"\0\0\0\x10ftypisomavif", None),  # a minor version
        (b"\0\0\0\x00ftypavif\0\0\0\0", "avif"),
        (b"\0\0\0\x18free" + b"avif" * 4, None),
        (b"\0\0\0\x18ftypavif", None),
        (b"", None),
        (None, None),
    ],
)
def test_file_family(spark, content, family):
    df = spark.createDataFrame([Row(c=content)], "c binary")
    assert df.select(formats.file_family("c").alias("v")).first().v == family


def test_animated_webp(spark):
    head = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0"
    df = spark.createDataFrame([(1, head + b"\x02"), (2, head + b"\x10"), (3, head), (4, b"RIFF\0\0\0\0WEBPVP8 \x0a\0\0\0\x02"), (5, None)], "id int, c binary")
    assert {r.id for r in df.filter(formats.animated_webp("c")).collect()} == {1}


def test_adoption(spark):
    score = "struct<fatal:int,unmeasured:int,quality:double,separability:double>"
    rows = [
        (1, (1, 0, 1.0, 5.0), (0, 0, 3.0, 5.0), 0, 0, False, True),  # clean
        (2, (1, 0, 1.0, 5.0), (0, 0, 3.0, 5.0), 0, 1, True, False),  # collapsed
        (3, (1, 0, 1.0, 5.0), (1, 0, 0.5, 9.0), 0, 1, False, False),  # as many fatal codes
        (4, (2, 0, 1.0, 5.0), (1, 0, 3.0, 1.0), 0, 1, False, True),
        (5, (2, 0, 1.0, 5.0), (1, 0, 3.0, 1.0), 1, 1, False, False),  # a lasting code
        (6, (0, 1, 1.0, 5.0), (0, 0, 3.0, 1.0), 0, 1, False, True),  # more is measured
        (7, (0, 0, 1.0, 5.0), (0, 0, 1.0, 5.0), 0, 1, False, False),  # a tie
        (8, (0, 0, 1.0, 5.0), (0, 0, 1.0, 6.0), 0, 1, False, True),
    ]
    df = spark.createDataFrame(rows, f"id int, f {score}, w {score}, lasting int, poor int, collapsed boolean, want boolean")
    got = df.select("id", "want", adoption.adopted("f", "w", "lasting", "poor", "collapsed").alias("got")).collect()
    assert [(r.id, r.got) for r in got] == [(r.id, r.want) for r in got]


def test_set_conflicts(spark):
    batches = spark.createDataFrame([(1, True, 0.9), (2, True, None), (3, True, None), (4, False, 0.9)], "batch int, has_set boolean, default_fill double")
    items = spark.createDataFrame([(1, 1, 0.8), (2, 5, None), (2, 6, 0.7), (2, 7, 0.6), (3, 1, None), (4, 1, 0.5)], "batch int, id int, fill_ratio double")
    assert {(r.batch, r.location) for r in adoption.set_conflicts(batches, items).collect()} == {(1, "defaults"), (2, "items[1]")}

"""Rules on cases worked by hand."""

from pyspark.sql import functions as F

from lumenframe import catalog as C
from lumenframe.functions import geometry, text
from lumenframe.operators import rules as R

FIELDS = "id long, foreground_ratio double, separability double, halo_ratio double, edge_width double, contour_roughness double, rim_contamination double, touches_edge double, uniformity double, residual_p50 double, bbox_given double, subject_high double"


def test_warnings_read_their_context(spark):
    even, uneven = (0.99, 3.0), (0.5, 30.0)
    rows = [
        (1, 0.5, 20.0, None, None, None, None, 1.0, *even, 0.0, 1.0),
        (2, 0.5, 20.0, None, None, None, None, 1.0, *uneven, 0.0, 1.0),
        (3, 0.5, 20.0, None, None, None, None, 1.0, *uneven, 1.0, 1.0),
        (4, 0.995, 20.0, None, None, None, None, 0.0, *uneven, 0.0, 0.0),
    ]
    got = {r.id: [w.code for w in r.warnings] for r in R.warnings(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got[1] == ["SUBJECT_TOUCHES_EDGE"]
    assert got[2] == ["LOW_UNIFORMITY", "BBOX_RECOMMENDED", "NOT_SEPARABLE"]
    assert got[3] == ["LOW_UNIFORMITY", "SUBJECT_TOUCHES_EDGE", "NOT_SEPARABLE"]
    assert got[4] == ["LOW_UNIFORMITY", "FOREGROUND_TOO_LARGE"]


def test_specifications_refuse_empty_and_double_rules(spark):
    spec = spark.createDataFrame([("default,,halo_ratio>0.1, halo_ratio<0.5,default,colour>1",)], "spec string")
    got = [(r.metric, r.error) for r in R.parse_fail_on(spec).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("default", None), (None, "empty"), ("halo_ratio", None), (None, "duplicate"), (None, "duplicate"), (None, "unknown_metric")]))


def test_explicit_rule_takes_the_place_of_the_default(spark):
    m = R.warnings(spark.createDataFrame([(1, 0.5, 20.0, 0.2, None, None, 0.5, 0.0, 0.99, 3.0, 0.0, 1.0)], FIELDS))
    rules = R.parse_fail_on(spark.createDataFrame([("default,halo_ratio>0.5",)], "spec string"))
    got = {(r.metric, r.code): r.status for r in R.evaluate(m, rules, C.metrics(spark)).collect()}
    assert got["halo_ratio", None] == "pass" and ("halo_ratio", "HALO_REMAINS") not in got
    assert got["contour_roughness", "CONTOUR_ROUGH"] == "unmeasurable" and got["rim_contamination", "RIM_CONTAMINATED"] == "fail" and got["touches_edge", "SUBJECT_TOUCHES_EDGE"] == "pass"


def test_sizes_and_boxes(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1280,), (1 << 20,)], "n long")
    assert [r[0] for r in df.select(text.human_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 MB"]
    box = geometry.bbox_to_pixels([F.lit(v) for v in (120.5, -2.0, 130.2, 40.1)], F.lit(100), F.lit(50))
    assert list(spark.range(1).select(*box).first()) == [120, 0, 120, 41]

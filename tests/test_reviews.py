"""Review lists worked out by hand; free rectangles against brute force."""

import itertools

import numpy as np
import pytest

from lumenframe.kernels import layout
from lumenframe.operators import reviews

IMAGES = "session int, path string, prev int, loaded int, commented boolean, replace boolean"


def merged(spark, rows, most):
    got = reviews.merge_images(spark.createDataFrame(rows, IMAGES), most).collect()
    return [r.path for r in sorted((r for r in got if r.place is not None), key=lambda r: r.place)], {r.path for r in got if r.place is None}


def test_merge_images(spark):
    old = [(1, "a", 0, None, False), (1, "b", 1, 1, False), (1, "c", 2, None, True), (1, "d", None, 0, False)]
    append, replace = ([(*r, flag) for r in old] for flag in (False, True))
    assert merged(spark, append, 9) == (["a", "b", "c", "d"], set())
    assert merged(spark, append, 3) == (["b", "c", "d"], {"a"})
    # nothing else may be spared, so the end of the list goes
    assert merged(spark, append, 2) == (["b", "c"], {"a", "d"})
    assert merged(spark, replace, 9) == (["d", "b", "c"], set())
    assert merged(spark, replace, 2) == (["d", "b"], {"c"})
    assert merged(spark, [], 2) == ([], set())


@pytest.mark.parametrize(("shown", "want"), [("b", [("b", 0), ("c", 1), ("a", 0), ("a", 1)]), ("none", [("a", 0), ("a", 1), ("b", 0), ("c", 1)])])
def test_pending_regions(spark, shown, want):
    images = spark.createDataFrame([(1, p, i, p == shown) for i, p in enumerate("abc")], "session int, path string, at int, shown boolean")
    regions = spark.createDataFrame([(1, "a", 0, False, False), (1, "a", 1, False, False), (1, "b", 0, False, False), (1, "b", 1, True, False), (1, "c", 0, False, True), (1, "c", 1, False, False)], "session int, path string, index int, judged boolean, skipped boolean")
    got = sorted(reviews.pending_regions(images, regions).collect(), key=lambda r: r.place)
    assert [(r.path, r["index"]) for r in got] == want


def test_latest_rows_fill_truths(spark):
    one, two, three = (7, 1, None), (8, 1, "miss"), (9, 1, None)
    rows = [
        (1, 5, 1, False, [one]),
        (1, 6, 2, False, [one, two, three]),
        (1, 9, 3, True, [(7, 1, "hit"), (8, 1, "hit"), (9, 2, "hit")]),
        (2, 1, 4, True, [(7, 1, "hit")]),
        (3, 1, 5, False, [one]),
        (3, 1, 6, False, [three]),
    ]
    df = spark.createDataFrame(rows, "image int, at int, id int, truth_only boolean, regions array<struct<code:int,rect:int,truth:string>>")
    got = {r.image: (r.id, [tuple(x) for x in r.regions]) for r in reviews.latest_rows(df).collect()}
    assert got == {1: (2, [(7, 1, "hit"), (8, 1, "miss"), (9, 1, None)]), 2: (4, [(7, 1, "hit")]), 3: (6, [three])}


def brute(free):
    rows, cols = free.shape
    every = [(x0, y0, x1, y1) for x0, x1 in itertools.combinations(range(cols + 1), 2) for y0, y1 in itertools.combinations(range(rows + 1), 2) if free[y0:y1, x0:x1].all()]
    holds = lambda o, r: o != r and o[0] <= r[0] and o[1] <= r[1] and o[2] >= r[2] and o[3] >= r[3]
    return sorted(r for r in every if not any(holds(o, r) for o in every))


def test_maximal_rectangles_against_brute_force():
    draw = np.random.default_rng(5)
    for share in (0.0, 0.2, 0.5, 0.9, 1.0):
        for shape in ((1, 6), (5, 1), (4, 5), (6, 6)):
            free = draw.random(shape) < share
            assert sorted(layout.maximal_rectangles(free)) == brute(free)


def test_free_cells_against_brute_force():
    draw = np.random.default_rng(6)
    taken = draw.random((19, 27)) < 0.02
    xs, ys = layout.edges(3, 20), layout.edges(1, 18)
    assert xs.tolist() == [3, 11, 19, 23] and ys.tolist() == [1, 9, 17, 19]
    want = [[not taken[max(a - 2, 0) : b + 2, max(c - 2, 0) : d + 2].any() for c, d in zip(xs, xs[1:])] for a, b in zip(ys, ys[1:])]
    assert layout.free_cells(taken, xs, ys, 2).tolist() == want


def test_free_regions_leave_out_what_lies_inside():
    # the second shares 70 % with the first, the third less
    assert layout.free_regions([(0, 0, 10, 10), (3, 0, 10, 9), (4, 0, 10, 8)]) == [(0, 0, 10, 10), (4, 0, 10, 8)]
    assert len(layout.free_regions([(20 * k, 0, 10, 10) for k in range(12)])) == layout.MAX_REGIONS
    assert layout.free_rectangles(np.zeros((16, 16), bool), (0, 0, 0, 16), 0, (1, 1)) == []
    assert layout.free_rectangles(np.zeros((16, 16), bool), (0, 0, 16, 16), 0, (1, 1)) == [(0, 0, 16, 16)]

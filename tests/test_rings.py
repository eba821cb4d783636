"""Rings of four corners by plain arithmetic give the figures of the lambdas, and leave them no work."""

import pytest
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.operators import openings as O
from planlake.operators import rings as R
from planlake.operators import walls as W

POLYS = [
    [(0, 0), (5000, 0), (5000, 240), (0, 240)],
    [(0, 0), (0, 0), (900, 100), (0, 300)],
    [(10, 10), (10, 10), (10, 10), (10, 10)],
    [(0, 0), (400, 300), (700, -100), (300, -400)],
    [(0, 0), (1000, 0), (200, 100), (0, 900)],
    [(0, 0), (1000, 0), (500, 700)],
    [(0, 0), (1000, 0), (1300, 400), (600, 900), (-100, 300)],
    [(0, 0), (1000, 0), (1000, 300), (0, None)],
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"d{i}", i, [dict(x=None if x is None else float(x), y=None if y is None else float(y)) for x, y in p]) for i, p in enumerate(POLYS)]
    d = spark.createDataFrame(rows, "det_id string, i int, points array<struct<x: double, y: double>>")
    axes = spark.createDataFrame([(0.0, 100.0, 900.0, 150.0), (50.0, 0.0, 350.0, 400.0), (5.0, 5.0, 5.0, 5.0)], "x1 double, y1 double, x2 double, y2 double")
    return d.crossJoin(axes).withColumn("rect", G.rect_from_axis(*W.cols(""), F.lit(240.0)))


def test_least_rect_as_by_lambdas(table):
    d = R.with_least_rect(table.withColumn("want", G.oriented_rect(F.col("points"))), "points", "got")
    assert d.where("NOT got <=> want").count() == 0 and d.where("got IS NOT NULL").count() >= 18


def test_iou_as_by_lambdas(table):
    sound = table.where("i <> 7")
    d = R.with_iou(sound.withColumn("want", G.iou(F.col("rect"), F.col("points"))), "rect", "points", "got")
    assert d.where("NOT got <=> want").count() == 0 and d.where("got > 0").count() >= 6


def test_thickness_names_the_centroid_once(spark, table):
    """The centroid's sums stood at every place where a side's distance named them: fifty folds a ring, now one for x and one for y."""
    d = table.select(G.polygon_thickness(F.col("points")).alias("t"))
    assert d._jdf.queryExecution().analyzed().toString().count("aggregate(") <= 2
    assert table.where("i = 0").select(G.polygon_thickness(F.col("points")).alias("t")).first()["t"] == 240.0


def fitted(spark, ring, wall=(0.0, 0.0, 4000.0, 0.0)):
    o = spark.createDataFrame([("p", "o", "DOOR", [dict(x=float(x), y=float(y)) for x, y in ring])], "plan_id string, det_id string, kind string, points array<struct<x: double, y: double>>")
    w = spark.createDataFrame([("p", "w", *wall, 200.0)], "plan_id string, det_id string, x1 double, y1 double, x2 double, y2 double, thickness double")
    a = spark.createDataFrame([("p", "o", "w")], "plan_id string, det_id string, wall_id string")
    return O.fit_opening(a, o, w)


def test_fit_is_chosen_within_the_row(spark):
    """Places were rows of their own, ranked by a window: 32 times the openings were shuffled."""
    box = [(1000, -60), (1900, -60), (1900, 60), (1000, 60)]
    d = fitted(spark, box)
    assert "Window" not in d._jdf.queryExecution().analyzed().toString()
    r = d.first()
    # Steps are -150, -130, ... 150: the nearest to the middle are -10 and 10, and the first of equals wins.
    assert (r["step"], r["cx"], r["cy"], r["width"], r["depth"]) == (-10, 1440.0, 0.0, 900.0, 120.0)
    assert r["iou"] == pytest.approx(890 / 910, abs=1e-6)


def test_fit_of_a_ring_that_is_no_box(spark):
    r = fitted(spark, [(1000, -60), (1900, -60), (1900, 60), (1450, 60), (1450, 0), (1000, 0)]).first()
    assert r["step"] is not None and 0.7 < r["iou"] < 0.8

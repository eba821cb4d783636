"""Nearest points, bias, bases, metrics, quantities, short links, and the defaults of repair and merging."""

import random

from pyspark.sql import functions as F

from planlake.operators import merge as M
from planlake.operators import openings as O
from planlake.operators import quality as Q
from planlake.operators import repair as R
from planlake.operators import walls as W
from planlake.operators.spatial import nearest

from tests.test_hosts import RING, WALL, rect, ring

POINT = "plan_id long, det_id string, x double, y double"
DET = f"plan_id long, det_id string, kind string, points {RING}"


def test_nearest_at_any_distance(spark):
    rng = random.Random(11)
    spot = lambda: (rng.choice([0, 0, 1, 2]), rng.uniform(0, 50), rng.uniform(0, 50))
    left = [(p, f"l{i}", x, y) for i, (p, x, y) in enumerate(spot() for _ in range(150))] + [(0, "far", 9e6, -4e6), (3, "alone", 0.0, 0.0), (0, "null", None, 1.0), (0, "nan", float("nan"), 1.0), (0, "twice", 5.0, 5.0), (0, "twice", 5.0, 5.0)]
    right = [(p, f"r{i}", x, y) for i, (p, x, y) in enumerate(spot() for _ in range(30))] + [(4, "x", 0.0, 0.0), (0, "null", 0.0, None), (1, "tie b", 60.0, 60.0), (1, "tie a", 60.0, 60.0)]
    left.append((1, "tied", 60.0, 61.0))
    got = {(r["plan_id"], r["det_id"]): (r["other"], r["distance"]) for r in nearest(spark.createDataFrame(left, POINT), spark.createDataFrame(right, POINT), 2.0).collect()}
    want = {}
    for p, i, x, y in left:
        near = [(round(((x - u) ** 2 + (y - v) ** 2) ** 0.5 + 1e-9, 6), j) for q, j, u, v in right if q == p and None not in (x, y, u, v) and x == x]
        if near:
            want[p, i] = min(near)[::-1]
    assert got == want
    assert nearest(spark.createDataFrame(left, POINT), spark.createDataFrame([], POINT), 2.0).count() == 0


def test_fills_keep_plans_without_openings(spark):
    f = spark.createDataFrame([(1, "f", "DOOR", ring(*rect(0, 0, 2, 2, 0))), (2, "g", "DOOR", ring(*rect(0, 0, 2, 2, 0)))], DET)
    o = spark.createDataFrame([(1, "near", "DOOR", ring(*rect(30, 40, 2, 2, 0))), (1, "far", "DOOR", ring(*rect(9000, 0, 2, 2, 0)))], DET)
    got = {r["det_id"]: (r["opening_id"], r["distance"]) for r in O.fill_to_opening(f, o).collect()}
    assert got == {"f": ("near", 50.0), "g": (None, None)}


def test_bias_is_the_median_by_orientation(spark):
    w = spark.createDataFrame([(1, "h", 0.0, 0.0, 9000.0, 0.0, 200.0), (1, "v", 0.0, 0.0, 0.0, 9000.0, 200.0)], WALL)
    o = [(1, f"h{i}", "DOOR", ring(*rect(1000 * i, 0, 900, 200, 0))) for i in (1, 2, 3)] + [(1, f"v{i}", "DOOR", ring(*rect(0, 1000 * i, 200, 900, 0))) for i in (2, 3)]
    fit = [(1, f"h{i}", 1000.0 * i + d, 0.0) for i, d in ((1, 10.0), (2, -40.0), (3, 30.0))] + [(1, "v2", 0.0, 2020.0), (1, "v3", 0.0, 3060.0)]
    a = [(1, n, n[0]) for _, n, *_ in o]
    b = O.opening_bias(spark.createDataFrame(fit, "plan_id long, det_id string, cx double, cy double"), spark.createDataFrame(a, "plan_id long, det_id string, wall_id string"), spark.createDataFrame(o, DET), w)
    got = {r["det_id"]: (r["orientation"], r["bias"], r["cx"], r["cy"]) for r in b.collect()}
    assert got == {"h1": ("H", 10.0, 1000.0, 0.0), "h2": ("H", 10.0, 1950.0, 0.0), "h3": ("H", 10.0, 3020.0, 0.0), "v2": ("V", 40.0, 0.0, 1980.0), "v3": ("V", 40.0, 0.0, 3020.0)}


def test_bases_and_short_links(spark):
    axes = [(1, f"s{i}", 0.0, 0.0, 100.0, 100.0 if i else -100.0, 1.0) for i in range(2)] + [(1, f"f{i}", 0.0, 0.0, 100.0, 5.0, 1.0) for i in range(4)] + [(2, "u", 0.0, 0.0, 1.0, 50.0, 1.0), (2, "n", None, 0.0, 1.0, 50.0, 1.0)]
    got = {r["plan_id"]: tuple(r)[1:] for r in W.orientation_bases(spark.createDataFrame(axes, WALL)).collect()}
    assert got == {1: (4, 0, 2, True), 2: (0, 1, 0, False)}
    links = [(1, "a", 0.0, 0.0, 5000.0, 0.0, 1.0), (1, "link", 5050.0, 0.0, 5150.0, 0.0, 1.0), (1, "b", 5200.0, 0.0, 9000.0, 0.0, 1.0), (1, "stub", 9050.0, 0.0, 9190.0, 0.0, 1.0)]
    assert sorted(r["det_id"] for r in R.drop_short_links(spark.createDataFrame(links, WALL)).collect()) == ["a", "b", "stub"]


def test_merging_axes_whose_boxes_lie_apart(spark):
    """The middle of the shorter axis lies on the other's line, its box farther away than the offset."""
    a = [(1, "long", 2369.0, 598.0, 5654.0, 553.0, 240.0), (1, "short", 938.0, 604.0, 3158.0, 604.0, 115.0)]
    assert [(r["det_id"], r["n_merged"]) for r in W.merge_collinear(spark.createDataFrame(a, WALL)).collect()] == [("long", 2)]


def test_metrics_of_footprints(spark):
    foot = [ring(*rect(0, 0, 900, 200, 0.3)), ring((0, 0), (900, 0), (950, 200), (50, 200)), ring((0, 0), (900, 0), (900, 250), (0, 200)), ring((0, 0), (900, 0), (900, 200)), None]
    w = spark.createDataFrame([(1, str(i), "WALL", p) for i, p in enumerate(foot)], DET)
    rows = lambda n: spark.range(n).select(F.lit(1).cast("long").alias("plan_id"))
    assert tuple(Q.model_metrics(w, rows(3), rows(0), rows(2)).first()) == (1, 5, 1, 2, 3, 0, 2)
    q = spark.createDataFrame([(1, "a", "Length", 104.0), (1, "b", "Length", 106.0), (1, "b", "Width", 9.0), (1, "c", "Length", None)], "plan_id long, det_id string, name string, value double")
    a = spark.createDataFrame([(1, n, 0.0, 0.0, 60.0, 80.0, 1.0) for n in "abc"], WALL)
    assert [tuple(r) for r in Q.quantity_consistency(a, q).collect()] == [(1, "b", 106.0, 100.0)]


def test_rooms_of_merged_models(spark):
    """Two rooms side by side, 3.8 by 3.8 and 1.8 by 3.8 m, with five walls of 200; the middles of the long walls lie at the larger one only."""
    w = [("s", 0, 0, 6000, 0), ("n", 0, 4000, 6000, 4000), ("w", 0, -100, 0, 4100), ("m", 4000, 0, 4000, 4000), ("e", 6000, -100, 6000, 4100)]
    walls = spark.createDataFrame([(1, n, *map(float, a), 200.0) for n, *a in w], WALL)
    got = sorted((round(r["area"]), r["n_walls"], r["closed"]) for r in M.rooms_with_walls(walls).collect())
    assert got == [(1800 * 3800, 2, True), (3800 * 3800, 4, True)]


def test_repair_decides_by_hull_and_angles(spark):
    w = [("s", 0, 0, 6000, 0, 20), ("n", 0, 4000, 6000, 4000, 20), ("w", 0, 0, 0, 4000, 20), ("e", 6000, 0, 6000, 4000, 20), ("m", 3000, 1000, 3000, 3000, 20), ("d", 1000, 1000, 1900, 1880, 20)]
    walls = spark.createDataFrame([(1, n, *map(float, a)) for n, *a in w], WALL)
    out, placed = R.repair_axes(walls, spark.createDataFrame([], DET + ", confidence double"))
    got = {r["det_id"]: (r["thickness"], round(r["x2"] - r["x1"]), round(r["y2"] - r["y1"])) for r in out.collect()}
    # A wall at 45 degrees is one of six: not more than a sixth, so the others' bases decide and it stays as it is.
    assert {n: t for n, (t, *_) in got.items()} == {"s": 240.0, "n": 240.0, "w": 240.0, "e": 240.0, "m": 115.0, "d": 115.0}
    assert got["d"][1:] == (900, 880)
    two = walls.unionByName(walls.where("det_id = 'd'").withColumns({"det_id": F.lit("d2"), "y1": F.col("y1") + 900, "y2": F.col("y2") + 900}))
    turned = {r["det_id"]: abs(r["x2"] - r["x1"]) - abs(r["y2"] - r["y1"]) for r in R.repair_axes(two, spark.createDataFrame([], DET + ", confidence double"))[0].collect()}
    assert abs(turned["d"]) < 1e-6 and abs(turned["d2"]) < 1e-6


def test_scores_work_out_shapes_behind_the_join(spark):
    wall = "plan_id long, det_id string, x1 double, y1 double, x2 double, y2 double, thickness double"
    built = spark.createDataFrame([(1, "a", 0.0, 0.0, 1000.0, 0.0, 100.0)], wall)
    seen = built.select("plan_id", "det_id", F.expr("transform(array(array(0D, -50D), array(1000D, -50D), array(1000D, 50D), array(0D, 50D)), p -> struct(p[0] AS x, p[1] AS y))").alias("points"))
    found = W.wall_scores(built, seen)
    assert [(r["iou"], r["score"], r["status"]) for r in found.collect()] == [(1.0, 100.0, "PASS")]
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert "__rect" not in below and "__box" not in below


def test_repair_closes_gaps_of_exactly_the_reach(spark):
    walls = spark.createDataFrame([(1, "a", 40.0, 0.0, 40.0, 3300.0, 115.0), (1, "b", 140.0, 0.0, 3000.0, 0.0, 115.0)], WALL)
    out, _ = R.repair_axes(walls, spark.createDataFrame([], DET + ", confidence double"), F.lit(False))
    assert [(r["det_id"], round(r["x1"], 6), abs(round(r["y1"], 6))) for r in out.orderBy("det_id").collect()] == [("a", 90.0, 0.0), ("b", 90.0, 0.0)]


def test_links_between_ends_exactly_the_reach_apart_go(spark):
    boxes = {"a": ((0, 0), (80, 0), (80, 3300), (0, 3300)), "b": ((140, -40), (640, -40), (640, 40), (140, 40)), "c": ((700, -40), (3000, -40), (3000, 40), (700, 40))}
    d = spark.createDataFrame([(1, n, "WALL", ring(*p)) for n, p in boxes.items()], DET)
    assert sorted(r["det_id"] for r in R.wall_axes(d, 1500.0, merge=False).collect()) == ["a", "c"]


def test_the_wall_graph_reads_its_walls_once_beside_the_clusters(spark):
    from planlake.plans.queries import QUERIES

    plan = QUERIES["k01_wall_graph"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") > 0 and sum("Relation [" in line and "l_orderkey#" in line for line in plan.splitlines()) == 1

"""Planar subdivisions against values worked out by hand and against counted cells."""

import random

import pytest
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.operators.planar import regions
from planlake.operators.rooms import rooms
from planlake.operators.walls import merge_overlaps

WALL = "plan_id long, det_id string, x1 double, y1 double, x2 double, y2 double, thickness double, confidence double"
RING = "plan_id long, points array<struct<x double, y double>>"


def axes(spark, *lines, plan=1):
    return spark.createDataFrame([(plan, f"w{i:02}", *map(float, v), 0.9) for i, v in enumerate(lines)], WALL)


def rings(spark, *polygons):
    return spark.createDataFrame([(k, [dict(x=float(x), y=float(y)) for x, y in p]) for k, p in polygons], RING)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def square(spark, size, thickness=200, at=(0, 0)):
    """Four walls around a square whose inner side is ``size``."""
    (x, y), h, far = at, thickness / 2, size + thickness / 2
    return [(x - thickness, y - h, x + far + h, y - h, thickness), (x - thickness, y + far, x + far + h, y + far, thickness), (x - h, y - thickness, x - h, y + far + h, thickness), (x + far, y - thickness, x + far, y + far + h, thickness)]


def test_two_rooms(spark):
    # Fixture F1: four outer walls of 240 and one inner wall.
    w = axes(spark, (0, 120, 5000, 120, 240), (120, 0, 120, 5000, 240), (4880, 0, 4880, 5000, 240), (0, 4880, 5000, 4880, 240), (2620, 0, 2620, 5000, 240))
    got = sorted(rooms(w).collect(), key=lambda r: r["area_m2"])
    assert [r["area_m2"] for r in got] == pytest.approx([9.1304, 10.2152], abs=1e-9)
    assert sorted((p["x"], p["y"]) for p in got[1]["points"]) == [(240, 240), (240, 4760), (2500, 240), (2500, 4760)]


def test_slanted_room(spark):
    # A square of 3000 turned by a (3, 4, 5) triangle: walls of 200 around it.
    turned = [tuple(c for x, y in ((a, b), (c, d)) for c in (0.6 * x - 0.8 * y, 0.8 * x + 0.6 * y)) + (t,) for a, b, c, d, t in square(spark, 3000)]
    got = rooms(axes(spark, *turned)).collect()
    assert [r["area_m2"] for r in got] == pytest.approx([9.0], abs=1e-6) and len(got[0]["points"]) == 4


def test_nested_rooms_and_open_ends(spark):
    outer, inner = square(spark, 6000), square(spark, 1000, at=(2000, 2000))
    spur = [(0, 5000, 1000, 5000, 100)]
    w = axes(spark, *outer, *inner, *spur)
    got = sorted(rooms(w).collect(), key=lambda r: r["area_m2"])
    assert [r["area_m2"] for r in got] == pytest.approx([1.0, 36.0 - 1.4**2 - 0.1], abs=1e-9) and [r["n_holes"] for r in got] == [0, 1]
    # A wall is missing: no room. Walls of another plan close nothing.
    assert rooms(axes(spark, *outer[:3]).union(axes(spark, outer[3], plan=2))).count() == 0
    assert rooms(w.where("false")).count() == 0 and rooms(axes(spark, (1, 1, 1, 1, 9))).count() == 0


def test_regions_against_cells(spark):
    """Random boxes on whole numbers: covered and free bounded areas as counted in unit cells."""
    r = random.Random(3)
    plans = {}
    for plan in range(12):
        for _ in range(r.randint(2, 14)):
            x, y = r.randint(0, 30), r.randint(0, 30)
            plans.setdefault(plan, []).append((x, y, x + r.randint(1, 14), y + r.randint(1, 5)) if r.random() < 0.5 else (x, y, x + r.randint(1, 5), y + r.randint(1, 14)))
    got = {}
    for row in regions(rings(spark, *[(k, box(*b)) for k, bs in plans.items() for b in bs]), cell=10.0).collect():
        got.setdefault((row["plan_id"], row["covered"]), []).append(round(row["area"], 6))
    for plan, boxes in plans.items():
        covered = {(x, y) for a, b, c, d in boxes for x in range(a, c) for y in range(b, d)}
        outside, stack = set(), [(-1, -1)]
        while stack:
            x, y = stack.pop()
            if (x, y) not in outside and (x, y) not in covered and -2 < x < 47 and -2 < y < 47:
                outside.add((x, y))
                stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        free = {(x, y) for x in range(46) for y in range(46)} - covered - outside
        assert sum(got.get((plan, True), [])) == len(covered)
        assert sum(got.get((plan, False), [])) == len(free)


def test_merged_outlines(spark):
    # Inclusion and exclusion: two walls on one line; one that stands apart, and one that meets them in a T only.
    w = axes(spark, (0, 0, 3000, 0, 200), (2800, 20, 5800, 20, 200), (9000, 0, 9000, 3000, 100), (1500, 0, 1500, 3000, 100))
    got = {r["component"]: r for r in merge_overlaps(w).collect()}
    assert set(got) == {"w00", "w02", "w03"} and got["w00"]["n_walls"] == 2 and got["w02"]["n_walls"] == 1
    assert got["w00"]["area"] == pytest.approx(2 * 3000 * 200 - 200 * 180, abs=1e-3) and len(got["w00"]["points"]) == 8


def test_merged_outline_area_at_an_angle(spark):
    turn = lambda x, y: (0.8 * x - 0.6 * y, 0.6 * x + 0.8 * y)
    w = axes(spark, *[(*turn(a, b), *turn(c, d), t) for a, b, c, d, t in ((0, 0, 3000, 0, 200), (2800, 20, 5800, 20, 200), (5600, -30, 9100, -30, 120))])
    (row,) = merge_overlaps(w).collect()
    assert row["n_walls"] == 3 and row["area"] == pytest.approx(2 * 3000 * 200 - 200 * 180 + 3500 * 120 - 200 * 110, abs=10)
    area = spark.createDataFrame([row]).select(G.polygon_area(F.col("points")).alias("a")).first()["a"]
    assert area == pytest.approx(row["area"], abs=20)


def test_collinear_axes_merge_across_any_bin_edge(spark):
    from planlake.operators.walls import merge_collinear

    turn = lambda x, y: (0.8 * x - 0.6 * y, 0.6 * x + 0.8 * y)
    lines = [(0, 99.5, 1000, 99.5, 100), (900, 100.5, 3000, 100.5, 200), (3004, 100, 4000, 100, 100), (4200, 100, 5000, 100, 100), (0, 120, 1000, 120, 100), (0, 0, 40, 0, 100)]
    w = axes(spark, *[(*turn(a, b), *turn(c, d), t) for a, b, c, d, t in lines])
    got = {r["det_id"]: r for r in merge_collinear(w.union(w)).collect()}
    assert {k: r["n_merged"] for k, r in got.items()} == {"w00": 3, "w03": 1, "w04": 1}
    r = got["w00"]
    assert (r["x2"] - r["x1"]) ** 2 + (r["y2"] - r["y1"]) ** 2 == pytest.approx(4000.0**2)
    assert r["thickness"] == pytest.approx((1000 * 100 + 2100 * 200 + 996 * 100) / 4096)


def test_hull_and_perimeter(spark):
    from planlake.operators.hull import hulls, perimeter_external

    r = random.Random(6)
    clouds = {k: [(float(r.randint(0, 30)), float(r.randint(0, 30))) for _ in range(r.randint(1, 40))] for k in range(20)} | {20: [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], 21: [(4.0, 5.0)], 22: [(0.0, 0.0), (0.0, 9.0)]}
    p = spark.createDataFrame([(k, *q) for k, c in clouds.items() for q in c], "plan_id long, x double, y double")
    for row in hulls(p).collect():
        c, ring = set(clouds[row["plan_id"]]), [(q["x"], q["y"]) for q in row["points"]]
        turn = lambda a, b, q: (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0])
        assert set(ring) <= c and len(set(ring)) == len(ring) == row["corners"]
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            assert all(turn(a, b, q) >= 0 for q in c)
        if len(ring) > 2:
            assert all(turn(a, b, q) > 0 for a, b, q in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2], strict=True))
    w = axes(spark, (0, 0, 5000, 0, 100), (5000, 0, 2500, 4000, 100), (2500, 4000, 0, 0, 100), (2400, 1500, 2600, 1500, 100), (2400, 1400, 2600, 1400, 240))
    assert {r["det_id"]: r["external"] for r in perimeter_external(w).collect()} == {"w00": True, "w01": True, "w02": True, "w03": False, "w04": True}


def test_axes_turn_to_lines_at_any_distance(spark):
    from planlake.operators.walls import gap_classes, refine_axes

    a, lines = axes(spark, (0, 0, 1000, 20, 100), (0, 9000, 10, 9900, 100)), axes(spark, (60000, 0, 61000, 0, 100), (0, 700, 1000, 700, 100))
    got = {r["det_id"]: r for r in refine_axes(a, lines).collect()}
    assert set(got) == {"w00"} and got["w00"]["line_id"] == "w01" and got["w00"]["y1"] == got["w00"]["y2"] == pytest.approx(10.0)
    got = refine_axes(a, lines.where("x1 > 1")).collect()
    assert [r["line_id"] for r in got] == ["w00"] and got[0]["score"] > 60000
    assert [tuple(r) for r in gap_classes(axes(spark, (0, 0, 100, 0, 1), (130, 0, 500, 0, 1), (580, 0, 900, 0, 1), (5000, 0, 6000, 0, 1))).collect()] == [(1, 1, 1, 4)]


def test_rings_of_any_number_of_corners(spark):
    """Compiled tests of four corners say what ``geom.contains`` says; other rings still go that way."""
    from planlake.operators.rings import corners, four_corners, in_four

    r = random.Random(9)
    four = [(i, [dict(x=float(r.randint(0, 9)), y=float(r.randint(0, 9))) for _ in range(4)], r.uniform(0, 9), float(r.randint(0, 9))) for i in range(300)]
    d = corners(spark.createDataFrame(four, "i long, points array<struct<x double, y double>>, px double, py double"), "points", "__s")
    px, py = F.col("px"), F.col("py")
    got = d.select(four_corners(F.col("points"), "__s").alias("four"), in_four("__s", px, py).alias("a"), G.contains(F.col("points"), px, py).alias("b")).collect()
    assert all(v["four"] and v["a"] == v["b"] for v in got) and {v["a"] for v in got} == {True, False}
    house = [(0, 0), (10, 0), (10, 10), (5, 15), (0, 10)]
    assert [round(v["area"], 6) for v in regions(rings(spark, (1, house), (1, box(8, 0, 20, 10)), (2, [(0, 0), (4, 0), (0, 3)]))).orderBy("plan_id").collect()] == [225.0, 6.0]

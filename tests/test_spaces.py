"""Spaces against walls, openings and each other: shapes of any kind against brute force, rules against values by hand."""

import math
import random

from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.operators import spaces as S

from tests.test_hosts import RING, WALL, clipped, rect, ring

SPACE = f"plan_id long, det_id string, points {RING}"


def area(p):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True))) / 2 if p else 0.0


def star(rng, cx, cy):
    """A ring with dents that doesn't cross itself: no two neighbours are half a turn apart."""
    n = rng.randint(5, 9)
    turns = [2 * math.pi * (i + rng.uniform(0, 0.8)) / n for i in range(n)]
    return [(cx + r * math.cos(t), cy + r * math.sin(t)) for t in turns for r in [rng.uniform(0.5, 4)]]


def inside(p, x, y):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True)) % 2 == 1


def test_shared_area_of_any_shapes(spark):
    rng = random.Random(4)
    convex = [(rect(rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(1, 6), rng.uniform(1, 4), rng.uniform(0, 3)), rect(3, 3, rng.uniform(1, 6), 2, rng.uniform(0, 3))) for _ in range(100)]
    stars = [(star(rng, 3, 3), star(rng, rng.uniform(2, 5), 4)[::-1]) for _ in range(12)]
    d = spark.createDataFrame([(i, ring(*a), ring(*b)) for i, (a, b) in enumerate(convex + stars)], f"i int, a {RING}, b {RING}")
    got = [r["m"] for r in d.orderBy("i").select(G.overlap_area(F.col("a"), F.col("b")).alias("m")).collect()]
    assert all(math.isclose(m, area(clipped(a, b)), abs_tol=1e-9) for m, (a, b) in zip(got, convex))
    # Rings with dents against counted points of a fine lattice.
    step = 0.05
    for m, (a, b) in zip(got[100:], stars, strict=True):
        cells = [(-2 + step * i, -2 + step * j) for i in range(240) for j in range(240)]
        assert abs(m - step * step * sum(inside(a, x, y) and inside(b, x, y) for x, y in cells)) < 0.25
    one = spark.createDataFrame([(ring((0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (0, 2)), ring((1, 1), (3, 1), (3, 3), (1, 3)))], f"a {RING}, b {RING}")
    assert one.select(G.overlap_area(F.col("a"), F.col("b"))).first()[0] == 3.0
    assert one.select(G.overlap_area(F.col("a"), F.col("a"))).first()[0] == 12.0


def test_distance_of_rings(spark):
    cases = [
        (rect(0, 0, 2, 2, 0), rect(5, 0, 2, 2, 0), 3.0),
        (rect(0, 0, 2, 2, 0), rect(0, 0, 1, 1, 0.5), 0.0),
        (rect(0, 0, 10, 1, 0), rect(0, 0, 1, 10, 0), 0.0),
        (rect(0, 0, 2, 2, 0), rect(1 + math.sqrt(2) + 0.5, 0, 2, 2, math.pi / 4), 0.5),
        ([(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)], rect(3, 4, 1, 1, 0), 0.5),
    ]
    d = spark.createDataFrame([(i, ring(*a), ring(*b)) for i, (a, b, _) in enumerate(cases)], f"i int, a {RING}, b {RING}")
    got = [r["m"] for r in d.orderBy("i").select(G.rings_distance(F.col("a"), F.col("b")).alias("m")).collect()]
    assert all(math.isclose(m, want, abs_tol=1e-9) for m, (*_, want) in zip(got, cases, strict=True))


def test_contacts_of_slanted_walls(spark):
    s = math.sqrt(0.5)
    w = [(1, "a", 0.0, 0.0, 3000.0, 0.0, 200.0), (1, "b", 3000.4, 0.0, 6000.0, 0.0, 200.0), (1, "c", 0.0, 100.0, 2000 * s, 100 + 2000 * s, 100.0), (1, "d", 0.0, 101.0, 0.0, 900.0, 10.0), (1, "flat", 5.0, 5.0, 5.0, 5.0, 9.0), (1, "none", None, 0.0, 1.0, 1.0, 1.0), (2, "z", 0.0, 0.0, 1.0, 0.0, 1.0)]
    got = {(r["a_id"], r["b_id"]): (r["contact"], r["distance"]) for r in S.contact_proposals(spark.createDataFrame(w, WALL)).collect()}
    assert got == {("a", "b"): ("gap", 0.4), ("a", "c"): ("touch", 0.0), ("c", "d"): ("touch", 0.0)}


def test_boundaries_by_every_rule(spark):
    rooms = [(1, "l", ring((0, 0), (4000, 0), (4000, 2000), (2000, 2000), (2000, 4000), (0, 4000))), (1, "line", ring((0, 0), (1, 1))), (1, "none", None)]
    w = [
        (1, "meets", -500.0, 1000.0, 500.0, 1000.0, 100.0),
        (1, "inside", 900.0, 900.0, 1100.0, 900.0, 100.0),
        (1, "near", 4150.0, 0.0, 4150.0, 2000.0, 100.0),
        (1, "far", 4151.0, 0.0, 4151.0, 2000.0, 100.0),
        (1, "thick", 4500.0, 500.0, 9000.0, 500.0, 600.0),
        (1, "thick touch", 9000.0, 2650.0, 3999.0, 2650.0, 1300.0),
        (1, "notch", 3000.0, 3000.0, 3500.0, 3500.0, 100.0),
        (1, "unknown", 4250.0, 0.0, 4250.0, 9.0, None),
        (2, "other plan", 0.0, 0.0, 9.0, 9.0, 1.0),
    ]
    o = [(1, "door", ring(*rect(4100, 900, 100, 900, 0)), "DOOR"), (1, "window", ring(*rect(3000, 3000, 100, 100, 0)), "WINDOW")]
    spaces, walls, openings = spark.createDataFrame(rooms, SPACE), spark.createDataFrame(w, WALL), spark.createDataFrame(o, SPACE + ", kind string")
    got = {r["element_id"]: r["how"] for r in S.space_boundaries(spaces, walls, openings).where("space_id = 'l'").collect()}
    assert got == {"meets": "meets", "inside": "near", "near": "near", "thick": "end", "thick touch": "end", "unknown": "near", "door": "opening"}
    assert S.space_boundaries(spaces, walls).where("space_id <> 'l'").count() == 0
    assert S.space_boundaries(spaces.limit(0), walls, openings).count() == 0
    # A thick wall whose ends lie far off is found by its rectangle alone.
    long = spark.createDataFrame([(1, "slab", -9000.0, -450.0, 9000.0, -450.0, 899.9)], WALL)
    assert [r["how"] for r in S.space_boundaries(spaces, long).collect()] == ["touches"]


def test_spaces_that_both_walls_bound(spark):
    c = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (1, "b", "c")], "plan_id long, a_id string, b_id string")
    b = spark.createDataFrame([(1, "r", "a"), (1, "r", "b"), (1, "s", "a"), (1, "s", "b"), (1, "s", "b"), (1, "t", "c"), (2, "r", "c")], "plan_id long, space_id string, element_id string")
    assert [tuple(r) for r in S.shared_spaces(c, b).collect()] == [(1, "a", "b", 2)]


def test_overlaps_and_openings_inside_walls(spark):
    sp = [(1, "a", ring((0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (0, 2))), (1, "b", ring((1, 1), (3, 1), (3, 3), (1, 3))), (1, "c", ring((0, 2), (2, 2), (2, 4), (0, 4))), (2, "d", ring((0, 0), (9, 0), (9, 9)))]
    got = {(r["a_id"], r["b_id"]): r["shared"] for r in S.space_overlaps(spark.createDataFrame(sp, SPACE)).collect()}
    assert got == {("a", "b"): 3.0, ("b", "c"): 1.0}
    s = math.sqrt(0.5)
    w = spark.createDataFrame([(1, "w", 0.0, 0.0, 1000 * s, 1000 * s, 100.0)], WALL)
    o = spark.createDataFrame([(1, "in", ring(*rect(300, 300, 200, 80, math.pi / 4))), (1, "half", ring(*rect(1000 * s, 1000 * s, 200, 80, math.pi / 4))), (1, "out", ring(*rect(900, 0, 10, 10, 0)))], SPACE)
    h = spark.createDataFrame([(1, n, "w") for n in ("in", "half", "out")] + [(1, "lost", None)], "plan_id long, det_id string, wall_id string")
    got = {r["det_id"]: (round(r["inside_area"], 6), round(r["outside_area"], 6), round(r["inside_ratio"], 6)) for r in S.opening_inside_ratio(o, h, w).collect()}
    assert got == {"in": (16000.0, 0.0, 1.0), "half": (8000.0, 8000.0, 0.5), "out": (0.0, 100.0, 0.0)}


def test_a_table_paired_with_itself_is_shuffled_once(spark):
    walls = spark.createDataFrame([(1, c, 10.0 * i, 0.0, 10.0 * i, 90.0, 4.0) for i, c in enumerate("abcdef")], WALL)
    found = S.contact_proposals(walls, 20.0)
    assert {(r["a_id"], r["b_id"]) for r in found.collect()} >= {("a", "b"), ("e", "f")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_contacts_at_spaces_are_those_of_all_contacts_and_boundaries(spark):
    rng = random.Random(5)
    spaces = spark.createDataFrame([(k % 3, f"s{k}", ring(*rect(rng.uniform(0, 9000), rng.uniform(0, 9000), 3000, 2000, rng.uniform(0, 3)))) for k in range(30)], SPACE)
    walls = [(k % 3, f"w{k}", *(rng.uniform(0, 9000) for _ in range(4)), rng.choice([None, 80.0, 300.0])) for k in range(90)]
    walls = spark.createDataFrame([*walls, (0, "none", 5.0, 5.0, 5.0, 5.0, 80.0), (None, "w", 0.0, 0.0, 9000.0, 0.0, 80.0)], WALL)
    want = S.shared_spaces(S.contact_proposals(walls, 20.0), S.space_boundaries(spaces, walls))
    rows = lambda df: sorted(tuple(r) for r in df.select("plan_id", "a_id", "b_id", "n_spaces").collect())
    assert rows(want) and rows(S.contacts_at_spaces(spaces, walls, 20.0)) == rows(want)

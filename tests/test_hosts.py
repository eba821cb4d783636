"""Host walls of openings and walls of rooms, at any angle."""

import math
import random

from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.operators.openings import host_wall
from planlake.operators.rooms import room_walls

RING = "array<struct<x: double, y: double>>"
WALL = "plan_id long, det_id string, x1 double, y1 double, x2 double, y2 double, thickness double"


def ring(*points):
    return [dict(x=float(x), y=float(y)) for x, y in points]


def rect(cx, cy, w, d, turn):
    u, v = (math.cos(turn), math.sin(turn)), (-math.sin(turn), math.cos(turn))
    return [(cx + a * w / 2 * u[0] + b * d / 2 * v[0], cy + a * w / 2 * u[1] + b * d / 2 * v[1]) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def clipped(subject, other):
    """What of one convex ring lies in another that turns left."""
    for (ax, ay), (bx, by) in zip(other, other[1:] + other[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        out = []
        for p, q in zip(subject, subject[1:] + subject[:1], strict=True):
            if side(p) >= 0:
                out.append(p)
            if side(p) * side(q) < 0:
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        subject = out
        if not subject:
            return []
    return subject


def test_convex_rings_meet_where_clipping_leaves_something(spark):
    rng = random.Random(8)
    one = lambda: rect(rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0.5, 6), rng.uniform(0.5, 3), rng.uniform(0, 3))
    pairs = [(one(), one()) for _ in range(200)] + [(rect(0, 0, 2, 2, 0), rect(2, 0, 2, 2, 0)), (rect(0, 0, 2, 2, 0), rect(2.001, 0, 2, 2, 0))]
    d = spark.createDataFrame([(i, ring(*a), ring(*b)) for i, (a, b) in enumerate(pairs)], f"i int, a {RING}, b {RING}")
    got = [r["m"] for r in d.orderBy("i").select(G.convex_meets(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [bool(clipped(a, b)) for a, b in pairs[:200]] + [True, False]
    assert 40 < sum(got[:200]) < 180


def test_host_by_centre_before_host_by_meeting(spark):
    s = math.sqrt(0.5)
    walls = [(1, "a", 0.0, 0.0, 3000.0, 0.0, 200.0), (1, "b", 0.0, 0.0, 4000 * s, 4000 * s, 200.0), (2, "c", 0.0, 0.0, 9.0, 0.0, 2.0), (1, "n", None, 0.0, 1.0, 1.0, 5.0)]
    openings = [
        (1, "both", ring(*rect(1500, 0, 400, 900, 0))),
        (1, "slanted", ring(*rect(2000, 2000, 600, 100, math.pi / 4))),
        (1, "touching", ring(*rect(2000, -200, 300, 200, 0))),
        (1, "beside", ring(*rect(3000, 500, 300, 200, 0))),
        (2, "elsewhere", ring(*rect(1500, 0, 10, 10, 0))),
    ]
    w, o = spark.createDataFrame(walls, WALL), spark.createDataFrame(openings, f"plan_id long, det_id string, points {RING}")
    got = {r["det_id"]: (r["wall_id"], r["holds_centre"]) for r in host_wall(o, w).collect()}
    assert got == {"both": ("a", True), "slanted": ("b", True), "touching": ("a", False)}


def test_walls_of_an_l_shaped_room(spark):
    room = [(1, "r", ring((0, 0), (4000, 0), (4000, 2000), (2000, 2000), (2000, 4000), (0, 4000))), (1, "line", ring((0, 0), (1, 1)))]
    at = {"inside": (1000, 1000), "edge": (4200, 1000), "far": (4300, 1000), "notch": (2500, 2500), "near notch": (2100, 3000), "corner": (-200, -200), "off corner": (-250, -250)}
    walls = [(1, n, x - 30.0, y - 40.0, x + 30.0, y + 40.0, 100.0) for n, (x, y) in at.items()] + [(2, "other", 0.0, 0.0, 9.0, 9.0, 1.0)]
    got = room_walls(spark.createDataFrame(room, f"plan_id long, det_id string, points {RING}"), spark.createDataFrame(walls, WALL)).collect()
    assert sorted(r["wall_id"] for r in got) == ["corner", "edge", "inside", "near notch"]

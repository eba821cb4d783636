"""Queries of the joins (C rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.operators.graph import components
from planlake.operators.hull import perimeter_external
from planlake.operators.rooms import room_walls
from planlake.operators.spatial import CELL, grid_join, renamed, self_pairs
from planlake.operators import openings as O
from planlake.operators import spaces as SP
from planlake.operators import walls as W
from planlake.plans.demo import CTE, TILT, axis_walls, detections, openings, rect_openings, tilted_walls, walls
from planlake.plans.registry import SQL, query, r6, s6
from planlake.plans.scalar_queries import seg
from planlake.session import materialize

BOX = ("x0", "y0", "bx", "by_")
AXIS = ["ax1", "ay1", "ax2", "ay2", "thk", "len", "horizontal", "confidence"]


def gap(a: str, b: str) -> str:
    """SQL: least distance between the ends of two axes."""
    d = ", ".join(f"sqrt(({a}.ax{i} - {b}.ax{j}) * ({a}.ax{i} - {b}.ax{j}) + ({a}.ay{i} - {b}.ay{j}) * ({a}.ay{i} - {b}.ay{j}))" for i in (1, 2) for j in (1, 2))
    return f"least({d})"


def end_gap():
    return F.least(*[G.hypot(F.col(f"a_ax{i}") - F.col(f"b_ax{j}"), F.col(f"a_ay{i}") - F.col(f"b_ay{j}")) for i in (1, 2) for j in (1, 2)])


def shifted(w, d: float):
    """Tilted walls as another model sees them: moved to their left."""
    return w.withColumns({"x1": F.col("x1") - d * F.col("uy"), "y1": F.col("y1") + d * F.col("ux"), "x2": F.col("x2") - d * F.col("uy"), "y2": F.col("y2") + d * F.col("ux")})


def wall_pairs(spark, sf, reach):
    return self_pairs(walls(spark, sf), ("ax1", "ay1", "ax2", "ay2"), AXIS, reach)


PAIR = CTE + " SELECT a.plan_id, a.det_id AS a_det_id, b.det_id AS b_det_id{cols} FROM wall a JOIN wall b ON a.plan_id = b.plan_id AND a.det_id < b.det_id WHERE {cond}"
IDS = ("plan_id", "a_det_id", "b_det_id")

ZONES = (("west", ((0.0, 0.0), (1500.0, 0.0), (1500.0, 6000.0), (0.0, 6000.0))), ("tri", ((0.0, 0.0), (6000.0, 0.0), (0.0, 6000.0))))


def turn(a: str, b: str) -> str:
    """SQL: degrees between two axes, 0..90."""
    d = f"abs(degrees(atan2({a}.y2 - {a}.y1, {a}.x2 - {a}.x1)) - degrees(atan2({b}.y2 - {b}.y1, {b}.x2 - {b}.x1)))"
    return f"least({d}, 180 - {d})"


def mid_line(a: str, b: str) -> str:
    """SQL: distance of a's middle to b's endless line."""
    return f"abs((({a}.x1 + {a}.x2) / 2 - {b}.x1) * ({b}.y2 - {b}.y1) - (({a}.y1 + {a}.y2) / 2 - {b}.y1) * ({b}.x2 - {b}.x1)) / sqrt(({b}.x2 - {b}.x1) ** 2 + ({b}.y2 - {b}.y1) ** 2)"


MIDS = "sqrt(((a.x1 + a.x2 - b.x1 - b.x2) / 2) ** 2 + ((a.y1 + a.y2 - b.y1 - b.y2) / 2) ** 2)"
TPAIR = TILT + " SELECT a.plan_id, a.det_id AS a_det_id, b.det_id AS b_det_id{cols} FROM tw a JOIN tw b ON a.plan_id = b.plan_id AND a.det_id < b.det_id WHERE {cond}"


def cross(p: str, q: str, r: str) -> str:
    return f"({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]})"


def segments(a: str, b: str) -> str:
    """SQL: distance of two axes, 0 where they cross."""
    ends = lambda t: ((f"{t}.x1", f"{t}.y1"), (f"{t}.x2", f"{t}.y2"))
    (p, q), (u, v) = ends(a), ends(b)
    off = [seg(*e, *u, *v) for e in (p, q)] + [seg(*e, *p, *q) for e in (u, v)]
    meets = f"({cross(p, q, u)}) * ({cross(p, q, v)}) < 0 AND ({cross(u, v, p)}) * ({cross(u, v, q)}) < 0"
    return f"CASE WHEN {meets} THEN 0e0 ELSE least({', '.join(off)}) END"


@query("c01_zone_counts", f"{CTE}, z AS (SELECT det.*, (x0 + bx) / 2 AS cx, (y0 + by_) / 2 AS cy FROM det) SELECT 'west' AS zone, label, count(*) AS n FROM z WHERE cx > 0 AND cx < 1500 AND cy > 0 AND cy < 6000 GROUP BY label UNION ALL SELECT 'tri', label, count(*) FROM z WHERE cx > 0 AND cy > 0 AND cx + cy < 6000 GROUP BY label")
def c01(spark, sf):
    """Box centre strictly inside; the zones are a small table, broadcast."""
    zones = spark.createDataFrame([(n, [dict(x=x, y=y) for x, y in p]) for n, p in ZONES], "zone string, ring array<struct<x double, y double>>").where(F.size("ring") >= 3)
    d = detections(spark, sf).withColumn("cx", (F.col("x0") + F.col("bx")) / 2).withColumn("cy", (F.col("y0") + F.col("by_")) / 2)
    return d.join(F.broadcast(zones), G.contains(F.col("ring"), F.col("cx"), F.col("cy"))).groupBy("zone", "label").agg(F.count("*").alias("n"))


@query("c02_line_counts", f"{CTE}, s AS (SELECT label, (x0 + bx) / 2 - (y0 + by_) / 2 AS v FROM det) SELECT label, count(*) FILTER (WHERE v < -1e-6) AS positive, count(*) FILTER (WHERE v > 1e-6) AS negative, count(*) FILTER (WHERE abs(v) <= 1e-6) AS on_line FROM s GROUP BY label")
def c02(spark, sf):
    """Side of the line from (0, 0) to (1, 1) by the sign of the cross product."""
    lines = spark.createDataFrame([("diagonal", 0.0, 0.0, 1.0, 1.0)], "line string, lx1 double, ly1 double, lx2 double, ly2 double")
    d = detections(spark, sf).join(F.broadcast(lines), F.lit(True))
    cx, cy = (F.col("x0") + F.col("bx")) / 2, (F.col("y0") + F.col("by_")) / 2
    side = (F.col("lx2") - F.col("lx1")) * (cy - F.col("ly1")) - (F.col("ly2") - F.col("ly1")) * (cx - F.col("lx1"))
    d = d.withColumn("side", side)
    return d.groupBy("label").agg(F.count_if(F.col("side") > 1e-6).alias("positive"), F.count_if(F.col("side") < -1e-6).alias("negative"), F.count_if(F.abs("side") <= 1e-6).alias("on_line"))


def opening_sides(spark, sf):
    o = openings(spark, sf).withColumn("cx", (F.col("x0") + F.col("bx")) / 2).withColumn("cy", (F.col("y0") + F.col("by_")) / 2)
    return renamed(o, "o_", ["det_id", "cx", "cy", "horizontal", "confidence", "x0", "y0", "bx", "by_", "thk", "len"]), renamed(walls(spark, sf), "w_", ["det_id", *AXIS, *BOX])


def near_walls(spark, sf, reach, cell=CELL):
    o, w = opening_sides(spark, sf)
    pairs = grid_join(o, w, ("o_cx", "o_cy", "o_cx", "o_cy"), ("w_ax1", "w_ay1", "w_ax2", "w_ay2"), reach, cell)
    p = G.project_on_line(*[F.col(c) for c in ("o_cx", "o_cy", "w_ax1", "w_ay1", "w_ax2", "w_ay2")])
    return o, pairs.withColumn("p", p).withColumn("distance", r6(F.col("p.distance"))).where(F.col("distance") <= reach)


def nearest_walls(spark, sf, reach):
    """Openings, and each one's nearest wall of its plan at any distance; ties by wall id.

    Openings that the grid leaves without a hit within ``reach`` meet all walls of their plan; each task keeps one row of an opening.
    """
    o, pairs = near_walls(spark, sf, reach, reach)
    match = F.min(F.struct("distance", "w_det_id", "w_thk")).alias("m")
    near = materialize(pairs.groupBy("plan_id", "o_det_id").agg(match), "near-walls")
    left = o.join(near, ["plan_id", "o_det_id"], "left_anti")
    p = G.project_on_line(*[F.col(c) for c in ("o_cx", "o_cy", "w_ax1", "w_ay1", "w_ax2", "w_ay2")])
    far = left.join(opening_sides(spark, sf)[1], "plan_id").withColumn("distance", r6(p["distance"])).where("distance IS NOT NULL")
    return o, near.unionByName(far.groupBy("plan_id", "o_det_id").agg(match)).select("plan_id", "o_det_id", "m.*")


OW = CTE + ", o AS (SELECT *, (x0 + bx) / 2 AS cx, (y0 + by_) / 2 AS cy FROM opening), ow AS (SELECT o.plan_id, o.det_id, w.det_id AS wall_id, o.horizontal AS oh, w.horizontal AS wh, o.confidence, o.len AS o_len, o.thk AS o_thk, w.thk AS w_thk, {d} AS distance, {s} AS s FROM o JOIN wall w ON o.plan_id = w.plan_id)".format(d=s6(seg("cx", "cy", "w.ax1", "w.ay1", "w.ax2", "w.ay2")), s="least(1, greatest(0, ((cx - w.ax1) * (w.ax2 - w.ax1) + (cy - w.ay1) * (w.ay2 - w.ay1)) / ((w.ax2 - w.ax1) ** 2 + (w.ay2 - w.ay1) ** 2)))")


def nearest_sql(cond: str, order: str, cols: str = ", r.distance") -> str:
    return f"{OW}, r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, det_id ORDER BY {order}, wall_id) AS k FROM ow WHERE {cond}) SELECT DISTINCT o.plan_id, o.det_id, r.wall_id{cols} FROM o LEFT JOIN r ON o.plan_id = r.plan_id AND o.det_id = r.det_id AND k = 1"


def measured(name: str, source: str) -> str:
    """SQL: CTE ``name`` of openings against tilted walls: place along and across the axis, distances to the axis and to the wall's rectangle."""
    return f"""{name}0 AS (SELECT o.*, w.det_id AS wall_id, w.thickness, w.length, w.x1, w.y1, w.x2, w.y2, (cx - w.x1) * w.ux + (cy - w.y1) * w.uy AS along, (cy - w.y1) * w.ux - (cx - w.x1) * w.uy AS across,
    degrees(atan2(w.uy, w.ux)) AS wall_angle, w.ux, w.uy FROM {source} o JOIN tw w ON o.plan_id = w.plan_id),
{name}1 AS (SELECT *, greatest(0, -along, along - length) AS beyond, greatest(0, abs(across) - thickness / 2) AS beside, least(abs(CASE WHEN horizontal THEN 0 ELSE 90 END - wall_angle), 180 - abs(CASE WHEN horizontal THEN 0 ELSE 90 END - wall_angle)) AS turned FROM {name}0),
{name} AS (SELECT *, least(1, greatest(0, along / length)) AS s, round(sqrt(beyond ** 2 + across ** 2) + 1e-9, 6) AS axis_distance, round(sqrt(beyond ** 2 + beside ** 2) + 1e-9, 6) AS wall_distance FROM {name}1)"""


OT = f"{TILT}, {measured('m', 'op')}," + """
near AS (SELECT *, row_number() OVER (PARTITION BY plan_id, det_id ORDER BY axis_distance, wall_distance, turned, wall_id) AS k FROM m WHERE axis_distance <= 500 AND turned <= 30),
far AS (SELECT *, row_number() OVER (PARTITION BY plan_id, det_id ORDER BY wall_distance, wall_id) AS k FROM m),
hit AS (SELECT DISTINCT o.plan_id, o.det_id, coalesce(n.wall_id, f.wall_id) AS wall_id, n.axis_distance, coalesce(n.wall_distance, f.wall_distance) AS wall_distance, n.turned AS degrees
    FROM op o LEFT JOIN near n ON o.plan_id = n.plan_id AND o.det_id = n.det_id AND n.k = 1 LEFT JOIN far f ON o.plan_id = f.plan_id AND o.det_id = f.det_id AND f.k = 1),
hm AS (SELECT DISTINCT m.* FROM m JOIN hit USING (plan_id, det_id, wall_id))"""


def assigned(spark, sf):
    return O.assign_openings(rect_openings(spark, sf), tilted_walls(spark, sf))


def with_nearest(o, best, *cols):
    """All openings once, with their match's columns or nulls."""
    b = best.select("plan_id", F.col("o_det_id").alias("det_id"), *cols)
    return o.select("plan_id", F.col("o_det_id").alias("det_id")).distinct().join(b, ["plan_id", "det_id"], "left")


@query("c03_assign_openings", f"{OT} SELECT plan_id, det_id, wall_id, axis_distance, wall_distance, {s6('degrees')} AS degrees FROM hit")
def c03(spark, sf):
    """Axis within 500 mm and 30 degrees, else the nearest wall at any distance."""
    a = assigned(spark, sf)
    return a.withColumn("degrees", r6(F.col("degrees")))


PLACE = f"{TILT}, {measured('m', 'op')}, pk AS (SELECT *, row_number() OVER (PARTITION BY plan_id, det_id ORDER BY axis_distance, wall_id) AS k FROM m WHERE axis_distance <= 100), placed AS (SELECT DISTINCT o.plan_id, o.det_id, wall_id, axis_distance, p.s FROM op o LEFT JOIN pk p ON o.plan_id = p.plan_id AND o.det_id = p.det_id AND k = 1)"


@query("c04_place_openings", f"{PLACE} SELECT plan_id, det_id, wall_id, axis_distance, {s6('s')} AS s FROM placed")
def c04(spark, sf):
    p = O.place_openings(rect_openings(spark, sf), tilted_walls(spark, sf))
    return p.withColumn("s", r6(F.col("s")))


def moved_openings(spark, sf, step: int = 60):
    """The same openings moved by up to ``step`` px, as another model sees them."""
    shift = F.pmod("x0", F.lit(float(step)))
    return rect_openings(spark, sf).withColumn("points", F.transform("points", lambda p: G.point(p["x"] + F.pmod(F.col("x0"), F.lit(float(step))), p["y"]))).withColumns({c: F.col(c) + shift for c in ("bx", "cx")})


SHIFT = "(x0 % 60)"
IOU = "greatest(0, least(a.bx, b.bx) - greatest(a.x0, b.x0)) * greatest(0, least(a.by_, b.by_) - greatest(a.y0, b.y0))"
UNION = f"((a.bx - a.x0) * (a.by_ - a.y0) + (b.bx - b.x0) * (b.by_ - b.y0) - {IOU})"


THIRD = f"op3 AS (SELECT * REPLACE (x0 + {SHIFT} AS x0, bx + {SHIFT} AS bx, cx + {SHIFT} AS cx) FROM op), {measured('t', 'op3')}, cand AS (SELECT DISTINCT plan_id, wall_id, det_id AS other, s, length FROM t WHERE confidence > 0.85e0 AND axis_distance < 20), want AS (SELECT p.*, c.other, round(abs(p.s - c.s) * c.length, 6) AS d FROM placed p JOIN cand c USING (plan_id, wall_id) WHERE axis_distance > 20), w1 AS (SELECT *, row_number() OVER (PARTITION BY plan_id, det_id ORDER BY d, other) AS k FROM want), w2 AS (SELECT *, row_number() OVER (PARTITION BY plan_id, other ORDER BY d, det_id) AS u FROM w1 WHERE k = 1), instead AS (SELECT plan_id, det_id, other FROM w2 WHERE u = 1)"


@query("c05_substitute_openings", f"{PLACE}, {THIRD} SELECT * FROM instead")
def c05(spark, sf):
    """Placed openings more than 20 off their wall, replaced by the other model's confident opening on it."""
    w = tilted_walls(spark, sf)
    return O.substitute_openings(O.place_openings(rect_openings(spark, sf), w), moved_openings(spark, sf), w)


@query("c06_uncovered", f"{CTE}, m3 AS (SELECT plan_id, det_id, x0 + {SHIFT} AS x0, y0, bx + {SHIFT} AS bx, by_ FROM opening WHERE confidence >= 0.5e0) SELECT plan_id, det_id FROM opening a WHERE NOT EXISTS (SELECT 1 FROM m3 b WHERE a.plan_id = b.plan_id AND {IOU} > 0.5e0 * {UNION})")
def c06(spark, sf):
    return O.uncovered(rect_openings(spark, sf), moved_openings(spark, sf).where("confidence >= 0.5")).select("plan_id", "det_id")


@query("c07_match_walls", f"{TILT}, m3 AS (SELECT plan_id, det_id, confidence, length, x1 - 12 * uy AS x1, y1 + 12 * ux AS y1, x2 - 12 * uy AS x2, y2 + 12 * ux AS y2 FROM tw), p AS (SELECT a.plan_id, a.det_id, b.det_id AS other, round(b.confidence * least(a.length, b.length) / greatest(a.length, b.length) * (1 - ({mid_line('a', 'b')}) / 30) * (1 - ({turn('a', 'b')}) / degrees(0.2e0)) + 1e-9, 6) AS score FROM tw a JOIN m3 b ON a.plan_id = b.plan_id WHERE {mid_line('a', 'b')} <= 30 AND {turn('a', 'b')} <= degrees(0.2e0)), r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, det_id ORDER BY score DESC, other) AS k FROM p) SELECT plan_id, det_id, other, score FROM r WHERE k = 1")
def c07(spark, sf):
    """Walls against those of another model, which sees them 12 px to the side."""
    w = tilted_walls(spark, sf)
    return W.match_walls(w, shifted(w, 12.0))


NEAR_BOX = "least(a.bx, b.bx) + {m} >= greatest(a.x0, b.x0) AND least(a.by_, b.by_) + {m} >= greatest(a.y0, b.y0)"


ROOM_SIDES = (("x1", "y1", "x2", "y2"), ("x2", "y2", "x3", "y3"), ("x3", "y3", "x4", "y4"), ("x4", "y4", "x1", "y1"))
#: SQL: the middle (mx, my) of a wall in the quadrilateral ``a``, or its distance to a side.
ROOM_IN = " AND ".join(f"(a.{p} - a.{u}) * (my - a.{v}) - (a.{q} - a.{v}) * (mx - a.{u}) > 0" for u, v, p, q in ROOM_SIDES)
ROOM_OFF = f"least({', '.join(seg('mx', 'my', *(f'a.{c}' for c in side)) for side in ROOM_SIDES)})"


@query("c08_room_walls", f"{TILT}, m AS (SELECT plan_id, det_id, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM tw) SELECT a.plan_id, a.det_id, count(*) AS n_walls, string_agg(m.det_id, ',' ORDER BY m.det_id) AS wall_ids FROM (SELECT * FROM det WHERE kind = 'STAIR') a JOIN m ON a.plan_id = m.plan_id WHERE ({ROOM_IN}) OR round({ROOM_OFF} + 1e-9, 6) < 300 GROUP BY a.plan_id, a.det_id")
def c08(spark, sf):
    """Walls at any angle whose middle lies in a room, a quadrilateral, or within 0.3 m of its boundary."""
    w = room_walls(detections(spark, sf).where("kind = 'STAIR'"), tilted_walls(spark, sf))
    return w.groupBy("plan_id", "det_id").agg(F.count("*").alias("n_walls"), F.array_join(F.array_sort(F.collect_list("wall_id")), ",").alias("wall_ids"))


#: SQL: an opening's box ``o`` against the rectangle of wall ``w``: apart along x, y, the wall or across it.
HOST = """w AS (SELECT *, thickness / 2 AS h FROM tw WHERE length > 0), hw AS (SELECT o.plan_id, o.det_id, w.det_id AS wall_id, w.length, w.h, (cx - x1) * ux + (cy - y1) * uy AS along, abs((cy - y1) * ux - (cx - x1) * uy) AS across,
 (bx - x0) / 2 * abs(ux) + (by_ - y0) / 2 * abs(uy) AS ea, (bx - x0) / 2 * abs(uy) + (by_ - y0) / 2 * abs(ux) AS ec
 FROM op o JOIN w ON o.plan_id = w.plan_id WHERE least(x1, x2) - h * abs(uy) <= bx + 1e-6 AND greatest(x1, x2) + h * abs(uy) >= x0 - 1e-6 AND least(y1, y2) - h * abs(ux) <= by_ + 1e-6 AND greatest(y1, y2) + h * abs(ux) >= y0 - 1e-6),
 hc AS (SELECT *, NOT (along BETWEEN -1e-6 AND length + 1e-6 AND across <= h + 1e-6) AS out FROM hw WHERE along + ea >= -1e-6 AND along - ea <= length + 1e-6 AND across <= h + ec + 1e-6)"""


@query("c09_host_wall", f"{TILT}, {HOST} SELECT plan_id, det_id, arg_min(wall_id, (out, wall_id)) AS wall_id, NOT min(out) AS holds_centre FROM hc GROUP BY plan_id, det_id")
def c09(spark, sf):
    """The wall at any angle that holds an opening's centre, else one that meets the opening."""
    return O.host_wall(rect_openings(spark, sf), tilted_walls(spark, sf))


@query("c10_nearest_wall_fix", f"{OT.replace('FROM m0)', 'FROM m0 WHERE ux IN (0, 1))')}, c AS (SELECT *, row_number() OVER (PARTITION BY plan_id, det_id ORDER BY wall_distance, axis_distance, wall_id) AS k FROM m WHERE wall_distance <= 100), b AS (SELECT *, CASE WHEN ux = 1 THEN x1 ELSE x1 - thickness / 2 END AS wx0, CASE WHEN ux = 1 THEN x2 ELSE x1 + thickness / 2 END AS wx1, CASE WHEN ux = 1 THEN y1 - thickness / 2 ELSE y1 END AS wy0, CASE WHEN ux = 1 THEN y1 + thickness / 2 ELSE y2 END AS wy1 FROM c WHERE k = 1) SELECT DISTINCT o.plan_id, o.det_id, wall_id, CASE WHEN wall_id IS NOT NULL THEN {s6('greatest(0, least(o.bx, wx1) - greatest(o.x0, wx0)) * greatest(0, least(o.by_, wy1) - greatest(o.y0, wy0))')} END AS area FROM op o LEFT JOIN b ON o.plan_id = b.plan_id AND o.det_id = b.det_id")
def c10(spark, sf):
    """Openings clipped to the nearest wall within 100 mm; the demo's axis-parallel walls, so that boxes tell the area."""
    upright = tilted_walls(spark, sf).where("ux IN (0, 1)")
    return O.clip_to_wall(rect_openings(spark, sf), upright).select("plan_id", "det_id", "wall_id", r6(F.col("area")).alias("area"))


ENDS = CTE + ", ends AS (SELECT plan_id, det_id, thk, ax1 AS x, ay1 AS y, 1 AS e FROM wall UNION ALL SELECT plan_id, det_id, thk, ax2, ay2, 2 FROM wall)"


def ends(df):
    one = lambda i: df.select("plan_id", "det_id", "thk", F.col(f"ax{i}").alias("x"), F.col(f"ay{i}").alias("y"), F.lit(i).alias("e"))
    return one(1).unionByName(one(2))


@query("c11_endpoint_gaps", f"{ENDS}, p AS (SELECT a.plan_id, a.det_id AS a_det_id, a.e AS a_e, b.det_id AS b_det_id, b.e AS b_e, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, greatest(50, least(2.5e0 * (a.thk + b.thk) / 2, 300)) AS most FROM ends a JOIN ends b ON a.plan_id = b.plan_id AND a.det_id < b.det_id) SELECT plan_id, a_det_id, a_e, b_det_id, b_e, {s6('sqrt(d2)')} AS gap FROM p WHERE d2 > 1 AND d2 <= most * most")
def c11(spark, sf):
    """Ends of different axes within a limit that follows the walls' thickness."""
    pairs = self_pairs(ends(walls(spark, sf)), ("x", "y", "x", "y"), ["thk", "e"], 300.0)
    d2 = (F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2
    limit = F.greatest(F.lit(50.0), F.least(2.5 * (F.col("a_thk") + F.col("b_thk")) / 2, F.lit(300.0)))
    return pairs.withColumn("d2", d2).where((F.col("d2") > 1) & (F.col("d2") <= limit * limit)).select("plan_id", "a_det_id", "a_e", "b_det_id", "b_e", r6(F.sqrt("d2")).alias("gap"))


@query("c12_gap_proposals", PAIR.format(cols=f", {s6(gap('a', 'b'))} AS gap, {s6('1 - ' + gap('a', 'b') + ' / 400')} AS confidence, {gap('a', 'b')} > 50 AS review", cond=f"{gap('a', 'b')} > 1 AND {gap('a', 'b')} <= 400"))
def c12(spark, sf):
    pairs = wall_pairs(spark, sf, 400.0).withColumn("g", end_gap()).where("g > 1 AND g <= 400")
    return pairs.select(*IDS, r6(F.col("g")).alias("gap"), r6(1 - F.col("g") / 400).alias("confidence"), (F.col("g") > 50).alias("review"))


@query("c13_gap_classes", f"{CTE} SELECT a.plan_id, count(*) FILTER (WHERE {gap('a', 'b')} > 50 AND {gap('a', 'b')} <= 100) AS medium, count(*) FILTER (WHERE {gap('a', 'b')} > 100) AS large FROM wall a JOIN wall b ON a.plan_id = b.plan_id AND a.det_id < b.det_id GROUP BY a.plan_id")
def c13(spark, sf):
    """The mode that counts all pairs of a plan: only pairs within 100 mm meet, the others are what is left of n (n - 1) / 2."""
    g = W.gap_classes(axis_walls(spark, sf).select("plan_id", "det_id", *W.AXIS))
    return g.select("plan_id", "medium", "large")


CLOSE = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 10000"
LABELS = f"""{ENDS}, node AS (SELECT plan_id, det_id || '#' || e AS id, x, y FROM ends), edge AS (SELECT DISTINCT a.plan_id, a.id AS u, b.id AS v FROM node a JOIN node b ON a.plan_id = b.plan_id AND a.id <> b.id WHERE {CLOSE}),
    reach AS (SELECT plan_id, u AS id, u AS seen FROM edge UNION SELECT r.plan_id, r.id, e.v FROM reach r JOIN edge e ON r.plan_id = e.plan_id AND r.seen = e.u),
    lab AS (SELECT plan_id, id, min(seen) AS component FROM reach GROUP BY plan_id, id)"""
LABELS = LABELS.replace("WITH base", "WITH RECURSIVE base", 1)


def end_clusters(spark, sf, reach: float = 100.0):
    """Ends with ids (a repeated row's twice, which pairs with none of its own), and the components of ends within ``reach``."""
    n = ends(walls(spark, sf)).withColumn("id", F.concat_ws("#", "det_id", "e")).select("plan_id", "id", "x", "y")
    pairs = self_pairs(n, ("x", "y", "x", "y"), [], reach, "id")
    near = pairs.where((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2 <= reach * reach)
    return n, components(near.select("plan_id", F.col("a_id").alias("src"), F.col("b_id").alias("dst")), keys=("plan_id",))


@query("c14_close_gaps", f"{LABELS}, nd AS (SELECT DISTINCT * FROM node), mean AS (SELECT plan_id, component, avg(x) AS x, avg(y) AS y FROM lab JOIN nd USING (plan_id, id) GROUP BY plan_id, component), moved AS (SELECT DISTINCT l.plan_id, l.id, m.x, m.y FROM lab l JOIN mean m USING (plan_id, component)) SELECT w.plan_id, w.det_id, {s6('coalesce(p.x, ax1)')} AS x1, {s6('coalesce(p.y, ay1)')} AS y1, {s6('coalesce(q.x, ax2)')} AS x2, {s6('coalesce(q.y, ay2)')} AS y2 FROM wall w LEFT JOIN moved p ON w.plan_id = p.plan_id AND w.det_id || '#1' = p.id LEFT JOIN moved q ON w.plan_id = q.plan_id AND w.det_id || '#2' = q.id")
def c14(spark, sf):
    """Ends within 100 mm form clusters; each moves to its cluster's mean."""
    w = W.close_gaps(axis_walls(spark, sf).select("plan_id", "det_id", *W.AXIS, "thickness"))
    return w.select("plan_id", "det_id", *[r6(F.col(c)).alias(c) for c in W.AXIS])


@query("c15_t_junctions", f"{ENDS}, h AS (SELECT e.plan_id, e.det_id, e.e, w.det_id AS into_id, w.len, w.thk, CASE WHEN w.horizontal THEN e.x - w.ax1 ELSE e.y - w.ay1 END AS along, CASE WHEN w.horizontal THEN abs(e.y - w.ay1) ELSE abs(e.x - w.ax1) END AS off FROM ends e JOIN wall w ON e.plan_id = w.plan_id AND e.det_id <> w.det_id) SELECT plan_id, det_id, e, into_id FROM h WHERE off <= thk / 2 AND along >= greatest(50, 0.1e0 * len) AND along <= len - greatest(50, 0.1e0 * len)")
def c15(spark, sf):
    """An end that projects into another wall's inner part, within half its thickness."""
    e = ends(walls(spark, sf)).drop("thk")
    w = renamed(walls(spark, sf), "w_", ["det_id", *AXIS])
    pairs = grid_join(e, w, ("x", "y", "x", "y"), ("w_ax1", "w_ay1", "w_ax2", "w_ay2"), 200.0).where("det_id <> w_det_id")
    p = G.project_on_line(*[F.col(c) for c in ("x", "y", "w_ax1", "w_ay1", "w_ax2", "w_ay2")])
    along, margin = F.round(p["s"] * F.col("w_len"), 6), F.greatest(F.lit(50.0), 0.1 * F.col("w_len"))
    hit = (F.round(p["distance"], 6) <= F.col("w_thk") / 2) & (along >= margin) & (along <= F.col("w_len") - margin)
    return pairs.where(hit).select("plan_id", "det_id", "e", F.col("w_det_id").alias("into_id"))


#: SQL, axes in the demo's main directions: an end of one wall lies at the other's axis, inside its middle part.
RUNS_INTO = "(CASE WHEN {b}.horizontal THEN {a}.{e} - {b}.ax1 ELSE {a}.{f} - {b}.ay1 END > greatest(50, 0.1e0 * {b}.len) AND {b}.len - CASE WHEN {b}.horizontal THEN {a}.{e} - {b}.ax1 ELSE {a}.{f} - {b}.ay1 END > greatest(50, 0.1e0 * {b}.len) AND CASE WHEN {b}.horizontal THEN abs({a}.{f} - {b}.ay1) ELSE abs({a}.{e} - {b}.ax1) END <= greatest(a.thk, b.thk) / 2)"
T_JUNCTION = " OR ".join(RUNS_INTO.format(a=a, b=b, e=f"ax{i}", f=f"ay{i}") for a, b in (("a", "b"), ("b", "a")) for i in (1, 2))
OVERLAP = f"CASE WHEN {T_JUNCTION} THEN 0 ELSE {IOU} / ((a.thk + b.thk) / 2) END"


@query("c16_wall_overlaps", PAIR.format(cols=f", {s6(OVERLAP)} AS overlap", cond=f"{OVERLAP} > 100"))
def c16(spark, sf):
    """Overlap length: shared area over mean thickness; walls that meet in a T are left out."""
    return W.wall_overlaps(axis_walls(spark, sf)).withColumn("overlap", r6(F.col("overlap")))


@query("c17_resolve_overlaps", f"{CTE.replace('WITH base', 'WITH RECURSIVE base', 1)}, ov AS (SELECT a.plan_id, a.det_id AS u, b.det_id AS v FROM wall a JOIN wall b ON a.plan_id = b.plan_id AND a.det_id <> b.det_id WHERE {OVERLAP} > 100), reach AS (SELECT plan_id, u AS id, u AS seen FROM ov UNION SELECT r.plan_id, r.id, o.v FROM reach r JOIN ov o ON r.plan_id = o.plan_id AND r.seen = o.u), lab AS (SELECT plan_id, id, min(seen) AS component FROM reach GROUP BY plan_id, id), k AS (SELECT DISTINCT w.plan_id, coalesce(component, det_id) AS component, det_id, len * thk AS area FROM wall w LEFT JOIN lab ON w.plan_id = lab.plan_id AND w.det_id = lab.id), r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, component ORDER BY area DESC, det_id) AS k FROM k) SELECT plan_id, det_id FROM r WHERE k = 1")
def c17(spark, sf):
    """Of walls that overlap, directly or through others, the largest stays."""
    return W.resolve_overlaps(axis_walls(spark, sf).select("plan_id", "det_id", *W.AXIS, "thickness").distinct()).select("plan_id", "det_id")


def merged_sql(source: str, least: float = 60, tag: str = "") -> str:
    """SQL CTEs: ``merged`` has the axes of ``source`` (plan_id, det_id, x1..y2, thickness) with those on one line merged."""
    both = lambda c: f"CASE WHEN b.n > a.n THEN b.{c} ELSE a.{c} END AS l{c}, CASE WHEN b.n > a.n THEN a.{c} ELSE b.{c} END AS s{c}"
    on = lambda i: f"((sx{i} - lx1) * (lx2 - lx1) / ln + (sy{i} - ly1) * (ly2 - ly1) / ln)"
    off = lambda i: f"((sy{i} - ly1) * (lx2 - lx1) / ln - (sx{i} - lx1) * (ly2 - ly1) / ln)"
    angle = "abs(degrees(atan2(ly2 - ly1, lx2 - lx1)) - degrees(atan2(sy2 - sy1, sx2 - sx1)))"
    return f"""g AS (SELECT DISTINCT plan_id, det_id, x1, y1, x2, y2, thickness, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS n FROM {source} WHERE x1 <> x2 OR y1 <> y2),
pr AS (SELECT a.plan_id, a.det_id AS u, b.det_id AS v, {', '.join(map(both, ('x1', 'y1', 'x2', 'y2', 'n')))} FROM g a JOIN g b ON a.plan_id = b.plan_id AND a.det_id < b.det_id),
ne AS (SELECT plan_id, u, v FROM pr WHERE least({angle} % 180, 180 - {angle} % 180) <= 1 AND round(abs({off(1)} + {off(2)}) / 2, 6) <= 5 AND round(greatest(least({on(1)}, {on(2)}) - ln, -greatest({on(1)}, {on(2)})), 6) <= 5),
nb AS (SELECT plan_id, u, v FROM ne UNION ALL SELECT plan_id, v, u FROM ne),
lr AS (SELECT plan_id, u AS id, u AS seen FROM nb UNION SELECT r.plan_id, r.id, e.v FROM lr r JOIN nb e ON r.plan_id = e.plan_id AND r.seen = e.u),
ll AS (SELECT plan_id, id, min(seen) AS component FROM lr GROUP BY plan_id, id),
gm AS (SELECT g.*, coalesce(component, det_id) AS component FROM g LEFT JOIN ll ON g.plan_id = ll.plan_id AND g.det_id = ll.id),
lead_ AS (SELECT plan_id, component, x1 AS lx1, y1 AS ly1, (x2 - x1) / n AS ux, (y2 - y1) / n AS uy FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, component ORDER BY n DESC, det_id) AS k FROM gm) WHERE k = 1),
pl_ AS (SELECT gm.*, lx1, ly1, ux, uy, (x1 - lx1) * ux + (y1 - ly1) * uy AS s1, (x2 - lx1) * ux + (y2 - ly1) * uy AS s2, ((y1 - ly1) * ux - (x1 - lx1) * uy + (y2 - ly1) * ux - (x2 - lx1) * uy) / 2 AS off FROM gm JOIN lead_ USING (plan_id, component)),
mg AS (SELECT plan_id, component AS det_id, any_value(lx1) AS lx1, any_value(ly1) AS ly1, any_value(ux) AS ux, any_value(uy) AS uy, min(least(s1, s2)) AS s, max(greatest(s1, s2)) AS e, sum(off * n) / sum(n) AS off, sum(thickness * n) / sum(n) AS thickness, count(*) AS n_merged FROM pl_ GROUP BY plan_id, component),
merged AS (SELECT plan_id, det_id, lx1 + s * ux - off * uy AS x1, ly1 + s * uy + off * ux AS y1, lx1 + e * ux - off * uy AS x2, ly1 + e * uy + off * ux AS y2, e - s AS length, thickness, n_merged FROM mg WHERE e - s >= {least})"""


@query("e07_merge_collinear", f"{TILT.replace('WITH base', 'WITH RECURSIVE base', 1)}, {merged_sql('tw')} SELECT plan_id, det_id, n_merged, {s6('length')} AS length, {s6('thickness')} AS thickness, {s6('x1')} AS x1, {s6('y1')} AS y1 FROM merged")
def e07(spark, sf):
    """Axes on one line merged, at any angle and without bins."""
    m = W.merge_collinear(tilted_walls(spark, sf))
    return m.select("plan_id", "det_id", "n_merged", *[r6(c).alias(n) for n, c in (("length", W.length()), ("thickness", F.col("thickness")), ("x1", F.col("x1")), ("y1", F.col("y1")))])


@query("c17_merged_outlines", SQL["c17_resolve_overlaps"].split(", k AS (")[0] + """, mw AS (SELECT DISTINCT w.plan_id, coalesce(component, det_id) AS component, det_id, x0, y0, bx, by_ FROM wall w LEFT JOIN lab ON w.plan_id = lab.plan_id AND w.det_id = lab.id),
    xs AS (SELECT plan_id, component, v AS a, lead(v) OVER (PARTITION BY plan_id, component ORDER BY v) AS b FROM (SELECT plan_id, component, x0 AS v FROM mw UNION SELECT plan_id, component, bx FROM mw)),
    ys AS (SELECT plan_id, component, v AS c, lead(v) OVER (PARTITION BY plan_id, component ORDER BY v) AS d FROM (SELECT plan_id, component, y0 AS v FROM mw UNION SELECT plan_id, component, by_ FROM mw)),
    full_ AS (SELECT DISTINCT mw.plan_id, mw.component, a, b, c, d FROM mw JOIN xs ON mw.plan_id = xs.plan_id AND mw.component = xs.component AND a >= x0 AND b <= bx JOIN ys ON mw.plan_id = ys.plan_id AND mw.component = ys.component AND c >= y0 AND d <= by_)
    SELECT f.plan_id, f.component, n_walls, round(sum((b - a) * (d - c)), 3) AS area FROM full_ f JOIN (SELECT plan_id, component, count(*) AS n_walls FROM mw GROUP BY plan_id, component) n ON f.plan_id = n.plan_id AND f.component = n.component GROUP BY f.plan_id, f.component, n_walls""")
def c17m(spark, sf):
    """Walls that overlap merged to one outline; areas of the unions."""
    m = W.merge_overlaps(axis_walls(spark, sf).select("plan_id", "det_id", *W.AXIS, "thickness"))
    return m.groupBy("plan_id", "component", "n_walls").agg(F.round(F.sum("area"), 3).alias("area"))


@query("c18_parallel_overlaps", TPAIR.format(cols="", cond=f"{turn('a', 'b')} < degrees(0.1e0) AND {MIDS} < 200"))
def c18(spark, sf):
    return W.parallel_overlaps(tilted_walls(spark, sf)).select(*IDS)


@query("c19_dedupe_lines", f"{TILT} SELECT DISTINCT plan_id, det_id FROM tw b WHERE NOT EXISTS (SELECT 1 FROM tw a WHERE a.plan_id = b.plan_id AND a.det_id <> b.det_id AND {turn('a', 'b')} <= degrees(0.1e0) AND {mid_line('a', 'b')} <= 20 AND (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.det_id < b.det_id)))")
def c19(spark, sf):
    """Of parallel lines that lie on one another, the one with more confidence stays."""
    return W.dedupe_lines(tilted_walls(spark, sf)).select("plan_id", "det_id").distinct()


@query("c20_wall_connections", f"{TPAIR.format(cols=f', round({segments("a", "b")}, 6) AS d, {turn("a", "b")} AS t', cond='true').replace(' SELECT a.plan_id', ', p AS (SELECT a.plan_id', 1)}) SELECT * FROM (SELECT plan_id, a_det_id, b_det_id, CASE WHEN d = 0 THEN 'cross' WHEN d <= 75 THEN 'near' WHEN d <= 150 AND (t <= 15 OR t >= 75) THEN 'aligned' END AS how FROM p) WHERE how IS NOT NULL")
def c20(spark, sf):
    """Axes that meet, or come within 150 mm square or parallel to each other, or within 75 mm."""
    return W.wall_connections(tilted_walls(spark, sf)).select(*IDS, "how")


def sides_sql(name: str, source: str, corners: list[tuple[str, str]]) -> str:
    """SQL: CTE ``name`` (plan_id, det_id, x1, y1, x2, y2) of the sides between the corners of each row of ``source``."""
    turned = zip(corners, corners[1:] + corners[:1], strict=True)
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT plan_id, det_id, {a} AS x1, {b} AS y1, {c} AS x2, {d} AS y2 FROM {source}" for (a, b), (c, d) in turned) + ")"


def strips_sql(name: str, source: str) -> str:
    """SQL: the strips below the sides of ``source``: from s to e, height m * x + c, signed."""
    return f"{name} AS (SELECT plan_id, det_id, least(x1, x2) AS s, greatest(x1, x2) AS e, (y2 - y1) / (x2 - x1) AS m, y1 - (y2 - y1) / (x2 - x1) * x1 AS c, sign(x2 - x1) AS sg FROM {source} WHERE x1 <> x2)"


def shared_sql(p: str, q: str) -> str:
    """SQL: signed area below a strip of ``p`` and one of ``q``; the absolute sum over all pairs is what two rings share."""
    lo, hi = f"greatest({p}.s, {q}.s)", f"least({p}.e, {q}.e)"
    u, v = (f"({p}.m * {x} + {p}.c - {q}.m * {x} - {q}.c)" for x in (lo, hi))
    apart = f"CASE WHEN {u} * {v} >= 0 THEN (abs({u}) + abs({v})) / 2 ELSE ({u} * {u} + {v} * {v}) / (2 * (abs({u}) + abs({v}))) END"
    mean = f"({p}.m * {lo} + {p}.c + {q}.m * {lo} + {q}.c + {p}.m * {hi} + {p}.c + {q}.m * {hi} + {q}.c) / 4"
    return f"CASE WHEN {hi} > {lo} THEN {p}.sg * {q}.sg * ({hi} - {lo}) * ({mean} - ({apart}) / 2) ELSE 0 END"


WALL_CORNERS = [("x1 - uy * h", "y1 + ux * h"), ("x2 - uy * h", "y2 + ux * h"), ("x2 + uy * h", "y2 - ux * h"), ("x1 + uy * h", "y1 - ux * h")]
#: SQL: walls' rectangles (``wr`` with their boxes), spaces (``sp``), and the sides of both.
RINGS = f"""{TILT}, wr AS (SELECT *, thickness / 2 AS h, least(x1, x2) - abs(uy) * thickness / 2 AS lx, greatest(x1, x2) + abs(uy) * thickness / 2 AS hx, least(y1, y2) - abs(ux) * thickness / 2 AS ly, greatest(y1, y2) + abs(ux) * thickness / 2 AS hy FROM tw WHERE length > 0),
sp AS (SELECT * FROM det WHERE kind = 'STAIR'), {sides_sql('ws', 'wr', WALL_CORNERS)}, {sides_sql('ss', 'sp', [(f'x{i}', f'y{i}') for i in range(1, 5)])}"""


def in_wall(x: str, y: str, w: str) -> str:
    return f"(({x} - {w}.x1) * {w}.ux + ({y} - {w}.y1) * {w}.uy BETWEEN 0 AND {w}.length AND abs(({y} - {w}.y1) * {w}.ux - ({x} - {w}.x1) * {w}.uy) <= {w}.h)"


def in_space(x: str, y: str) -> str:
    return "(" + ROOM_IN.replace("my", y).replace("mx", x) + ")"


CONTACTS = f"""{RINGS}, cand AS (SELECT a.plan_id, a.det_id AS u, b.det_id AS v, {in_wall('(a.x1 - a.uy * a.h)', '(a.y1 + a.ux * a.h)', 'b')} OR {in_wall('(b.x1 - b.uy * b.h)', '(b.y1 + b.ux * b.h)', 'a')} AS holds FROM wr a JOIN wr b ON a.plan_id = b.plan_id AND a.det_id < b.det_id WHERE a.lx <= b.hx + 20 AND b.lx <= a.hx + 20 AND a.ly <= b.hy + 20 AND b.ly <= a.hy + 20),
ct AS (SELECT c.plan_id, u AS a_det_id, v AS b_det_id, round(CASE WHEN bool_or(holds) THEN 0 ELSE min({segments('s', 't')}) END + 1e-9, 6) AS d FROM cand c JOIN ws s ON c.plan_id = s.plan_id AND u = s.det_id JOIN ws t ON c.plan_id = t.plan_id AND v = t.det_id GROUP BY c.plan_id, u, v)"""


def contacts(spark, sf):
    return SP.contact_proposals(tilted_walls(spark, sf), 20.0)


@query("c21_contact_proposals", f"{CONTACTS} SELECT plan_id, a_det_id, b_det_id, d AS distance, CASE WHEN d = 0 THEN 'touch' ELSE 'gap' END AS contact FROM ct WHERE d <= 20")
def c21(spark, sf):
    """Rectangles of walls at any angle that touch or come within 20."""
    return contacts(spark, sf).withColumnsRenamed({"a_id": "a_det_id", "b_id": "b_det_id"})


SPACES = CTE + ", space AS (SELECT * FROM det WHERE kind = 'STAIR')"


def spaces(spark, sf):
    return detections(spark, sf).where("kind = 'STAIR'")


def boundaries(spark, sf):
    return SP.space_boundaries(spaces(spark, sf), tilted_walls(spark, sf), rect_openings(spark, sf))


BOUNDS = f"""{RINGS}, {sides_sql('os', 'op', [('x0', 'y0'), ('bx', 'y0'), ('bx', 'by_'), ('x0', 'by_')])},
cb AS (SELECT a.plan_id, a.det_id AS sid, w.det_id AS wid, w.thickness AS t, {in_space('w.x1', 'w.y1')} AS ins, {in_space('(w.x1 - w.uy * w.h)', '(w.y1 + w.ux * w.h)')} OR {in_wall('a.x1', 'a.y1', 'w')} AS holds FROM sp a JOIN wr w ON a.plan_id = w.plan_id AND w.lx - 600 <= greatest(a.x2, a.x3) AND w.hx + 600 >= a.x1 AND w.ly - 600 <= greatest(a.y3, a.y4) AND w.hy + 600 >= a.y1),
ax AS (SELECT c.plan_id, sid, wid, round(min({segments('s', 'w')}) + 1e-9, 6) AS off, round(min(least({seg('w.x1', 'w.y1', 's.x1', 's.y1', 's.x2', 's.y2')}, {seg('w.x2', 'w.y2', 's.x1', 's.y1', 's.x2', 's.y2')})) + 1e-9, 6) AS end_ FROM cb c JOIN ss s ON c.plan_id = s.plan_id AND sid = s.det_id JOIN wr w ON c.plan_id = w.plan_id AND wid = w.det_id GROUP BY c.plan_id, sid, wid),
tc AS (SELECT c.plan_id, sid, wid, round(min({segments('s', 't')}) + 1e-9, 6) AS gap FROM cb c JOIN ss s ON c.plan_id = s.plan_id AND sid = s.det_id JOIN ws t ON c.plan_id = t.plan_id AND wid = t.det_id GROUP BY c.plan_id, sid, wid),
ru AS (SELECT c.plan_id, sid, wid, CASE WHEN off = 0 THEN 'meets' WHEN ins OR off <= 1.5e0 * t AND off < 300 THEN 'near' WHEN end_ <= t THEN 'end' WHEN holds OR gap <= 0.1e0 THEN 'touches' END AS how FROM cb c JOIN ax USING (plan_id, sid, wid) JOIN tc USING (plan_id, sid, wid)),
ob AS (SELECT a.plan_id, a.det_id AS sid, o.det_id AS oid, o.kind, {in_space('o.x0', 'o.y0')} OR (a.x1 BETWEEN o.x0 AND o.bx AND a.y1 BETWEEN o.y0 AND o.by_) AS holds FROM sp a JOIN op o ON a.plan_id = o.plan_id),
og AS (SELECT c.plan_id, sid, oid, any_value(kind) AS kind, round(CASE WHEN bool_or(holds) THEN 0 ELSE min({segments('s', 't')}) END + 1e-9, 6) AS gap FROM ob c JOIN ss s ON c.plan_id = s.plan_id AND sid = s.det_id JOIN os t ON c.plan_id = t.plan_id AND oid = t.det_id GROUP BY c.plan_id, sid, oid),
sb AS (SELECT plan_id, sid AS space_id, wid AS element_id, 'WALL' AS element, how FROM ru WHERE how IS NOT NULL UNION ALL SELECT plan_id, sid, oid, kind, 'opening' FROM og WHERE gap < 300)"""


@query("c22_space_boundaries", f"{BOUNDS} SELECT * FROM sb")
def c22(spark, sf):
    """Walls that bound a space, by the rule that tells it, and the openings near it."""
    return boundaries(spark, sf)


@query("c24_space_overlaps", f"{RINGS}, {strips_sql('st', 'ss')}, ar AS (SELECT plan_id, det_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM ss GROUP BY plan_id, det_id), sh AS (SELECT p.plan_id, p.det_id AS a_det_id, q.det_id AS b_det_id, abs(sum({shared_sql('p', 'q')})) AS shared FROM st p JOIN st q ON p.plan_id = q.plan_id AND p.det_id < q.det_id GROUP BY p.plan_id, p.det_id, q.det_id) SELECT sh.plan_id, a_det_id, b_det_id, round(shared + 1e-7, 3) AS shared FROM sh JOIN ar a ON sh.plan_id = a.plan_id AND a_det_id = a.det_id JOIN ar b ON sh.plan_id = b.plan_id AND b_det_id = b.det_id WHERE round(shared / least(a.area, b.area) + 1e-9, 6) > 0.01e0")
def c24(spark, sf):
    """Spaces, quadrilaterals that aren't rectangles, that share more than a hundredth of either."""
    o = SP.space_overlaps(spaces(spark, sf))
    return o.select("plan_id", F.col("a_id").alias("a_det_id"), F.col("b_id").alias("b_det_id"), F.round(F.col("shared") + 1e-7, 3).alias("shared"))


#: The contacts' SQL behind that of the boundaries.
BOTH = BOUNDS + CONTACTS[len(RINGS):]
SHARED = f"{BOTH}, sw AS (SELECT DISTINCT plan_id, space_id, element_id FROM sb WHERE element = 'WALL') SELECT ct.plan_id, a_det_id, b_det_id, count(*) AS n_spaces FROM ct JOIN sw s ON ct.plan_id = s.plan_id AND a_det_id = s.element_id JOIN sw t ON ct.plan_id = t.plan_id AND b_det_id = t.element_id AND s.space_id = t.space_id WHERE d <= 20 GROUP BY ct.plan_id, a_det_id, b_det_id"


@query("c25_shared_spaces", SHARED)
def c25(spark, sf):
    """Spaces that both walls of a contact bound."""
    return SP.contacts_at_spaces(spaces(spark, sf), tilted_walls(spark, sf), 20.0).withColumnsRenamed({"a_id": "a_det_id", "b_id": "b_det_id"})


REL_SQL = """WITH element AS (SELECT o_orderkey AS guid, CASE o_orderkey % 4 WHEN 0 THEN 'IfcWall' WHEN 1 THEN 'IfcOpening' WHEN 2 THEN 'IfcSlab' ELSE 'IfcSpace' END AS type, o_totalprice AS v FROM orders),
 rel AS (SELECT l_orderkey AS guid, CASE l_linenumber WHEN 1 THEN 'voids' WHEN 2 THEN 'fills' WHEN 3 THEN 'material' WHEN 4 THEN 'storey' ELSE 'boundary' END AS rel FROM lineitem)"""


def elements(spark, sf):
    """Orders as model elements."""
    k = F.pmod("o_orderkey", F.lit(4))
    kind = F.when(k == 0, "IfcWall").when(k == 1, "IfcOpening").when(k == 2, "IfcSlab").otherwise("IfcSpace")
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("guid"), kind.alias("type"), F.col("o_totalprice").alias("v"))


def relations(spark, sf):
    """Line items as relations of elements."""
    n = F.col("l_linenumber")
    rel = F.when(n == 1, "voids").when(n == 2, "fills").when(n == 3, "material").when(n == 4, "storey").otherwise("boundary")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("guid"), rel.alias("rel"))


# Check -> (element types, relation each must have).
REFERENTIAL = (
    ("opening_without_void", ("IfcOpening",), "voids"),
    ("opening_without_fill", ("IfcOpening",), "fills"),
    ("element_without_material", ("IfcWall", "IfcSlab"), "material"),
    ("element_without_storey", ("IfcWall", "IfcSlab", "IfcOpening", "IfcSpace"), "storey"),
    ("space_without_boundary", ("IfcSpace",), "boundary"),
)


@query("c26_referential_checks", REL_SQL + " " + " UNION ALL ".join(f"SELECT '{c}' AS issue, count(*) AS n, string_agg(guid, ',' ORDER BY guid) FILTER (WHERE k <= 5) AS first_five FROM (SELECT guid, row_number() OVER (ORDER BY guid) AS k FROM element e WHERE type IN ({', '.join(repr(t) for t in ts)}) AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.guid = e.guid AND rel = '{r}'))" for c, ts, r in REFERENTIAL))
def c26(spark, sf):
    """One anti-join over (element, needed relation) answers all checks; only the first five are kept per check."""
    rules = spark.createDataFrame([(c, t, r) for c, ts, r in REFERENTIAL for t in ts], "issue string, type string, rel string")
    need = elements(spark, sf).join(F.broadcast(rules), "type")
    missing = need.join(relations(spark, sf).distinct(), ["guid", "rel"], "left_anti")
    # Ranked in slices first, so that no check's rows meet in one task.
    part = Window.partitionBy("issue", F.pmod(F.xxhash64("guid"), F.lit(64))).orderBy("guid")
    top = missing.withColumn("k", F.row_number().over(part)).where("k <= 5")
    first = top.withColumn("k", F.row_number().over(Window.partitionBy("issue").orderBy("guid"))).where("k <= 5")
    first = first.groupBy("issue").agg(F.array_join(F.transform(F.array_sort(F.collect_list("guid")), lambda g: g.cast("string")), ",").alias("first_five"))
    issues = spark.createDataFrame([(c,) for c, _, _ in REFERENTIAL], "issue string")
    return issues.join(missing.groupBy("issue").agg(F.count("*").alias("n")), "issue", "left").join(first, "issue", "left").select("issue", F.coalesce("n", F.lit(0)).alias("n"), "first_five")


@query("c27_repair_relations", nearest_sql("true", "distance", "").replace("r.wall_id FROM", "r.wall_id AS host FROM"))
def c27(spark, sf):
    """The nearest wall at any distance; null only in a plan without walls."""
    o, best = nearest_walls(spark, sf, 2000.0)
    return with_nearest(o, best, F.col("w_det_id").alias("host"))


@query("c27_fill_to_opening", f"{TILT}, fl AS (SELECT plan_id, det_id, cx + {SHIFT} AS cx, cy FROM op WHERE confidence >= 0.4e0), fr AS (SELECT f.plan_id, f.det_id, o.det_id AS opening_id, round(sqrt((f.cx - o.cx) ** 2 + (f.cy - o.cy) ** 2) + 1e-9, 6) AS distance FROM fl f JOIN (SELECT * FROM op WHERE kind = 'DOOR') o ON f.plan_id = o.plan_id), fk AS (SELECT *, row_number() OVER (PARTITION BY plan_id, det_id ORDER BY distance, opening_id) AS k FROM fr) SELECT DISTINCT f.plan_id, f.det_id, k.opening_id, k.distance FROM fl f LEFT JOIN fk k ON f.plan_id = k.plan_id AND f.det_id = k.det_id AND k.k = 1")
def c27f(spark, sf):
    """Elements that another model sees, each to the nearest door's opening of its plan, at any distance."""
    fills = moved_openings(spark, sf).where("confidence >= 0.4")
    return O.fill_to_opening(fills, rect_openings(spark, sf).where("kind = 'DOOR'"), 500.0)


@query("c28_fallback_wall", nearest_sql("true", "distance", ", CASE WHEN r.distance <= 500 THEN 'primary' WHEN r.distance < 5000 THEN 'fallback_nearest' WHEN r.wall_id IS NOT NULL THEN 'fallback_first' END AS method, r.distance <= r.w_thk / 2 + 5 AS inside"))
def c28(spark, sf):
    """The nearest axis at any distance: by the grid within 5000 mm, else by the plan's own walls."""
    o, best = nearest_walls(spark, sf, 5000.0)
    method = F.when(F.col("distance") <= 500, "primary").when(F.col("distance") < 5000, "fallback_nearest").otherwise("fallback_first")
    return with_nearest(o, best, F.col("w_det_id").alias("wall_id"), F.when(F.col("distance").isNotNull(), method).alias("method"), (F.col("distance") <= F.col("w_thk") / 2 + 5).alias("inside"))


@query("c29_refine_axes", f"{TILT}, p AS (SELECT a.plan_id, a.det_id, b.det_id AS line_id, round(10 * ({turn('a', 'b')}) + {MIDS} + 1e-9, 6) AS score FROM tw a JOIN tw b ON a.plan_id = b.plan_id AND a.det_id <> b.det_id WHERE b.confidence > 0.7e0 AND {turn('a', 'b')} <= 7), r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, det_id ORDER BY score, line_id) AS k FROM p) SELECT DISTINCT plan_id, det_id, line_id, score FROM r WHERE k = 1".replace("a.det_id <> b.det_id", "a.line_no <> b.line_no"))
def c29(spark, sf):
    """Axes against the confident lines of other line numbers, at any distance."""
    w = tilted_walls(spark, sf)
    parts = [W.refine_axes(w.where(F.col("line_no") == i), w.where((F.col("confidence") > 0.7) & (F.col("line_no") != i))) for i in range(1, 5)]
    return reduce(DataFrame.unionByName, parts).select("plan_id", "det_id", "line_id", "score").distinct()


@query("c30_fit_opening", f"{OT}, u AS (SELECT *, abs(wall_angle - 90) <= 45 AS upright FROM hm), v AS (SELECT *, CASE WHEN upright THEN by_ - y0 ELSE bx - x0 END AS width, CASE WHEN upright THEN bx - x0 ELSE by_ - y0 END AS side, CASE WHEN upright THEN abs(cx - x1) ELSE abs(cy - y1) END AS off FROM u), d AS (SELECT *, least(thickness, greatest(side, least(thickness, 80))) AS depth, unnest(generate_series(-150, 150, 20)) AS step FROM v), i AS (SELECT *, greatest(0, width - abs(step)) * greatest(0, least(off + side / 2, depth / 2) - greatest(off - side / 2, -depth / 2)) AS shared FROM d), j AS (SELECT *, round(shared / (width * side + width * depth - shared) + 1e-9, 6) AS iou FROM i), b AS (SELECT *, row_number() OVER (PARTITION BY plan_id, det_id ORDER BY iou DESC, step) AS k FROM j) SELECT plan_id, det_id, CASE WHEN iou >= 0.05e0 THEN CAST(step AS BIGINT) END AS step, CASE WHEN iou >= 0.05e0 THEN iou ELSE 0 END AS iou FROM b WHERE k = 1")
def c30(spark, sf):
    """Two centres, sixteen offsets each; the rectangle that overlaps the detection most wins."""
    w = tilted_walls(spark, sf)
    return O.fit_opening(assigned(spark, sf), rect_openings(spark, sf), w).select("plan_id", "det_id", F.col("step").cast("long").alias("step"), "iou")


PLACED = """p AS (SELECT plan_id, det_id, wall_id, thickness, length, along, across, s, x1, y1, x2, y2, kind, (bx - x0) * abs(ux) + (by_ - y0) * abs(uy) AS span, (bx - x0) * abs(uy) + (by_ - y0) * abs(ux) AS side FROM hm), pl AS (SELECT *, greatest(span, CASE WHEN kind = 'DOOR' THEN 450 ELSE 600 END) AS width, greatest(least(thickness, greatest(side, least(thickness, 80))), least(thickness, 40)) AS depth FROM p)"""


@query("c31_opening_placement", f"{OT}, {PLACED} SELECT plan_id, det_id, wall_id, {s6('width')} AS width, {s6('depth')} AS depth, {s6('x1 + s * (x2 - x1)')} AS cx, {s6('y1 + s * (y2 - y1)')} AS cy FROM pl")
def c31(spark, sf):
    """Width is the opening's span along the axis, depth follows its span across, the centre lies on the axis."""
    p = O.opening_placement(assigned(spark, sf), rect_openings(spark, sf), tilted_walls(spark, sf))
    return p.select("plan_id", "det_id", "wall_id", *[r6(F.col(c)).alias(c) for c in ("width", "depth", "cx", "cy")])


@query("c32_fit_inside", f"{OT}, {PLACED}, sc AS (SELECT *, unnest([1e0, 0.98e0, 0.95e0, 0.9e0, 0.85e0, 0.8e0, 0.7e0, 0.6e0, 0.5e0]) AS scale FROM pl), fit AS (SELECT plan_id, det_id, max(scale) AS scale FROM sc WHERE round(scale / 2 * width, 6) <= round(length / 2 - abs(s * length - length / 2) - 5, 6) AND round(scale / 2 * depth, 6) <= round(thickness / 2 - 5, 6) AND (scale = 1 OR round(scale * width, 6) >= 100 AND round(scale * depth, 6) >= 40) GROUP BY plan_id, det_id) SELECT DISTINCT pl.plan_id, pl.det_id, scale FROM pl LEFT JOIN fit USING (plan_id, det_id)")
def c32(spark, sf):
    """The largest size at which the placed opening lies inside its wall by 5 mm, along and across."""
    w = tilted_walls(spark, sf)
    placed = O.opening_placement(assigned(spark, sf), rect_openings(spark, sf), w)
    return O.fit_inside(placed, w).select("plan_id", "det_id", "scale").distinct()


@query("c33_axes_by_wall", f"{CTE} SELECT w.plan_id, w.det_id, count(*) AS n_axes, {s6('sum(a.len)')} AS length FROM wall w JOIN wall a ON w.plan_id = a.plan_id AND w.det_id = a.det_id GROUP BY w.plan_id, w.det_id")
def c33(spark, sf):
    w = walls(spark, sf)
    return w.select("plan_id", "det_id").join(w.select("plan_id", "det_id", "len"), ["plan_id", "det_id"]).groupBy("plan_id", "det_id").agg(F.count("*").alias("n_axes"), r6(F.sum("len")).alias("length"))


@query("c34_coregistration", f"{CTE}, m AS (SELECT plan_id, max(bx) FILTER (WHERE line_no % 3 = 0) AS w1, max(bx) FILTER (WHERE line_no % 3 = 1) AS w2, max(bx) FILTER (WHERE line_no % 3 = 2) AS w3 FROM det GROUP BY plan_id) SELECT plan_id, CASE WHEN greatest(abs(w1 - w2), abs(w1 - w3)) <= 1 THEN 'aligned' WHEN greatest(abs(w1 - w2), abs(w1 - w3)) > 5 THEN 'reject' ELSE 'scale' END AS verdict FROM m WHERE w1 IS NOT NULL AND w2 IS NOT NULL AND w3 IS NOT NULL")
def c34(spark, sf):
    """Three models of a plan: equal sizes, rescalable sizes, or rejected."""
    d = detections(spark, sf)
    m = [d.where(F.pmod("line_no", F.lit(3)) == i).groupBy("plan_id").agg(F.max("bx").alias(f"w{i}")) for i in range(3)]
    j = m[0].join(m[1], "plan_id").join(m[2], "plan_id").withColumn("d", F.greatest(F.abs(F.col("w0") - F.col("w1")), F.abs(F.col("w0") - F.col("w2"))))
    return j.select("plan_id", F.when(F.col("d") <= 1, "aligned").when(F.col("d") > 5, "reject").otherwise("scale").alias("verdict"))


def hull_sql(points: str) -> str:
    """SQL CTEs: ``hull`` has the sides (ax, ay to bx, by_) of each plan's convex hull, turning left, of ``points`` (plan_id, x, y)."""
    turn = "((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))"
    beyond = "((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - b.x) * (b.x - a.x) + (c.y - b.y) * (b.y - a.y) > 0)"
    return f"""hp0 AS ({points}), hx AS (SELECT plan_id, x, min(y) AS lo, max(y) AS hi FROM hp0 GROUP BY plan_id, x), hp AS (SELECT plan_id, x, lo AS y FROM hx UNION SELECT plan_id, x, hi FROM hx),
hpp AS (SELECT a.plan_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, bool_or({turn} < 0 OR ({turn} = 0 AND {beyond})) AS cut FROM hp a JOIN hp b ON a.plan_id = b.plan_id AND (a.x <> b.x OR a.y <> b.y) JOIN hp c ON a.plan_id = c.plan_id GROUP BY a.plan_id, a.x, a.y, b.x, b.y),
hull AS (SELECT plan_id, ax, ay, bx, by_ FROM hpp WHERE NOT cut)"""


@query("c35_perimeter_external", f"{CTE}, {hull_sql('SELECT plan_id, ax1 AS x, ay1 AS y FROM wall UNION SELECT plan_id, ax2, ay2 FROM wall')}, hd AS (SELECT w.plan_id, w.det_id, w.thk, round(min(least({seg('w.ax1', 'w.ay1', 'h.ax', 'h.ay', 'h.bx', 'h.by_')}, {seg('w.ax2', 'w.ay2', 'h.ax', 'h.ay', 'h.bx', 'h.by_')})), 6) AS distance FROM wall w JOIN hull h ON w.plan_id = h.plan_id GROUP BY w.plan_id, w.det_id, w.thk) SELECT plan_id, det_id, thk >= 200 OR distance <= greatest(300, least(1.5e0 * thk, 600)) AS external FROM hd")
def c35(spark, sf):
    """Thick walls and walls near the plan's hull are external."""
    return perimeter_external(axis_walls(spark, sf)).select("plan_id", "det_id", "external").distinct()


@query("c36_opening_inside_ratio", f"{OT}, wr AS (SELECT *, thickness / 2 AS h FROM tw WHERE length > 0), {sides_sql('ws', 'wr', WALL_CORNERS)}, {strips_sql('wt', 'ws')}, {sides_sql('os', 'op', [('x0', 'y0'), ('bx', 'y0'), ('bx', 'by_'), ('x0', 'by_')])}, {strips_sql('ot', 'os')}, ins AS (SELECT hit.plan_id, hit.det_id, abs(sum({shared_sql('p', 'q')})) AS i FROM hit JOIN ot p ON hit.plan_id = p.plan_id AND hit.det_id = p.det_id JOIN wt q ON hit.plan_id = q.plan_id AND wall_id = q.det_id GROUP BY hit.plan_id, hit.det_id), fin AS (SELECT hit.plan_id, hit.det_id, wall_id, i, (bx - x0) * (by_ - y0) AS a FROM hit JOIN op USING (plan_id, det_id) JOIN ins USING (plan_id, det_id)) SELECT plan_id, det_id, wall_id, round(i + 1e-7, 3) AS inside_area, round(greatest(0, a - i) + 1e-7, 3) AS outside_area, round(i / a + 1e-9, 6) AS inside_ratio FROM fin")
def c36(spark, sf):
    """Area of an opening inside and outside its wall, which may run at any angle."""
    r = SP.opening_inside_ratio(rect_openings(spark, sf), assigned(spark, sf), tilted_walls(spark, sf))
    r3 = lambda c: F.round(F.col(c) + 1e-7, 3).alias(c)
    return r.select("plan_id", "det_id", "wall_id", r3("inside_area"), r3("outside_area"), F.round(F.col("inside_ratio") + 1e-9, 6).alias("inside_ratio"))

"""Composite pipelines (P rows), user steps (J rows) and the sources' and sinks' column logic (A rows)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.functions import labels as L
from planlake.functions.steps import STANDARD_STEPS, apply_steps, numpy_step, register_sql
from planlake.plans import agg_queries as A
from planlake.plans import join_queries as J
from planlake.operators import merge as M
from planlake.operators import quality as Q
from planlake.operators import repair as R
from planlake.operators import spaces as SP
from planlake.operators import walls as W
from planlake.plans import graph_queries as GQ
from planlake.plans.demo import CTE, TILT, axis_walls, detections, rect_openings, tilted_walls, walls
from planlake.plans.registry import QUERIES, SQL, query, r6, s6
from planlake.plans.scalar_queries import AREA, EXT, near_sql
from planlake.session import materialize
from planlake.sources import readers, writers

K = ("plan_id", "det_id")


@query("a04_coerce_points", f"{CTE} SELECT plan_id, det_id, 3 AS n, x1 AS ax, y2 AS by_, x3 AS cx FROM det")
def a04(spark, sf):
    """Three spellings of a point; a bad one is skipped."""
    j = F.array(F.to_json(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))), F.to_json(F.array("x2", "y2")), F.lit('{"x": "no"}'), F.to_json(F.create_map(F.lit("0"), F.col("x3"), F.lit("1"), F.col("y3"))))
    d = detections(spark, sf).withColumn("p", readers.coerce_points(j))
    return d.select(*K, F.size("p").alias("n"), F.col("p")[0]["x"].alias("ax"), F.col("p")[1]["y"].alias("by_"), F.col("p")[2]["x"].alias("cx"))


@query("a05_to_detections", f"{CTE} SELECT plan_id, det_id, label, CASE WHEN line_no = 7 THEN 0e0 ELSE confidence END AS confidence, x0, y0 FROM det")
def a05(spark, sf):
    d = detections(spark, sf)
    raw = d.select(*K, F.when(F.col("line_no") > 3, F.col("label")).otherwise("").alias("class"), F.col("label"), F.when(F.col("line_no") == 7, "bad").otherwise(F.col("confidence").cast("string")).alias("confidence"), (F.col("x0") + F.col("len") / 2).alias("x"), (F.col("y0") + F.col("thk") / 2).alias("y"), F.col("len").alias("width"), F.col("thk").alias("height"))
    return readers.to_detections(raw).select(*K, "label", "confidence", "x0", "y0")


@query("a08_geojson", f"{CTE} SELECT plan_id, count(*) AS n_features FROM wall GROUP BY plan_id")
def a08(spark, sf):
    """Documents are written per plan; here their features are counted back from the text."""
    g = writers.feature_collections(walls(spark, sf))
    return g.select("plan_id", F.size(F.from_json("geojson", "type string, features array<struct<type: string>>")["features"]).cast("long").alias("n_features"))


@query("j01_steps", f"{CTE} SELECT plan_id, det_id, 4 AS n, round_even(x1 / 10, 0) * 10 AS x, NULL::VARCHAR AS failed_step FROM det")
def j01(spark, sf):
    d = apply_steps(detections(spark, sf), STANDARD_STEPS)
    return d.select(*K, F.size("points").alias("n"), F.col("points")[0]["x"].alias("x"), "failed_step")


@query("j02_numpy_step", f"{CTE} SELECT plan_id, det_id, {s6('x3 * 2')} AS x FROM det")
def j02(spark, sf):
    d = apply_steps(detections(spark, sf).select(*K, "points"), {"double": numpy_step(lambda a: a * 2)})
    return d.select(*K, r6(F.col("points")[2]["x"]).alias("x"))


@query("j03_sql_functions", f"{CTE} SELECT plan_id, det_id, {s6(AREA)} AS area FROM det")
def j03(spark, sf):
    register_sql(spark)
    return detections(spark, sf).select(*K, F.expr("round(polygon_area(points), 6) + 0D").alias("area"))


OP = TILT[TILT.index("op AS (") :]
#: The demo's openings after cleaning: corners on the grid, sides square.
CLEAN_OP = f"op AS (SELECT *, (x0 + bx) / 2 AS cx, (y0 + by_) / 2 AS cy FROM (SELECT plan_id, det_id, kind, confidence, horizontal, len, thk, {', '.join(f'round_even({c} / 5e0, 0) * 5e0 AS {n}' for c, n in (('x0', 'x0'), ('y0', 'y0'), ('x2', 'bx'), ('y3', 'by_')))} FROM det WHERE kind IN ('DOOR', 'WINDOW') AND {A.REASON} IS NULL))"


@query("p01_clean_detections", f"SELECT d.plan_id, d.det_id, d.kind, d.x, c.wall_id, c.area AS clipped_area FROM ({CTE} SELECT plan_id, det_id, kind, round_even(x1 / 5e0, 0) * 5e0 AS x FROM det WHERE {A.REASON} IS NULL) d LEFT JOIN ({SQL['c10_nearest_wall_fix'].replace(OP, CLEAN_OP)}) c ON d.plan_id = c.plan_id AND d.det_id = c.det_id AND d.kind IN ('DOOR', 'WINDOW')")
def p01(spark, sf):
    """Valid rows simplified, snapped, straightened; openings clipped to the nearest axis-parallel wall."""
    d = detections(spark, sf).drop("x1", "y1", "x2", "y2")
    upright = tilted_walls(spark, sf).where("ux IN (0, 1)")
    c = R.clean_detections(d, Q.validation_reason(), upright)
    area = F.when(F.size("clipped") > 0, G.polygon_area(F.col("clipped"))).otherwise(F.when(F.col("wall_id").isNotNull(), 0.0))
    return c.select(*K, "kind", F.col("points")[0]["x"].alias("x"), "wall_id", r6(area).alias("clipped_area"))


@query("p02_normalize", f"{CTE} SELECT plan_id, det_id, kind AS type, {EXT} AS is_external, {s6('x3 / 2')} AS x FROM det WHERE confidence >= 0.5e0 AND kind <> 'other'")
def p02(spark, sf):
    d = detections(spark, sf).where("confidence >= 0.5")
    t = L.classify(F.col("label"))
    p = G.px_to_mm(F.col("points"), F.lit(2.0))
    d = d.withColumn("type", F.when(t == "stair", "STAIR").otherwise(t)).withColumn("p", p)
    return d.select(*K, "type", L.is_external(F.col("label")).alias("is_external"), r6(F.col("p")[2]["x"]).alias("x"))


@query("p03_wall_axes", f"{J.LABELS}, tied AS (SELECT plan_id, split_part(id, '#', 1) AS det_id, count(DISTINCT id) AS n FROM lab GROUP BY 1, 2), kept AS (SELECT w.* FROM wall w LEFT JOIN tied t ON w.plan_id = t.plan_id AND w.det_id = t.det_id WHERE NOT (len < 1500 AND coalesce(t.n, 0) >= 2)), ka AS (SELECT plan_id, det_id, ax1 AS x1, ay1 AS y1, ax2 AS x2, ay2 AS y2, thk AS thickness FROM kept), {J.merged_sql('ka')}, pw AS (SELECT plan_id, sum(thickness * length) / sum(length) AS plan_width FROM merged GROUP BY plan_id) SELECT k.plan_id, det_id, CASE WHEN n_merged > 1 THEN 'merged' ELSE 'rectangle' END AS method, {s6('length')} AS length, {s6('thickness')} AS width, CASE WHEN abs(y2 - y1) <= abs(x2 - x1) THEN 0e0 ELSE 90e0 END AS angle, {s6('plan_width')} AS plan_width FROM merged k JOIN pw USING (plan_id)")
def p03(spark, sf):
    """Axes of the walls' boxes; axes below 1500 mm between shared ends go; those on one line are merged."""
    w = walls(spark, sf).withColumn("points", F.array(*[G.point(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("bx", "y0"), ("bx", "by_"), ("x0", "by_"))]))
    a = R.wall_axes(w, 1500.0)
    return a.select(*K, "method", r6(W.length()).alias("length"), r6(F.col("thickness")).alias("width"), r6(G.line_angle(*W.cols(""))).alias("angle"), r6(F.col("plan_width")).alias("plan_width"))


GRAPH_SQL = SQL["k01_wall_graph"]
#: Counters and issues of each plan from the parts' SQL: connections (K1), overlaps (C18, within 20), hosts.
QA_SQL = f"""SELECT w.plan_id, walls, connected, 0 AS connectivity_issues, coalesce(overlap_issues, 0) AS overlap_issues, coalesce(openings, 0) AS openings, coalesce(in_walls, 0) AS in_walls, coalesce(rooms, 0) AS rooms, coalesce(bounded, 0) AS bounded, coalesce(room_issues, 0) AS room_issues, coalesce(lost, 0) + coalesce(beyond, 0) AS opening_issues, coalesce(overlap_issues, 0) + coalesce(lost, 0) + coalesce(beyond, 0) + coalesce(room_issues, 0) AS total
FROM (SELECT t.plan_id, count(*) AS walls, count(*) FILTER (WHERE neighbours > 0) AS connected FROM ({TILT} SELECT * FROM tw) t LEFT JOIN ({GRAPH_SQL}) k ON t.plan_id = k.plan_id AND t.det_id = k.det_id GROUP BY t.plan_id) w
LEFT JOIN (SELECT plan_id, count(*) AS overlap_issues FROM ({SQL['c18_parallel_overlaps'].replace('< 200', '< 20')}) GROUP BY plan_id) o ON w.plan_id = o.plan_id
LEFT JOIN ({{hosts}}) h ON w.plan_id = h.plan_id
LEFT JOIN ({CTE} SELECT plan_id, count(*) AS rooms, count(*) FILTER (WHERE confidence >= 0.5e0) AS bounded, count(*) FILTER (WHERE thk < 200) AS room_issues FROM det WHERE kind = 'STAIR' GROUP BY plan_id) r ON w.plan_id = r.plan_id"""
BEYOND = "round(along - span / 2, 6) < -10 OR round(along + span / 2 - length, 6) > 10"
HOSTS_C3 = f"{J.OT}, {J.PLACED}, b AS (SELECT plan_id, count(*) AS in_walls, count(*) FILTER (WHERE {BEYOND}) AS beyond FROM pl GROUP BY plan_id), e AS (SELECT plan_id, count(*) AS openings, count(*) FILTER (WHERE wall_id IS NULL) AS lost FROM hit GROUP BY plan_id) SELECT e.plan_id, openings, lost, in_walls, beyond FROM e LEFT JOIN b ON e.plan_id = b.plan_id"


def rooms(spark, sf):
    """The demo's rooms: closed if at least 200 wide, bounded by walls if confident."""
    d = detections(spark, sf).where("kind = 'STAIR'")
    return d.select(*K, (F.col("len") * F.col("thk")).alias("area"), (F.col("thk") >= 200).alias("closed"), F.when(F.col("confidence") >= 0.5, 2).otherwise(0).alias("n_walls"))


@query("d05_plan_qa", QA_SQL.format(hosts=HOSTS_C3))
def d05(spark, sf):
    """Counters and the four lists of issues by plan, counted."""
    w = tilted_walls(spark, sf)
    return Q.plan_qa(w, GQ.k01(spark, sf), rect_openings(spark, sf), J.assigned(spark, sf).select(*K, "wall_id"), rooms(spark, sf))


MERGE_SQL = f"{J.PLACE}, {J.THIRD}, op2 AS (SELECT * REPLACE (x0 + x0 % 200 AS x0, bx + x0 % 200 AS bx, cx + x0 % 200 AS cx) FROM op WHERE confidence >= 0.4e0), bare AS (SELECT * FROM op2 a WHERE NOT EXISTS (SELECT 1 FROM op b WHERE a.plan_id = b.plan_id AND {J.IOU} > 0.5e0 * {J.UNION})), {J.measured('y', 'bare')}, yk AS (SELECT *, row_number() OVER (PARTITION BY plan_id, det_id ORDER BY axis_distance, wall_id) AS k FROM y WHERE axis_distance <= 50), merged AS (SELECT p.plan_id, p.det_id, p.wall_id, i.other, CASE WHEN i.other IS NULL THEN 'first' ELSE 'third' END AS source FROM placed p LEFT JOIN instead i ON p.plan_id = i.plan_id AND p.det_id = i.det_id WHERE p.wall_id IS NOT NULL UNION ALL SELECT DISTINCT plan_id, det_id, wall_id, NULL, 'second' FROM yk WHERE k = 1)"


def models(spark, sf):
    """Openings of three models: the demo's, those moved a little, those moved farther."""
    return rect_openings(spark, sf), J.moved_openings(spark, sf), J.moved_openings(spark, sf, 200).where("confidence >= 0.4")


@query("g03_opening_union", f"{MERGE_SQL} SELECT * FROM merged")
def g03(spark, sf):
    """First model's openings, those replaced by the third's, and what only the second saw."""
    return M.merge_openings(tilted_walls(spark, sf), *models(spark, sf))


HOSTS_P4 = f"{MERGE_SQL}, hm AS (SELECT DISTINCT m.*  FROM m JOIN merged g ON m.plan_id = g.plan_id AND m.det_id = g.det_id AND m.wall_id = g.wall_id AND g.source <> 'second'), {J.PLACED}, b AS (SELECT plan_id, count(*) AS in_walls, count(*) FILTER (WHERE {BEYOND}) AS beyond FROM pl GROUP BY plan_id), e AS (SELECT plan_id, count(*) AS openings, count(*) FILTER (WHERE wall_id IS NULL) AS lost FROM placed GROUP BY plan_id) SELECT e.plan_id, openings, lost, in_walls, beyond FROM e LEFT JOIN b ON e.plan_id = b.plan_id"


@query("p04_merge_models", f"SELECT q.plan_id, v.verdict, coalesce(matched, 0) AS matched, coalesce(own, 0) AS own, coalesce(instead, 0) AS instead, coalesce(added, 0) AS added, q.connected, q.in_walls, q.total FROM ({QA_SQL.format(hosts=HOSTS_P4)}) q LEFT JOIN ({SQL['c34_coregistration']}) v ON q.plan_id = v.plan_id LEFT JOIN (SELECT plan_id, count(*) AS matched FROM ({SQL['c07_match_walls']}) GROUP BY plan_id) c ON q.plan_id = c.plan_id LEFT JOIN (SELECT plan_id, count(*) FILTER (WHERE source = 'first') AS own, count(*) FILTER (WHERE source = 'third') AS instead, count(*) FILTER (WHERE source = 'second') AS added FROM ({MERGE_SQL} SELECT * FROM merged) GROUP BY plan_id) g ON q.plan_id = g.plan_id")
def p04(spark, sf):
    """Models of a plan: alignment, matched walls, openings by source, and the QA of the result."""
    w = tilted_walls(spark, sf)
    m = M.merge_models(w, J.shifted(w, 12.0), GQ.k01(spark, sf), *models(spark, sf), rooms(spark, sf))
    matched = m.walls.groupBy("plan_id").agg(F.count("*").alias("matched"))
    count = lambda source, name: F.count_if(F.col("source") == source).alias(name)
    sources = m.openings.groupBy("plan_id").agg(count("first", "own"), count("third", "instead"), count("second", "added"))
    out = m.qa.select("plan_id", "connected", "in_walls", "total").join(J.c34(spark, sf), "plan_id", "left").join(matched, "plan_id", "left").join(sources, "plan_id", "left")
    return out.na.fill(0, ["matched", "own", "instead", "added"])


#: The moved ends without rounding, so that what follows starts from the same figures in both engines.
MOVED = re.sub(r"\(round\(CAST\((coalesce\([pq]\.[xy], a[xy][12]\)) AS DOUBLE\) \+ 1e-09, 6\) \+ 0\.0\)", r"\1", SQL["c14_close_gaps"])
REPAIRED = f"{J.OT}, {J.PLACED}, sc AS (SELECT *, unnest([1e0, 0.98e0, 0.95e0, 0.9e0, 0.85e0, 0.8e0, 0.7e0, 0.6e0, 0.5e0]) AS scale FROM pl), fit AS (SELECT plan_id, det_id, max(scale) AS scale FROM sc WHERE scale * width / 2 <= round(length / 2 - abs(along - length / 2) - 5, 6) AND scale * depth / 2 <= round(thickness / 2 - abs(across) - 5, 6) AND (scale = 1 OR scale * width >= 100 AND scale * depth >= 40) GROUP BY plan_id, det_id) SELECT DISTINCT pl.plan_id, pl.det_id, wall_id, {s6('width')} AS width, {s6('depth')} AS depth FROM pl LEFT JOIN fit USING (plan_id, det_id)"


@query("p05_repair_axes", REPAIRED.replace("tw AS (SELECT * FROM tilt WHERE kind = 'WALL')", f"va AS (SELECT v.plan_id, v.det_id, v.x1, v.y1, v.x2, v.y2, {near_sql('thk')} AS thickness FROM ({MOVED}) v JOIN det ON v.plan_id = det.plan_id AND v.det_id = det.det_id WHERE (v.x2 - v.x1) ** 2 + (v.y2 - v.y1) ** 2 > 0), {J.merged_sql('va')}, tw AS (SELECT v.plan_id, v.det_id, sqrt((v.x2 - v.x1) ** 2 + (v.y2 - v.y1) ** 2) AS length, (v.x2 - v.x1) / sqrt((v.x2 - v.x1) ** 2 + (v.y2 - v.y1) ** 2) AS ux, (v.y2 - v.y1) / sqrt((v.x2 - v.x1) ** 2 + (v.y2 - v.y1) ** 2) AS uy, v.x1, v.y1, v.x2, v.y2, v.thickness FROM merged v)").replace("WITH base", "WITH RECURSIVE base", 1))
def p05(spark, sf):
    """Thickness to the standards, axes to the bases, gaps closed, axes on one line merged, openings assigned and placed anew."""
    w = axis_walls(spark, sf).select(*K, "label", *W.AXIS, "thickness")
    _, o = R.repair_axes(w, rect_openings(spark, sf), L.is_external(F.col("label")))
    return o.select(*K, "wall_id", r6(F.col("width")).alias("width"), r6(F.col("depth")).alias("depth")).distinct()


@query("p04_merge_with_rooms")
def p04r(spark, sf):
    """The QA of models merged with the rooms that their walls enclose, and the walls at each room (K3, C8); no SQL, as K3's polygons have none."""
    w = tilted_walls(spark, sf)
    m = M.merge_models(w, J.shifted(w, 12.0), GQ.k01(spark, sf), *models(spark, sf))
    return m.qa.select("plan_id", "walls", "rooms", "bounded", "room_issues", "total")


@query("p06_validation_report", f"SELECT s.plan_id, s.mean, s.passed, s.overall, c.severity, coalesce(g.gaps, 0) AS gaps FROM ({SQL['d07_report_summary']}) s LEFT JOIN ({SQL['d09_pre_export_checks']}) c ON s.plan_id = c.plan_id LEFT JOIN (SELECT plan_id, count(*) AS gaps FROM ({SQL['c12_gap_proposals']}) GROUP BY plan_id) g ON s.plan_id = g.plan_id")
def p06(spark, sf):
    """Checks before export, gap proposals, scores of every wall and their summary."""
    g = J.c12(spark, sf).groupBy("plan_id").agg(F.count("*").alias("gaps"))
    c = A.d09(spark, sf).select("plan_id", "severity")
    r = A.d07(spark, sf).select("plan_id", "mean", "passed", "overall").join(c, "plan_id", "left").join(g, "plan_id", "left")
    return r.na.fill(0, ["gaps"])


#: Check, the part that answers it, and how its rows become a number: (what the SQL counts, what Spark counts).
COMPLIANCE = (
    ("not_ready", "d10_readiness", "count(*) FILTER (WHERE readiness < 60)"),
    ("failed_plans", "d11_worst_status", "count(*) FILTER (WHERE status = 'fail')"),
    ("highlighted", "d12_highlights", "sum(n)"),
    ("walls", "d13_element_counts", "sum(wall)"),
    ("without_u_value", "d23_thermal_gaps", "sum(n)"),
    ("duplicate_guids", "d25_duplicate_guids", "count(*)"),
    ("low_material_coverage", "d26_material_coverage", "count(*) FILTER (WHERE warned)"),
    ("unclassified", "d27_classification_stats", "sum(unclassified)"),
    ("incomplete_plans", "d34_element_completeness", "count(*) FILTER (WHERE final = 'FAILED')"),
    ("split_levels", "e02_split_levels", "count(*) FILTER (WHERE split)"),
)


@query("p07_model_compliance", " UNION ALL ".join([f"SELECT issue, CAST(n AS BIGINT) AS n FROM ({SQL['c26_referential_checks']})", *[f"SELECT '{name}', CAST(coalesce({number}, 0) AS BIGINT) FROM ({SQL[part]})" for name, part, number in COMPLIANCE]]))
def p07(spark, sf):
    """Every check of a model in one table of numbers, out of the parts' results."""
    out = J.c26(spark, sf).select("issue", F.col("n").cast("long").alias("n"))
    for name, part, number in COMPLIANCE:
        one = QUERIES[part](spark, sf).agg(F.expr(f"CAST(coalesce({number}, 0) AS BIGINT)").alias("n"))
        out = out.unionByName(one.select(F.lit(name).alias("issue"), "n"))
    return out


@query("p08_reconnect_proposals", f"SELECT c.plan_id, touching, gaps, coalesce(shared, 0) AS shared, coalesce(highlighted, 0) AS highlighted, gaps = 0 AND coalesce(n_spaces, 0) > 0 AS closed FROM (SELECT plan_id, count(*) FILTER (WHERE contact = 'touch') AS touching, count(*) FILTER (WHERE contact = 'gap') AS gaps FROM ({SQL['c21_contact_proposals']}) GROUP BY plan_id) c LEFT JOIN (SELECT plan_id, sum(n_spaces)::BIGINT AS shared FROM ({SQL['c25_shared_spaces']}) GROUP BY plan_id) s ON c.plan_id = s.plan_id LEFT JOIN ({J.SPACES} SELECT plan_id, count(*) AS n_spaces FROM space GROUP BY plan_id) n ON c.plan_id = n.plan_id LEFT JOIN (SELECT plan_id, count(DISTINCT id) AS highlighted FROM (SELECT plan_id, unnest([a_det_id, b_det_id]) AS id FROM ({SQL['c21_contact_proposals']}) WHERE contact = 'gap') GROUP BY plan_id) h ON c.plan_id = h.plan_id")
def p08(spark, sf):
    """Contacts and gaps, spaces that both walls of a contact bound, walls to look at (D12); rooms are closed if there are spaces and no gaps."""
    found = materialize(J.contacts(spark, sf), "contacts")
    c = found.groupBy("plan_id").agg(F.count_if(F.col("contact") == "touch").alias("touching"), F.count_if(F.col("contact") == "gap").alias("gaps"))
    s = SP.contacts_at_spaces(J.spaces(spark, sf), tilted_walls(spark, sf), 20.0).groupBy("plan_id").agg(F.sum("n_spaces").alias("shared"))
    n = J.spaces(spark, sf).groupBy("plan_id").agg(F.count("*").alias("n_spaces"))
    h = found.where("contact = 'gap'").select("plan_id", F.explode(F.array("a_id", "b_id")).alias("id")).groupBy("plan_id").agg(F.count_distinct("id").alias("highlighted"))
    j = c.join(s, "plan_id", "left").join(n, "plan_id", "left").join(h, "plan_id", "left").na.fill(0, ["shared", "n_spaces", "highlighted"])
    return j.select("plan_id", "touching", "gaps", "shared", "highlighted", ((F.col("gaps") == 0) & (F.col("n_spaces") > 0)).alias("closed"))


@query("p09_analyze", f"SELECT d.label, d.n, d.valid, coalesce(z.n, 0) AS in_west, l.positive, l.negative FROM ({SQL['d01_class_counts']}) d LEFT JOIN ({SQL['c01_zone_counts']}) z ON d.label = z.label AND z.zone = 'west' LEFT JOIN ({SQL['c02_line_counts']}) l ON d.label = l.label")
def p09(spark, sf):
    """Counts by class, zone and side of a line."""
    zone = J.c01(spark, sf).where("zone = 'west'").select("label", F.col("n").alias("in_west"))
    line = J.c02(spark, sf).select("label", "positive", "negative")
    return A.d01(spark, sf).select("label", "n", "valid").join(zone, "label", "left").join(line, "label", "left").na.fill(0, ["in_west"])

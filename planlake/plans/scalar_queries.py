"""Queries of the scalar operators (B rows), each over all detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.functions import labels as L
from planlake.plans.config import with_fidelity
from planlake.plans.demo import CTE, detections
from planlake.operators.quality import validation_reason
from planlake.operators.rings import with_least_rect
from planlake.plans.registry import query, r6, s6

K = ("plan_id", "det_id")
NORM = "replace(replace(replace(lower(label), '-', ''), '_', ''), ' ', '')"
PER_MM = "(1.0e0 + plan_id % 4)"


def per_mm():
    return F.lit(1.0) + F.pmod("plan_id", F.lit(4))


def det(cols: str, extra: str = "det") -> str:
    return f"{CTE} SELECT plan_id, det_id, {cols} FROM {extra}"


def dist(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"


AREA = "(abs(" + " + ".join(f"(x{i} * y{i % 4 + 1} - x{i % 4 + 1} * y{i})" for i in range(1, 5)) + ") / 2)"


def seg(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> str:
    """SQL: distance of a point to a segment."""
    l2 = f"(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"
    s = f"least(1, greatest(0, (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / {l2}))"
    return f"sqrt(({px} - {x1} - {s} * ({x2} - {x1})) ** 2 + ({py} - {y1} - {s} * ({y2} - {y1})) ** 2)"


CX, CY = "((x1 + x2 + x3 + x4) / 4)", "((y1 + y2 + y3 + y4) / 4)"
THICK = "2 * least(" + ", ".join(seg(CX, CY, f"x{i}", f"y{i}", f"x{i % 4 + 1}", f"y{i % 4 + 1}") for i in range(1, 5)) + ")"


@query("b01_normalize_label", det(f"{NORM} AS label_norm"))
def b01(spark, sf):
    return detections(spark, sf).select(*K, L.normalize_label(F.col("label")).alias("label_norm"))


@query("b02_classify", det("CASE WHEN label LIKE '%all%' THEN 'WALL' WHEN label = 'Door' THEN 'DOOR' WHEN label = 'window' THEN 'WINDOW' WHEN label = 'stair' THEN 'STAIR' ELSE label END AS type"))
def b02(spark, sf):
    return detections(spark, sf).select(*K, L.classify(F.col("label")).alias("type"))


@query("b03_is_external", det("CASE WHEN label LIKE 'external%' THEN true WHEN lower(label) LIKE 'internal%' THEN false END AS is_external"))
def b03(spark, sf):
    return detections(spark, sf).select(*K, L.is_external(F.col("label")).alias("is_external"))


@query("b04_px_to_mm", det(f"{s6(f'x3 / {PER_MM}')} AS x, {s6(f'(4000 - y3) / {PER_MM}')} AS y"))
def b04(spark, sf):
    p = G.px_to_mm(F.col("points"), per_mm(), True, F.lit(4000.0))
    return detections(spark, sf).withColumn("p", p).select(*K, r6(F.col("p")[2]["x"]).alias("x"), r6(F.col("p")[2]["y"]).alias("y"))


@query("b05_precision_error", det("CASE WHEN e > 0.5 THEN 'error' WHEN e > 0.1 THEN 'warn' ELSE 'ok' END AS verdict", "(SELECT plan_id, det_id, greatest(" + ", ".join(f"abs(round({c}{i} / {PER_MM}) * {PER_MM} - {c}{i})" for i in range(1, 5) for c in "xy") + ") AS e FROM det)"))
def b05(spark, sf):
    e = G.precision_error(F.col("points"), per_mm(), 0)
    return detections(spark, sf).withColumn("e", e).select(*K, F.when(F.col("e") > 0.5, "error").when(F.col("e") > 0.1, "warn").otherwise("ok").alias("verdict"))


@query("b06_resolve_scale", f"{CTE} SELECT plan_id, max(CASE WHEN line_no = 1 THEN 2.0e0 END) AS given, coalesce(max(CASE WHEN line_no = 1 THEN 2.0e0 END), max(CASE WHEN line_no = 2 THEN 1.5e0 END), 1.0e0) AS px_per_mm, max(CASE WHEN line_no = 3 THEN y0 END) IS NOT NULL AS flip FROM det GROUP BY plan_id")
def b06(spark, sf):
    """Payload, then calibration, then 1.0; the flip needs an image height."""
    d = detections(spark, sf).groupBy("plan_id").agg(F.max(F.when(F.col("line_no") == 1, 2.0)).alias("given"), F.max(F.when(F.col("line_no") == 2, 1.5)).alias("calibrated"), F.max(F.when(F.col("line_no") == 3, F.col("y0"))).alias("height"))
    return d.select("plan_id", "given", F.coalesce("given", "calibrated", F.lit(1.0)).alias("px_per_mm"), F.col("height").isNotNull().alias("flip"))


THRESHOLDS = {"Door": 0.7, "window": 0.6}


@query("b07_confidence_filter", det("confidence") + " WHERE confidence >= CASE label WHEN 'Door' THEN 0.7e0 WHEN 'window' THEN 0.6e0 ELSE 0.5e0 END")
def b07(spark, sf):
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in THRESHOLDS.items() for v in kv]), F.col("label")), F.lit(0.5))
    return detections(spark, sf).where(F.col("confidence") >= limit).select(*K, "confidence")


@query("b08_filter_noise", det("confidence") + f" WHERE confidence >= 0.7e0 AND {THICK} >= 120")
def b08(spark, sf):
    return detections(spark, sf).where((F.col("confidence") >= 0.7) & (G.polygon_thickness(F.col("points")) >= 120)).select(*K, "confidence")


@query("b09_view_filter", f"SELECT event_id, value FROM events WHERE event_type NOT LIKE '%click%' AND (value >= 20 OR value IS NULL OR isnan(value))")
def b09(spark, sf):
    """Labels with the hidden word go; values below the threshold go, non-finite ones stay."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    v = F.col("value")
    return e.where(~F.lower("event_type").contains("click") & (v.isNull() | F.isnan(v) | (v >= 20))).select("event_id", "value")


@query("b10_validation_reason", det(f"CASE WHEN confidence < 0.5e0 THEN 'confidence' WHEN {AREA} < 30000 THEN 'geometry' WHEN kind = 'WALL' AND greatest(len, thk) < 500 THEN 'wall too short' WHEN kind = 'WALL' AND greatest(len, thk) > 3000 THEN 'wall too long' END AS reason"))
def b10(spark, sf):
    return detections(spark, sf).select(*K, validation_reason().alias("reason"))


@query("b11_ring", det("5 AS n, x1 AS last_x, y1 AS last_y"))
def b11(spark, sf):
    d = detections(spark, sf).withColumn("r", G.ring(G.ring(F.col("points"))))
    return d.select(*K, F.size("r").alias("n"), F.element_at("r", -1)["x"].alias("last_x"), F.element_at("r", -1)["y"].alias("last_y"))


@query("b12_polygon_area", det(f"{s6(AREA)} AS area"))
def b12(spark, sf):
    return detections(spark, sf).select(*K, r6(G.polygon_area(F.col("points"))).alias("area"))


@query("b13_bounds", f"{CTE} SELECT plan_id, round(min(least(x1, x2, x3, x4)), 4) AS x0, round(min(least(y1, y2, y3, y4)), 4) AS y0, round(max(greatest(x1, x2, x3, x4)), 4) AS x1, round(max(greatest(y1, y2, y3, y4)), 4) AS y1 FROM det GROUP BY plan_id")
def b13(spark, sf):
    d = detections(spark, sf).select("plan_id", G.bounds(F.col("points")).alias("b"))
    return d.groupBy("plan_id").agg(*[F.round(f(f"b.{c}"), 4).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


GRID = "(CASE WHEN kind = 'WALL' THEN 50e0 ELSE 10e0 END)"


@query("b14_snap_to_grid", det(f"round_even(x3 / {GRID}, 0) * {GRID} AS x, round_even(y3 / {GRID}, 0) * {GRID} AS y"))
def b14(spark, sf):
    p = G.snap_to_grid(F.col("points"), F.when(F.col("kind") == "WALL", 50.0).otherwise(10.0))
    return detections(spark, sf).withColumn("p", p).select(*K, F.col("p")[2]["x"].alias("x"), F.col("p")[2]["y"].alias("y"))


@query("b15_polygon_thickness", det(f"{s6(THICK)} AS thickness"))
def b15(spark, sf):
    return detections(spark, sf).select(*K, r6(G.polygon_thickness(F.col("points"))).alias("thickness"))


@query("b16_drop_collinear", det("4 AS n"))
def b16(spark, sf):
    """A point set in the middle of the first side goes again; the corners stay."""
    p = F.col("points")
    middle = G.point((p[0]["x"] + p[1]["x"]) / 2, (p[0]["y"] + p[1]["y"]) / 2)
    more = F.concat(F.slice(p, 1, 1), F.array(middle), F.slice(p, 2, 3))
    return detections(spark, sf).select(*K, F.size(G.drop_collinear(more, 2.0)).alias("n"))


@query("b17_right_angles", det("'HVHV' AS kinds, x2 AS x, y3 AS y, y3 AS last_y"))
def b17(spark, sf):
    p = F.col("points")
    d = detections(spark, sf).withColumn("r", G.right_angle(p))
    return d.select(*K, F.array_join(G.edge_kinds(p), "").alias("kinds"), F.col("r")[2]["x"].alias("x"), F.col("r")[2]["y"].alias("y"), F.col("r")[3]["y"].alias("last_y"))


@query("b18_line_measures", det(f"{s6('CASE WHEN horizontal THEN 0 ELSE 90 END')} AS angle, {s6('CASE WHEN horizontal THEN 30 ELSE 60 END')} AS delta, len AS length"))
def b18(spark, sf):
    a = G.line_angle(F.col("ax1"), F.col("ay1"), F.col("ax2"), F.col("ay2"))
    return detections(spark, sf).select(*K, r6(a).alias("angle"), r6(G.angle_delta(a, F.lit(150.0))).alias("delta"), G.hypot(F.col("ax2") - F.col("ax1"), F.col("ay2") - F.col("ay1")).alias("length"))


E4 = [f"((x{i % 4 + 1} - x{i}) ** 2 + (y{i % 4 + 1} - y{i}) ** 2)" for i in range(1, 5)]


@query("b19_longest_edge", det(f"{s6('greatest(' + ', '.join(E4) + ')')} AS len2"))
def b19(spark, sf):
    return detections(spark, sf).select(*K, r6(G.longest_edge(F.col("points"))["len2"]).alias("len2"))


def _rect_sql() -> str:
    """Areas of the rectangles along all vertex pairs; the least is the oriented one."""
    pairs = [(i, j) for i in range(1, 5) for j in range(i + 1, 5)]
    rows = ", ".join(f"(x{j} - x{i}, y{j} - y{i})" for i, j in pairs)
    u = "list_transform([(x1, y1), (x2, y2), (x3, y3), (x4, y4)], lambda p: (p[1] * d[1] + p[2] * d[2]) / sqrt(d[1] * d[1] + d[2] * d[2]))"
    v = "list_transform([(x1, y1), (x2, y2), (x3, y3), (x4, y4)], lambda p: (p[2] * d[1] - p[1] * d[2]) / sqrt(d[1] * d[1] + d[2] * d[2]))"
    return f"""{CTE}, dirs AS (SELECT *, unnest([{rows}]) AS d FROM det), ext AS (SELECT plan_id, det_id, list_max({u}) - list_min({u}) AS u, list_max({v}) - list_min({v}) AS v FROM dirs),
        r AS (SELECT plan_id, det_id, (round(u * v, 6), round(least(u, v), 6), round(greatest(u, v), 6)) AS r FROM ext)
        SELECT plan_id, det_id, min(r)[1] + 0.0 AS area, min(r)[2] + 0.0 AS width, min(r)[3] + 0.0 AS length FROM r GROUP BY plan_id, det_id"""


@query("b20_oriented_rect", _rect_sql())
def b20(spark, sf):
    d = with_least_rect(detections(spark, sf).dropDuplicates(["plan_id", "det_id"]), "points", "r")
    return d.select(*K, *[(F.col(f"r.{c}") + 0.0).alias(c) for c in ("area", "width", "length")])


EXT = "(CASE WHEN label LIKE 'external%' THEN true WHEN lower(label) LIKE 'internal%' THEN false END)"


def near_sql(v: str) -> str:
    best = "list_min([" + ", ".join(f"(abs({v} - {s}), {s})" for s in ("115e0", "240e0", "300e0", "400e0", "500e0")) + "])"
    return f"CASE WHEN {v} < 40 THEN CASE WHEN {EXT} THEN 240e0 ELSE 115e0 END WHEN {best}[1] > 10 THEN {best}[2] ELSE {v} END"


@query("b21_snap_thickness", det(f"{near_sql('(thk - 60)')} AS thickness"))
def b21(spark, sf):
    return detections(spark, sf).select(*K, G.snap_thickness(F.col("thk") - 60, L.is_external(F.col("label"))).alias("thickness"))


@query("b22_default_thickness", det(f"CASE WHEN {EXT} THEN 240e0 ELSE 115e0 END AS thickness"))
def b22(spark, sf):
    return detections(spark, sf).select(*K, G.default_thickness(L.is_external(F.col("label"))).alias("thickness"))


@query("b23_opening_vertical", det("CASE kind WHEN 'DOOR' THEN 0e0 ELSE 0.9e0 END AS sill, CASE kind WHEN 'DOOR' THEN 2e0 ELSE 1.2e0 END AS height, CASE kind WHEN 'DOOR' THEN 2e0 ELSE greatest(2.1e0, round(0.9e0 + 1.2e0, 6)) END AS head, thk / 1000 AS depth", "opening"))
def b23(spark, sf):
    from planlake.operators.openings import with_vertical

    d = detections(spark, sf).where("kind IN ('DOOR', 'WINDOW')")
    return with_vertical(d, F.col("thk") / 1000).select(*K, "sill", "height", F.round("head", 6).alias("head"), "depth")


@query("b24_snap_axis", det(f"{s6('CASE WHEN horizontal THEN (ax1 + ax2) / 2 - sqrt(len * len + jit * jit) / 2 ELSE ax1 + jit / 2 END')} AS x1, {s6('CASE WHEN horizontal THEN ay1 + jit / 2 ELSE (ay1 + ay2) / 2 - sqrt(len * len + jit * jit) / 2 END')} AS y1"))
def b24(spark, sf):
    """Axes tilted by the jitter turn back to 0 or 90 degrees."""
    h, j = F.col("horizontal"), F.col("jit")
    x2, y2 = F.col("ax2") + F.when(h, 0.0).otherwise(j), F.col("ay2") + F.when(h, j).otherwise(0.0)
    s = G.snap_axis(F.col("ax1"), F.col("ay1"), x2, y2)
    return detections(spark, sf).withColumn("s", s).select(*K, r6(F.col("s.x1")).alias("x1"), r6(F.col("s.y1")).alias("y1"))


@query("b25_orthogonalize_polyline", det("x2 AS px, x2 AS qx, y3 AS qy"))
def b25(spark, sf):
    """Each point corrected by its corrected predecessor."""
    r = G.right_angle(F.slice(F.col("points"), 1, 3))
    return detections(spark, sf).withColumn("r", r).select(*K, F.col("r")[1]["x"].alias("px"), F.col("r")[2]["x"].alias("qx"), F.col("r")[2]["y"].alias("qy"))


@query("b26_rectangles", det(f"{s6('len * thk')} AS axis_area, {s6('len * thk')} AS centre_area, CASE WHEN horizontal THEN ax1 ELSE ax1 - thk / 2 END AS x, CASE WHEN horizontal THEN ay1 + thk / 2 ELSE ay1 END AS y"))
def b26(spark, sf):
    a = G.rect_from_axis(F.col("ax1"), F.col("ay1"), F.col("ax2"), F.col("ay2"), F.col("thk"))
    c = G.rect_from_centre(F.col("ax1"), F.col("ay1"), F.col("len"), F.col("thk"), F.lit(0.6), F.lit(0.8))
    return detections(spark, sf).withColumn("a", a).withColumn("c", c).select(*K, r6(G.polygon_area(F.col("a"))).alias("axis_area"), r6(G.polygon_area(F.col("c"))).alias("centre_area"), F.col("a")[0]["x"].alias("x"), F.col("a")[0]["y"].alias("y"))


PROJ = "least(1, greatest(0, ((1500 - ax1) * (ax2 - ax1) + (1500 - ay1) * (ay2 - ay1)) / ((ax2 - ax1) ** 2 + (ay2 - ay1) ** 2)))"


@query("b27_project_on_line", det(f"{s6(PROJ)} AS s, {s6(seg('1500', '1500', 'ax1', 'ay1', 'ax2', 'ay2'))} AS distance"))
def b27(spark, sf):
    p = G.project_on_line(F.lit(1500.0), F.lit(1500.0), *[F.col(c) for c in ("ax1", "ay1", "ax2", "ay2")])
    return detections(spark, sf).withColumn("p", p).select(*K, r6(F.col("p.s")).alias("s"), r6(F.col("p.distance")).alias("distance"))


@query("b28_apply_similarity", det(f"{s6('2 * (0.6e0 * x3 - 0.8e0 * y3) + 10')} AS x, {s6('2 * (0.8e0 * x3 + 0.6e0 * y3) - 5')} AS y"))
def b28(spark, sf):
    p = G.apply_similarity(F.col("points"), F.lit(2.0), F.lit(0.6), F.lit(0.8), F.lit(10.0), F.lit(-5.0))
    return detections(spark, sf).withColumn("p", p).select(*K, r6(F.col("p")[2]["x"]).alias("x"), r6(F.col("p")[2]["y"]).alias("y"))


@query("b29_fidelity_config", f"{CTE}, p(k, level, simplify_walls, grid_walls, angle_tolerance, snap_to_grid, max_gap_close) AS (VALUES (0, 'LOSSLESS', 0.1e0, 0e0, 0e0, false, NULL), (1, 'HIGH', 2e0, 2e0, 5e0, true, NULL), (2, 'MEDIUM', 5e0, 5e0, 10e0, true, 50e0), (3, 'LOW', 10e0, 10e0, 15e0, true, 20e0)) SELECT plan_id, det_id, simplify_walls, grid_walls, angle_tolerance, snap_to_grid, max_gap_close FROM det LEFT JOIN p ON k = plan_id % 5")
def b29(spark, sf):
    """Presets are a small config table joined on the plan's level; every fifth plan's level is unknown."""
    names = F.array(*map(F.lit, ("LOSSLESS", "HIGH", "MEDIUM", "LOW", "OTHER")))
    d = with_fidelity(detections(spark, sf).withColumn("level", F.element_at(names, (F.pmod("plan_id", F.lit(5)) + 1).cast("int"))))
    return d.select(*K, "simplify_walls", "grid_walls", "angle_tolerance", "snap_to_grid", "max_gap_close")


@query("b30_fix_window_height", det("CASE WHEN len >= 2100 THEN 2000e0 ELSE len END AS height, len >= 2100 AS warned", "opening"))
def b30(spark, sf):
    over = F.col("len") >= 2100
    return detections(spark, sf).where("kind IN ('DOOR', 'WINDOW')").select(*K, F.when(over, F.greatest(F.lit(2100.0 - 100), F.lit(100.0))).otherwise(F.col("len")).alias("height"), over.alias("warned"))


@query("b31_clean_name", "SELECT c_custkey, substr(CASE WHEN k = '' THEN 'Unnamed' ELSE k END, 1, 100) AS name FROM (SELECT c_custkey, trim(regexp_replace(regexp_replace(c_name || '#* ' || c_mktsegment, '[^a-zA-Z0-9\\s_-]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM customer)")
def b31(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", L.clean_name(F.concat("c_name", F.lit("#* "), "c_mktsegment")).alias("name"))


@query("b32_room_category", "SELECT doc_id, CASE WHEN t LIKE '%office%' OR t LIKE '%büro%' THEN 'OFFICE' WHEN t LIKE '%bedroom%' OR t LIKE '%schlafzimmer%' THEN 'BEDROOM' WHEN t LIKE '%kitchen%' OR t LIKE '%küche%' THEN 'KITCHEN' WHEN t LIKE '%bathroom%' OR t LIKE '%badezimmer%' OR t LIKE '%wc%' THEN 'BATHROOM' WHEN t LIKE '%living%' OR t LIKE '%wohnzimmer%' THEN 'LIVING_ROOM' ELSE 'UNKNOWN' END AS category FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def b32(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", L.room_category(F.col("text")).alias("category"))


@query("b33_scale_from_text", f"SELECT doc_id, {s6('CASE WHEN n > 0 THEN (400 / 25.4e0) / n ELSE 1 END')} AS px_per_mm, CASE WHEN n > 0 THEN 0.6e0 ELSE 0.1e0 END AS confidence FROM (SELECT doc_id, CAST(nullif(regexp_extract(text, '1:([0-9]{{2,4}})', 1), '') AS DOUBLE) AS n FROM documents)")
def b33(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("s", L.scale_from_text(F.col("text")))
    return d.select("doc_id", r6(F.col("s.px_per_mm")).alias("px_per_mm"), F.col("s.confidence").alias("confidence"))


@query("b34_score_component", det(f"{s6('greatest(0, 1 - least(abs(thk - 200), 100) / 100)')} AS score"))
def b34(spark, sf):
    return detections(spark, sf).select(*K, r6(G.score_component(F.col("thk") - 200, 100.0)).alias("score"))


@query("b35_checks", "SELECT event_id, coalesce(NOT isnan(try_cast(props AS DOUBLE)), false) AS number, coalesce(regexp_full_match(props, '[A-Za-z0-9_-]{22,}'), false) AS guid FROM events")
def b35(spark, sf):
    p = F.col("props")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.coalesce(L.is_number(p), F.lit(False)).alias("number"), L.is_guid_like(p).alias("guid"))


@query("b36_rect_check", det("CASE WHEN jit = 0 THEN thk ELSE NULL END AS thickness, jit = 0 AND len <> thk AS ok"))
def b36(spark, sf):
    d = detections(spark, sf).withColumn("c", G.rect_check(F.col("points"), 1.0))
    return d.select(*K, F.when(F.col("jit") == 0, F.least(F.col("c.thickness"), "len")).alias("thickness"), F.col("c.ok").alias("ok"))


@query("b37_section_filter", det("y0") + " WHERE 1000 BETWEEN y0 AND y0 + thk")
def b37(spark, sf):
    return detections(spark, sf).where(F.lit(1000.0).between(F.col("y0"), F.col("y0") + F.col("thk"))).select(*K, "y0")


@query("b38_axis_is_valid", det("len") + " WHERE len >= 60 AND thk BETWEEN 40 AND 1000 AND abs(jit) <= least(0.1e0 * len, 50)")
def b38(spark, sf):
    ok = (F.col("len") >= 60) & F.col("thk").between(40, 1000) & (F.abs("jit") <= F.least(F.col("len") * 0.1, F.lit(50.0)))
    return detections(spark, sf).where(ok).select(*K, "len")


@query("b39_space_filters", f"{CTE}, env AS (SELECT plan_id, min(x0) AS ex0, min(y0) AS ey0, max(greatest(bx, x3)) AS ex1, max(greatest(by_, y3)) AS ey1 FROM det WHERE kind = 'WALL' GROUP BY plan_id) SELECT d.plan_id, det_id FROM det d JOIN env USING (plan_id) WHERE {AREA} >= 1500 AND least(greatest(x2, x3) - x0, greatest(y3, y4) - y0) >= 200 AND x0 <= ex1 + 150 AND greatest(x2, x3) >= ex0 - 150 AND y0 <= ey1 + 150 AND greatest(y3, y4) >= ey0 - 150")
def b39(spark, sf):
    """Area, least side and nearness to the plan's envelope of walls, on all four sides."""
    d = detections(spark, sf)
    b = G.bounds(F.col("points"))
    env = d.where("kind = 'WALL'").groupBy("plan_id").agg(F.min(b["x0"]).alias("ex0"), F.min(b["y0"]).alias("ey0"), F.max(b["x1"]).alias("ex1"), F.max(b["y1"]).alias("ey1"))
    ok = G.space_filter(F.col("points"), *[F.col(c) for c in ("ex0", "ey0", "ex1", "ey1")])
    return d.join(env, "plan_id").where(ok).select(*K)


@query("b40_unit_m", det(f"{s6('x3 * 0.001e0')} AS x"))
def b40(spark, sf):
    p = F.transform("points", lambda q: G.point(q["x"] * 0.001, q["y"] * 0.001))
    return detections(spark, sf).select(*K, r6(p[2]["x"]).alias("x"))


@query("b41_page_filter", det("line_no") + " WHERE CASE WHEN line_no % 3 = 0 THEN NULL ELSE line_no % 3 END IS NULL OR line_no % 3 = 1")
def b41(spark, sf):
    d = detections(spark, sf).withColumn("page", F.when(F.col("line_no") % 3 != 0, F.col("line_no") % 3))
    return d.where(F.col("page").isNull() | (F.col("page") == 1)).select(*K, "line_no")


@query("b42_axis_measure", det("CASE WHEN line_no = 7 THEN 0 ELSE len END AS length, CASE WHEN line_no = 7 OR horizontal THEN 1e0 ELSE 0e0 END AS dx, CASE WHEN line_no = 7 OR horizontal THEN 0e0 ELSE 1e0 END AS dy"))
def b42(spark, sf):
    none = F.col("line_no") == 7
    m = G.axis_measure(F.col("ax1"), F.col("ay1"), F.when(none, F.col("ax1")).otherwise(F.col("ax2")), F.when(none, F.col("ay1")).otherwise(F.col("ay2")))
    return detections(spark, sf).withColumn("m", m).select(*K, "m.length", "m.dx", "m.dy")


MOVED = "greatest(0, len - abs(jit) * 40) * greatest(0, thk - line_no * 20)"


@query("c23_convex_clip", det(f"{s6(MOVED)} AS shared, {s6(f'{MOVED} / (2 * len * thk - {MOVED})')} AS iou"))
def c23(spark, sf):
    """Rectangles against themselves moved along and across, both turned, so that boxes tell the areas and polygons are clipped."""
    d = detections(spark, sf)
    h, along, across = F.col("horizontal"), F.abs("jit") * 40, F.col("line_no") * 20
    ring = lambda dx, dy: F.array(*[G.point(F.col(x) + dx, F.col(y) + dy) for x, y in (("x0", "y0"), ("bx", "y0"), ("bx", "by_"), ("x0", "by_"))])
    turned = lambda p: G.apply_similarity(p, F.lit(1.0), F.lit(0.6), F.lit(0.8), F.lit(0.0), F.lit(0.0))
    d = d.withColumns({"p": turned(ring(F.lit(0.0), F.lit(0.0))), "q": turned(ring(F.when(h, along).otherwise(across), F.when(h, across).otherwise(along)))})
    return d.select(*K, r6(G.shared_area(F.col("p"), F.col("q"))).alias("shared"), r6(G.iou(F.col("p"), F.col("q"))).alias("iou"))

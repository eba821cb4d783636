"""Queries of the aggregates, windows, sorts and set operations (D, E, F and G rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.functions import labels as L
from planlake.operators import openings as O
from planlake.operators import quality as Q
from planlake.operators import repair as R
from planlake.operators import walls as W
from planlake.operators.fits import fit_similarity, line_fit
from planlake.operators.spatial import best_match
from planlake.plans.demo import CTE, TILT, axis_walls, detections, openings, rect_openings, tilted_walls, walls
from planlake.plans.join_queries import LABELS, OT, REL_SQL, assigned, boundaries, c12, c14, contacts, elements, relations
from planlake.plans.registry import SQL, query, r6, s6
from planlake.plans.scalar_queries import AREA, EXT, near_sql

K = ("plan_id", "det_id")
#: B10's rule in SQL.
REASON = f"CASE WHEN confidence < 0.5e0 THEN 'confidence' WHEN {AREA} < 30000 THEN 'geometry' WHEN kind = 'WALL' AND greatest(len, thk) < 500 THEN 'wall too short' WHEN kind = 'WALL' AND greatest(len, thk) > 3000 THEN 'wall too long' END"


def agg(cols: str, by: str = "plan_id", src: str = "det", having: str = "") -> str:
    return f"{CTE} SELECT {by}, {cols} FROM {src} GROUP BY {by} {having}"


@query("d01_class_counts", agg(f"count(*) AS n, count(*) FILTER (WHERE {REASON} IS NULL) AS valid, count(*) FILTER (WHERE {REASON} IS NOT NULL) AS invalid", "label"))
def d01(spark, sf):
    r = Q.validation_reason()
    return detections(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.count_if(r.isNull()).alias("valid"), F.count_if(r.isNotNull()).alias("invalid"))


@query("d02_reject_counts", f"{CTE} SELECT CASE WHEN {REASON} LIKE 'wall%' THEN 'dimensions' ELSE {REASON} END AS bucket, count(*) AS n FROM det WHERE {REASON} IS NOT NULL GROUP BY 1")
def d02(spark, sf):
    """Buckets by rule, not by text."""
    return detections(spark, sf).select(Q.reject_bucket(Q.validation_reason()).alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


@query("d03_validation_summary", agg(f"bool_or({REASON} IS NULL) AS is_valid, count(*) FILTER (WHERE {REASON} IS NOT NULL) > count(*) FILTER (WHERE {REASON} IS NULL) AS warned"))
def d03(spark, sf):
    r = Q.validation_reason()
    return detections(spark, sf).groupBy("plan_id").agg(F.bool_or(r.isNull()).alias("is_valid"), (F.count_if(r.isNotNull()) > F.count_if(r.isNull())).alias("warned"))


@query("d04_quality_score", f"{TILT}, q AS (SELECT plan_id, avg(CASE WHEN {REASON} IS NULL THEN 1e0 ELSE 0 END) AS valid, avg(CASE WHEN kind = 'STAIR' THEN CASE WHEN thk >= 200 THEN 1e0 ELSE 0 END END) AS closed, avg(CASE WHEN kind = 'WALL' THEN CASE WHEN jit IN (-3, 2, 3) THEN 0e0 ELSE 1 END END) AS par, avg(confidence) AS mean, count(*) FILTER (WHERE line_no = 7) AS errors FROM det GROUP BY plan_id) SELECT plan_id, {s6('greatest(0, least(1, valid * coalesce(closed, 1) * coalesce(par, 1) * mean * (1 - least(0.1e0 * errors, 0.5e0))))')} AS score FROM q")
def d04(spark, sf):
    """Valid, closed and parallel rates and mean confidence, lowered by errors; axes are held against the sources' directions."""
    d = detections(spark, sf)
    w = tilted_walls(spark, sf).join(d.select("plan_id", "det_id", "horizontal"), list(K))
    off = G.angle_delta(G.line_angle(*W.cols("")), F.when(F.col("horizontal"), 0.0).otherwise(90.0))
    axes = w.groupBy("plan_id").agg(F.count("*").alias("axes"), F.count_if(off <= 10).alias("parallel"))
    room = F.col("kind") == "STAIR"
    c = d.groupBy("plan_id").agg(F.count("*").alias("n"), F.count_if(Q.validation_reason().isNull()).alias("valid"), F.count_if(room).alias("spaces"), F.count_if(room & (F.col("thk") >= 200)).alias("closed"), F.avg("confidence").alias("mean"), F.count_if(F.col("line_no") == 7).alias("errors"))
    c = c.join(axes, "plan_id", "left").na.fill(0, ["axes", "parallel"])
    return c.select("plan_id", r6(Q.quality_score(*[F.col(x) for x in ("n", "valid", "spaces", "closed", "axes", "parallel", "mean", "errors")])).alias("score"))


#: The built walls are the tilted ones; the detected ones are longer, thicker and moved along and across by the row's numbers.
MEASURED = f"""{TILT}, g AS (SELECT *, length + jit * 30 AS dlen, thickness + jit * 10 + 1 AS dthk, jit * 4 AS a0, line_no * 6 AS c0 FROM tw),
    o AS (SELECT *, greatest(0, least(length, a0 + dlen) - greatest(0, a0)) * greatest(0, least(thickness / 2, c0 + dthk / 2) - greatest(-thickness / 2, c0 - dthk / 2)) AS common FROM g),
    ms AS (SELECT plan_id, det_id, round(common / (length * thickness + dlen * dthk - common), 9) AS iou, thickness - least(dlen, dthk) AS dt, length - greatest(dlen, dthk) AS dl, CASE WHEN dlen < dthk THEN 0 ELSE 1 END AS straight, sqrt((length / 2 - a0 - dlen / 2) ** 2 + c0 ** 2) AS dc FROM o)"""
SCORE = "100 * (0.4e0 * iou + 0.2e0 * greatest(0, 1 - least(abs(dt), 50) / 50) + 0.2e0 * greatest(0, 1 - least(abs(dl), 250) / 250) + 0.1e0 * greatest(0, 1 - least(abs(dc), 75) / 75) + 0.1e0 * straight)"
WALL_SCORES = f"{MEASURED}, s AS (SELECT plan_id, det_id, iou, dt, dc, round({SCORE} + 1e-9, 6) AS score FROM ms), ws AS (SELECT plan_id, det_id, score, iou, dc, CASE WHEN iou < 0.3e0 AND abs(dt) > 80 THEN 'FAIL' WHEN score >= 75 AND iou >= 0.55e0 AND abs(dt) <= 60 THEN 'PASS' ELSE 'WARN' END AS status FROM s)"


def detected_walls(spark, sf):
    """Polygons of the tilted walls as a detector sees them."""
    w = tilted_walls(spark, sf)
    dlen, dthk, a0, c0 = F.col("length") + F.col("jit") * 30, F.col("thickness") + F.col("jit") * 10 + 1, F.col("jit") * 4, F.col("line_no") * 6
    at = lambda a, c: G.point(F.col("x1") + a * F.col("ux") - c * F.col("uy"), F.col("y1") + a * F.col("uy") + c * F.col("ux"))
    return w.select(*K, F.array(at(a0, c0 - dthk / 2), at(a0 + dlen, c0 - dthk / 2), at(a0 + dlen, c0 + dthk / 2), at(a0, c0 + dthk / 2)).alias("points"))


def wall_scores(spark, sf):
    """Weighted components of IoU, thickness, length, centroid and angle, and the verdict; identical rows count once."""
    return W.wall_scores(tilted_walls(spark, sf), detected_walls(spark, sf))


@query("d06_wall_scores", WALL_SCORES + f" SELECT plan_id, det_id, {s6('score')} AS score, status FROM ws")
def d06(spark, sf):
    return wall_scores(spark, sf).select(*K, r6(F.col("score")).alias("score"), "status")


@query("d07_report_summary", WALL_SCORES + f", a AS (SELECT plan_id, count(*) AS n, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned, avg(score) AS mean, min(score) AS least, max(score) AS most, 0.7e0 * avg(iou) + 0.3e0 * greatest(0, 1 - avg(dc) / 500) AS accuracy FROM ws GROUP BY plan_id), b AS (SELECT *, (passed + 0.5e0 * warned) / n AS completeness, least(1, 1 + 0.3e0 * passed / n) AS compliance FROM a) SELECT plan_id, n, passed, round(mean, 4) AS mean, least, most, {s6('CAST(passed AS DOUBLE) / n')} AS pass_rate, round(accuracy, 5) AS accuracy, {s6('completeness')} AS completeness, round(0.4e0 * accuracy + 0.3e0 * completeness + 0.3e0 * compliance, 5) AS overall FROM b")
def d07(spark, sf):
    r = Q.report_summary(wall_scores(spark, sf))
    return r.select("plan_id", "n", "passed", F.round("mean", 4).alias("mean"), "least", "most", r6(F.col("pass_rate")).alias("pass_rate"), F.round("accuracy", 5).alias("accuracy"), r6(F.col("completeness")).alias("completeness"), F.round("overall", 5).alias("overall"))


@query("d08_reconstruction_stats", f"{TILT}, a AS (SELECT t.plan_id, abs(degrees(atan2(t.uy, t.ux)) - CASE WHEN d.horizontal THEN 0 ELSE 90 END) AS off FROM tw t JOIN det d ON t.plan_id = d.plan_id AND t.det_id = d.det_id), b AS (SELECT plan_id, avg(CASE WHEN off <= 10 THEN 1e0 ELSE 0 END) AS par, count(*) FILTER (WHERE off > 30) AS turned FROM a GROUP BY plan_id), s AS (SELECT plan_id, avg(CASE WHEN thk >= 200 THEN 1e0 ELSE 0 END) AS closed FROM det WHERE kind = 'STAIR' GROUP BY plan_id) SELECT plan_id, {s6('par')} AS parallel_ratio, coalesce(turned, 0) AS turned, {s6('closed')} AS closed_ratio, coalesce(par < 0.7e0, false) OR coalesce(closed < 0.9e0, false) AS warned FROM b FULL JOIN s USING (plan_id)")
def d08(spark, sf):
    """Axes against their sources' directions, and closed spaces."""
    d = detections(spark, sf)
    w = tilted_walls(spark, sf).join(d.select(*K, "horizontal"), list(K))
    spaces = d.where("kind = 'STAIR'").withColumn("closed", F.col("thk") >= 200)
    r = Q.reconstruction_stats(w, F.when(F.col("horizontal"), 0.0).otherwise(90.0), spaces)
    return r.select("plan_id", r6(F.col("parallel_ratio")).alias("parallel_ratio"), "turned", r6(F.col("closed_ratio")).alias("closed_ratio"), "warned")


@query("d09_pre_export_checks", f"{OT}, th AS (SELECT *, CASE line_no WHEN 1 THEN thickness - 60 WHEN 2 THEN thickness * 5 ELSE thickness END AS t FROM tw), w AS (SELECT plan_id, count(*) AS n, count(*) AS axes, count(*) FILTER (WHERE t < 40 OR t > 1000) AS invalid, count(*) FILTER (WHERE t >= 40 AND t < 80) AS thin, count(*) FILTER (WHERE t > 1000) AS thick, count(*) FILTER (WHERE length < 100) AS short FROM th GROUP BY plan_id), o AS (SELECT plan_id, count(*) FILTER (WHERE wall_id IS NULL) AS unmatched, count(*) FILTER (WHERE wall_distance > 500) AS far FROM hit GROUP BY plan_id) SELECT w.*, coalesce(unmatched, 0) AS unmatched, coalesce(far, 0) AS far, CASE WHEN invalid + thin + short + coalesce(unmatched, 0) + coalesce(far, 0) > 0 THEN 'attention' ELSE 'ok' END AS severity FROM w LEFT JOIN o USING (plan_id)".replace("w.thickness, w.length", "w.t AS thickness, w.length").replace("JOIN tw w ON", "JOIN (SELECT *, CASE line_no WHEN 1 THEN thickness - 60 WHEN 2 THEN thickness * 5 ELSE thickness END AS t FROM tw) w ON"))
def d09(spark, sf):
    """Walls of line 1 are made thinner and those of line 2 thicker, so that every band occurs."""
    t = F.when(F.col("line_no") == 1, F.col("thickness") - 60).when(F.col("line_no") == 2, F.col("thickness") * 5).otherwise(F.col("thickness"))
    return Q.pre_export_checks(tilted_walls(spark, sf).withColumn("thickness", t), rect_openings(spark, sf))


#: SQL: footprints by their sides, contacts (C21), boundaries (C22) and walls with a known structure, counted by plan.
SIDES = [(f"(x{i % 4 + 1} - x{i})", f"(y{i % 4 + 1} - y{i})") for i in range(1, 5)]
SQUARE = " AND ".join(f"abs({a} * {c} + {b} * {d}) <= 1" for (a, b), (c, d) in zip(SIDES, SIDES[1:] + SIDES[:1], strict=True))
EVEN = " AND ".join(f"abs(sqrt({SIDES[i][0]} ** 2 + {SIDES[i][1]} ** 2) - sqrt({SIDES[i + 2][0]} ** 2 + {SIDES[i + 2][1]} ** 2)) <= 1" for i in (0, 1))
METRICS = f"SELECT m.*, coalesce(connections, 0) AS connections, coalesce(boundaries, 0) AS boundaries, coalesce(layers, 0) AS layers FROM ({CTE} SELECT plan_id, count(*) AS n_walls, count(*) FILTER (WHERE {SQUARE}) AS rectangular, count(*) FILTER (WHERE {EVEN}) AS constant FROM wall GROUP BY plan_id) m LEFT JOIN (SELECT plan_id, count(*) AS connections FROM ({SQL['c21_contact_proposals']}) GROUP BY plan_id) c ON m.plan_id = c.plan_id LEFT JOIN (SELECT plan_id, count(*) AS boundaries FROM ({SQL['c22_space_boundaries']}) GROUP BY plan_id) b ON m.plan_id = b.plan_id LEFT JOIN ({CTE} SELECT plan_id, count(*) AS layers FROM wall WHERE label LIKE 'external%' GROUP BY plan_id) l ON m.plan_id = l.plan_id"


def metrics(spark, sf):
    layers = walls(spark, sf).where(L.is_external(F.col("label")))
    return Q.model_metrics(walls(spark, sf), contacts(spark, sf), boundaries(spark, sf), layers)


@query("d10_model_metrics", METRICS)
def d10m(spark, sf):
    """Footprints measured, with the contacts and boundaries of each plan counted."""
    return metrics(spark, sf)


@query("d10_readiness", f"SELECT plan_id, greatest(0, least(100, 100 - CASE WHEN n_walls = 0 OR rectangular = 0 THEN 30 ELSE floor((1 - CAST(rectangular AS DOUBLE) / greatest(n_walls, 1)) * 20) + floor((1 - CAST(constant AS DOUBLE) / greatest(n_walls, 1)) * 10) END - CASE WHEN connections > 0 THEN 0 ELSE 15 END - CASE WHEN boundaries > 0 THEN 0 ELSE 10 END - CASE WHEN layers > 0 THEN 0 ELSE 5 END - CASE WHEN plan_id % 3 = 0 THEN 10 ELSE 0 END))::BIGINT AS readiness FROM ({METRICS})")
def d10(spark, sf):
    """100 minus whole-number deductions by the metrics; every third plan's file is of a wrong format."""
    m = metrics(spark, sf)
    return m.select("plan_id", Q.readiness(*[F.col(c) for c in ("n_walls", "rectangular", "constant", "connections", "boundaries", "layers")], F.pmod("plan_id", F.lit(3)) != 0).alias("readiness"))


@query("d11_worst_status", WALL_SCORES + " SELECT plan_id, CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS status FROM ws GROUP BY plan_id")
def d11(spark, sf):
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    return wall_scores(spark, sf).groupBy("plan_id").agg(F.element_at(F.array(*map(F.lit, ("ok", "warn", "fail"))), F.max(rank) + 1).alias("status"))


@query("d12_highlights", WALL_SCORES + " SELECT plan_id, count(DISTINCT det_id) AS n, string_agg(DISTINCT det_id, ',' ORDER BY det_id) AS ids FROM ws WHERE status = 'WARN' GROUP BY plan_id")
def d12(spark, sf):
    ids = F.array_sort(F.collect_set("det_id"))
    return wall_scores(spark, sf).where("status = 'WARN'").groupBy("plan_id").agg(F.size(ids).cast("long").alias("n"), F.array_join(ids, ",").alias("ids"))


@query("d13_element_counts", agg(", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k.lower()}" for k in ("WALL", "DOOR", "WINDOW", "STAIR"))))
def d13(spark, sf):
    kinds = ["WALL", "DOOR", "WINDOW", "STAIR"]
    p = detections(spark, sf).groupBy("plan_id").pivot("kind", kinds).count().na.fill(0)
    return p.select("plan_id", *[F.col(k).alias(k.lower()) for k in kinds])


@query("d14_wall_thickness", f"{CTE}, m AS (SELECT plan_id, label, list_sort(list(thk))[count(*) // 2 + 1] AS thk FROM wall GROUP BY plan_id, label) SELECT plan_id, label, {near_sql('thk')} AS thickness FROM m")
def d14(spark, sf):
    """The upper median of each group, snapped to the standards."""
    m = F.element_at(F.array_sort(F.collect_list("thk")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return walls(spark, sf).groupBy("plan_id", "label").agg(m.alias("thk")).select("plan_id", "label", G.snap_thickness(F.col("thk"), L.is_external(F.col("label"))).alias("thickness"))


@query("d15_robust_width", f"{CTE}, p AS (SELECT plan_id, count(*) AS n, quantile_cont(thk, 0.15) AS lo, quantile_cont(thk, 0.85) AS hi FROM wall GROUP BY plan_id) SELECT plan_id, {s6('greatest(40, 2 * median(thk))')} AS width, {s6('stddev_pop(thk)')} AS spread FROM wall JOIN p USING (plan_id) WHERE n < 5 OR thk BETWEEN lo AND hi GROUP BY plan_id")
def d15(spark, sf):
    """Middle 70 per cent where there are five or more; median doubled, at least 40."""
    w = walls(spark, sf)
    p = w.groupBy("plan_id").agg(F.count("*").alias("n"), F.percentile("thk", F.lit(0.15)).alias("lo"), F.percentile("thk", F.lit(0.85)).alias("hi"))
    t = w.join(p, "plan_id").where((F.col("n") < 5) | F.col("thk").between(F.col("lo"), F.col("hi")))
    return t.groupBy("plan_id").agg(r6(F.greatest(F.lit(40.0), 2 * F.median("thk"))).alias("width"), r6(F.stddev_pop("thk")).alias("spread"))


@query("d16_opening_bias", SQL["c30_fit_opening"].split(" SELECT plan_id, det_id, CASE WHEN iou")[0] + f""", bf AS (SELECT *, CASE WHEN iou < 0.05e0 THEN x1 + s * (x2 - x1) WHEN upright THEN x1 ELSE cx + step END AS fx, CASE WHEN iou < 0.05e0 THEN y1 + s * (y2 - y1) WHEN upright THEN cy + step ELSE y1 END AS fy FROM b WHERE k = 1), bo AS (SELECT *, (fx - cx) * ux + (fy - cy) * uy AS shift, CASE WHEN abs(ux) < 1e-6 THEN 'V' ELSE 'H' END AS orientation FROM bf), bm AS (SELECT plan_id, orientation, median(shift) AS bias FROM bo GROUP BY plan_id, orientation) SELECT plan_id, det_id, orientation, {s6('bias')} AS bias, {s6('fx - ux * bias')} AS cx, {s6('fy - uy * bias')} AS cy FROM bo JOIN bm USING (plan_id, orientation)""")
def d16(spark, sf):
    """Fitted openings moved back by the median offset of their plan and orientation."""
    a, o, w = assigned(spark, sf), rect_openings(spark, sf), tilted_walls(spark, sf)
    b = O.opening_bias(O.fit_opening(a, o, w), a, o, w)
    return b.select(*K, "orientation", *[r6(F.col(c)).alias(c) for c in ("bias", "cx", "cy")])


@query("d17_median_iou", WALL_SCORES + f" SELECT plan_id, {s6('median(iou)')} AS median_iou, median(iou) >= 0.9e0 AS accepted FROM ws GROUP BY plan_id")
def d17(spark, sf):
    return wall_scores(spark, sf).groupBy("plan_id").agg(r6(F.median("iou")).alias("median_iou"), (F.median("iou") >= 0.9).alias("accepted"))


FOLDED = "least({a}, 180 - {a}) AS flat, abs({a} - 90) AS up, least(abs({a} - 45), abs({a} - 135)) AS slanted".format(a="degrees(atan2(uy, ux))")


@query("d18_orientation_bases", f"{TILT}, fo AS (SELECT plan_id, {FOLDED} FROM tw), fb AS (SELECT plan_id, CASE WHEN flat <= up AND flat <= slanted THEN 0 WHEN up <= slanted THEN 90 ELSE 45 END AS base FROM fo) SELECT plan_id, count(*) FILTER (WHERE base = 0) AS zero, count(*) FILTER (WHERE base = 90) AS ninety, count(*) FILTER (WHERE base = 45) AS forty_five, count(*) FILTER (WHERE base = 45) > count(*) // 6 AS use_45 FROM fb GROUP BY plan_id")
def d18(spark, sf):
    """Axes by the nearest base of their angle."""
    return W.orientation_bases(tilted_walls(spark, sf))


@query("d19_weighted_width", agg(f"{s6('coalesce(sum(thk * len) / nullif(sum(len), 0), avg(thk), 40)')} AS width", src="wall"))
def d19(spark, sf):
    return walls(spark, sf).groupBy("plan_id").agg(r6(F.coalesce(F.try_divide(F.sum(F.col("thk") * F.col("len")), F.sum("len")), F.avg("thk"), F.lit(40.0))).alias("width"))


@query("d20_line_fit", f"{CTE}, m AS (SELECT plan_id, count(*) AS n, avg(x0) AS cx, avg(y0) AS cy, covar_pop(x0, y0) AS cxy, var_pop(x0) AS cxx, var_pop(y0) AS cyy FROM wall GROUP BY plan_id), a AS (SELECT *, CASE WHEN abs(cxy) < 1e-6 THEN CASE WHEN cxx > cyy THEN 0e0 ELSE pi() / 2 END ELSE 0.5e0 * atan2(2 * cxy, cxx - cyy) END AS angle FROM m WHERE n > 2), p AS (SELECT a.*, cos(angle) * (x0 - cx) + sin(angle) * (y0 - cy) AS s FROM wall JOIN a USING (plan_id)) SELECT plan_id, count(*) AS n, {s6('max(angle)')} AS angle, {s6('(max(cx) + max(cos(angle)) * min(s)) / 1e3')} AS x1, {s6('(max(cy) + max(sin(angle)) * min(s)) / 1e3')} AS y1, {s6('(max(cx) + max(cos(angle)) * max(s)) / 1e3')} AS x2, {s6('(max(cy) + max(sin(angle)) * max(s)) / 1e3')} AS y2 FROM p GROUP BY plan_id")
def d20(spark, sf):
    """The line along the principal direction of each plan's wall corners, over their extent, in metres."""
    d = line_fit(walls(spark, sf), "x0", "y0").where("n > 2")
    return d.select("plan_id", "n", r6(F.col("angle")).alias("angle"), *[r6(F.col(c) / 1e3).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("d21_fit_similarity", f"{CTE}, m AS (SELECT plan_id, avg(x0) AS ax, avg(y0) AS ay, avg(bx) AS cx, avg(by_) AS cy, covar_pop(x0, bx) + covar_pop(y0, by_) AS d, covar_pop(x0, by_) - covar_pop(y0, bx) AS c FROM wall GROUP BY plan_id HAVING count(*) >= 3), s AS (SELECT w.plan_id, avg(sqrt((bx - cx) ** 2 + (by_ - cy) ** 2)) / avg(sqrt((x0 - ax) ** 2 + (y0 - ay) ** 2)) AS scale, max(d / sqrt(d * d + c * c)) AS co, max(c / sqrt(d * d + c * c)) AS si, max(ax) AS ax, max(ay) AS ay, max(cx) AS cx, max(cy) AS cy FROM wall w JOIN m USING (plan_id) GROUP BY w.plan_id) SELECT plan_id, {s6('scale')} AS scale, {s6('atan2(si, co)')} AS rotation, {s6('(cx - scale * (co * ax - si * ay)) / 1e3')} AS tx, {s6('(cy - scale * (si * ax + co * ay)) / 1e3')} AS ty FROM s")
def d21(spark, sf):
    """The similarity between the walls' near and far corners, shifts in metres."""
    d = fit_similarity(walls(spark, sf), "plan_id", "x0", "y0", "bx", "by_")
    return d.select("plan_id", r6(F.col("scale")).alias("scale"), r6(F.col("rotation")).alias("rotation"), *[r6(F.col(c) / 1e3).alias(c) for c in ("tx", "ty")])


@query("d22_takeoff", f"{CTE} SELECT plan_id, coalesce(kind, 'all') AS element, count(*) AS n, {s6('sum(len) / 1000')} AS length_m, {s6('sum(len * thk) / 1e6')} AS area_m2, {s6('sum(len * thk) / 1e6 * 2.5e0')} AS volume_m3 FROM det GROUP BY plan_id, ROLLUP (kind)")
def d22(spark, sf):
    """Quantities by plan and element, with the plan's total."""
    area = F.sum(F.col("len") * F.col("thk")) / 1e6
    d = detections(spark, sf).groupingSets([["plan_id", "kind"], ["plan_id"]], "plan_id", "kind").agg(F.count("*").alias("n"), r6(F.sum("len") / 1000).alias("length_m"), r6(area).alias("area_m2"), r6(area * 2.5).alias("volume_m3"))
    return d.select("plan_id", F.coalesce("kind", F.lit("all")).alias("element"), "n", "length_m", "area_m2", "volume_m3")


@query("d23_thermal_gaps", "WITH has AS (SELECT l_orderkey AS k, bool_or(l_linenumber = 2 AND l_discount > 0.05) AS u FROM lineitem GROUP BY l_orderkey) SELECT o_orderpriority AS type, count(*) AS n FROM orders LEFT JOIN has ON o_orderkey = k WHERE NOT coalesce(u, false) GROUP BY 1")
def d23(spark, sf):
    """Elements without any numeric value of the wanted property, by type."""
    has = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or((F.col("l_linenumber") == 2) & (F.col("l_discount") > 0.05)).alias("u"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority").join(has, "o_orderkey", "left").where(~F.coalesce("u", F.lit(False)))
    return o.groupBy(F.col("o_orderpriority").alias("type")).agg(F.count("*").alias("n"))


# Element, external, U-value in W/(m2 K), fire rating, acoustic rating. A wall is external only where that is known.
THERMAL = (
    ("WALL", True, 0.28, "REI90", "Rw 52 dB"),
    ("WALL", False, None, "REI60", "Rw 45 dB"),
    ("WINDOW", False, 1.3, "E30", None),
    ("DOOR", False, 2.0, "E30", "Rw 30 dB"),
)


@query("d24_thermal_defaults", f"{CTE} SELECT plan_id, det_id, CASE WHEN kind = 'WALL' THEN CASE WHEN {EXT} THEN 0.28e0 END WHEN kind = 'DOOR' THEN 2.0e0 ELSE 1.3e0 END AS u_value, CASE WHEN kind <> 'WALL' THEN 'E30' WHEN coalesce({EXT}, false) THEN 'REI90' ELSE 'REI60' END AS fire, CASE WHEN kind = 'WALL' THEN CASE WHEN coalesce({EXT}, false) THEN 'Rw 52 dB' ELSE 'Rw 45 dB' END WHEN kind = 'DOOR' THEN 'Rw 30 dB' END AS acoustic FROM det WHERE kind IN ('WALL', 'DOOR', 'WINDOW')")
def d24(spark, sf):
    rules = spark.createDataFrame(list(THERMAL), "kind string, external boolean, u_value double, fire string, acoustic string")
    d = detections(spark, sf).withColumn("external", F.coalesce(L.is_external(F.col("label")), F.lit(False)))
    return d.join(F.broadcast(rules), ["kind", "external"]).select(*K, "u_value", "fire", "acoustic")


@query("d25_duplicate_guids", "SELECT l_orderkey AS guid, l_linenumber AS part, count(*) AS n, string_agg(l_partkey, ',' ORDER BY l_partkey) AS members FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def d25(spark, sf):
    d = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("guid"), F.col("l_linenumber").alias("part"))
    return d.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("members")).where("n > 1")


@query("d26_material_coverage", REL_SQL + f" SELECT type, {s6('100.0 * avg(CASE WHEN r.guid IS NOT NULL THEN 1e0 ELSE 0 END)')} AS coverage, 100.0 * avg(CASE WHEN r.guid IS NOT NULL THEN 1e0 ELSE 0 END) < 80 AS warned FROM element e LEFT JOIN (SELECT DISTINCT guid FROM rel WHERE rel = 'material') r ON e.guid = r.guid GROUP BY type")
def d26(spark, sf):
    m = relations(spark, sf).where("rel = 'material'").select("guid", F.lit(1.0).alias("has")).distinct()
    share = 100 * F.avg(F.coalesce("has", F.lit(0.0)))
    return elements(spark, sf).join(m, "guid", "left").groupBy("type").agg(r6(share).alias("coverage"), (share < 80).alias("warned"))


@query("d27_classification_stats", agg(f"count(*) FILTER (WHERE {EXT}) AS external, count(*) FILTER (WHERE NOT {EXT}) AS internal, count(*) FILTER (WHERE {EXT} IS NULL) AS unclassified"))
def d27(spark, sf):
    d = detections(spark, sf).withColumn("e", L.is_external(F.col("label")))
    return d.groupBy("plan_id").agg(F.count_if("e").alias("external"), F.count_if(~F.col("e")).alias("internal"), F.count_if(F.col("e").isNull()).alias("unclassified"))


@query("d28_envelope_slab", f"{CTE} SELECT plan_id, {s6('min(x0) - avg(thk) / 2')} AS x0, {s6('min(y0) - avg(thk) / 2')} AS y0, {s6('max(bx) + avg(thk) / 2')} AS x1, {s6('max(by_) + avg(thk) / 2')} AS y1 FROM wall WHERE {EXT} GROUP BY plan_id")
def d28(spark, sf):
    grow = F.avg("thk") / 2
    return walls(spark, sf).where(L.is_external(F.col("label"))).groupBy("plan_id").agg(r6(F.min("x0") - grow).alias("x0"), r6(F.min("y0") - grow).alias("y0"), r6(F.max("bx") + grow).alias("x1"), r6(F.max("by_") + grow).alias("y1"))


@query("d29_timeline", f"SELECT user_id AS job_id, event_type AS step, {s6('sum(value)')} AS total_ms, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1, 2")
def d29(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.groupBy(F.col("user_id").alias("job_id"), F.col("event_type").alias("step")).agg(r6(F.sum("value")).alias("total_ms"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@query("d30_tool_stats", f"SELECT event_type AS tool, count(*) AS files, {s6('sum(value)')} AS bytes_in, {s6('max(value)')} AS largest FROM events GROUP BY 1")
def d30(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("files"), r6(F.sum("value")).alias("bytes_in"), r6(F.max("value")).alias("largest"))


@query("d31_warnings_by_category", WALL_SCORES + ", c AS (SELECT plan_id, status, count(*) AS n FROM ws GROUP BY plan_id, status) SELECT plan_id, string_agg(status || '=' || n, ';' ORDER BY status) AS warnings FROM c GROUP BY plan_id")
def d31(spark, sf):
    c = wall_scores(spark, sf).groupBy("plan_id", "status").agg(F.count("*").alias("n")).groupBy("plan_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("m"))
    return c.select("plan_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("warnings"))


@query("d32_quantity_consistency", f"SELECT w.plan_id, w.det_id, {s6('w.stored')} AS stored, {s6('m.length')} AS length FROM ({CTE} SELECT plan_id, det_id, len AS stored FROM wall) w JOIN (SELECT plan_id, det_id, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS length FROM ({SQL['c14_close_gaps']})) m ON w.plan_id = m.plan_id AND w.det_id = m.det_id WHERE abs(w.stored - m.length) > 0.05e0 * m.length")
def d32(spark, sf):
    """Lengths stored before gaps were closed (C14) against those of the axes after it, five per cent."""
    q = walls(spark, sf).select(*K, F.lit("Length").alias("name"), F.col("len").alias("value"))
    r = Q.quantity_consistency(c14(spark, sf), q)
    return r.select(*K, *[r6(F.col(c)).alias(c) for c in ("stored", "length")])


@query("d33_pset_completeness", REL_SQL + ", need AS (SELECT guid, unnest(['material', 'storey', 'voids']) AS rel FROM element WHERE type = 'IfcWall') SELECT n.guid, count(*) AS missing, string_agg(n.rel, ',' ORDER BY n.rel) AS sets FROM need n WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.guid = n.guid AND r.rel = n.rel) GROUP BY n.guid")
def d33(spark, sf):
    need = elements(spark, sf).where("type = 'IfcWall'").select("guid", F.explode(F.array(*map(F.lit, ("material", "storey", "voids")))).alias("rel"))
    return need.join(relations(spark, sf).distinct(), ["guid", "rel"], "left_anti").groupBy("guid").agg(F.count("*").alias("missing"), F.array_join(F.array_sort(F.collect_list("rel")), ",").alias("sets"))


@query("d34_element_completeness", agg("CASE WHEN count(*) FILTER (WHERE kind = 'WALL') = 0 OR count(*) FILTER (WHERE kind = 'STAIR') = 0 THEN 'FAILED' ELSE 'PASSED' END AS final, CASE WHEN count(*) FILTER (WHERE kind = 'DOOR') = 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE kind = 'WINDOW') = 0 THEN 1 ELSE 0 END AS warnings"))
def d34(spark, sf):
    """Missing required types are errors, missing optional ones warnings."""
    spark_types = spark.createDataFrame([("WALL", True), ("STAIR", True), ("DOOR", False), ("WINDOW", False)], "kind string, required boolean")
    d = detections(spark, sf).select("plan_id", "kind").distinct()
    expected = d.select("plan_id").distinct().join(F.broadcast(spark_types), F.lit(True))
    m = expected.join(d.withColumn("has", F.lit(True)), ["plan_id", "kind"], "left")
    lacks = F.col("has").isNull()
    return m.groupBy("plan_id").agg(F.when(F.count_if(lacks & F.col("required")) > 0, "FAILED").otherwise("PASSED").alias("final"), F.count_if(lacks & ~F.col("required")).alias("warnings"))


@query("d35_geometry_choice", MEASURED + " SELECT plan_id, det_id, CASE WHEN iou < 0.75e0 THEN 'polygon' ELSE 'rectangle' END AS choice FROM ms")
def d35(spark, sf):
    """Detected polygon where the axis rectangle differs; the demo's detections are rectangles, so the rest take the rectangle."""
    w = tilted_walls(spark, sf).join(detected_walls(spark, sf), list(K))
    return W.geometry_choice(w).select(*K, "choice")


@query("d36_boundary_completeness", REL_SQL + " SELECT e.guid, coalesce(bool_or(rel = 'voids'), false) AS floor, coalesce(bool_or(rel = 'fills'), false) AS ceiling, coalesce(bool_or(rel = 'boundary'), false) AS wall FROM element e LEFT JOIN rel r ON e.guid = r.guid WHERE type = 'IfcSpace' GROUP BY e.guid")
def d36(spark, sf):
    r = relations(spark, sf).groupBy("guid").agg(*[F.bool_or(F.col("rel") == v).alias(n) for v, n in (("voids", "floor"), ("fills", "ceiling"), ("boundary", "wall"))])
    return elements(spark, sf).where("type = 'IfcSpace'").select("guid").distinct().join(r, "guid", "left").na.fill(False)


@query("e01_best_match", f"{CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, kind ORDER BY confidence DESC, det_id) AS k FROM det) SELECT plan_id, kind, det_id, confidence FROM r WHERE k = 1")
def e01(spark, sf):
    return best_match(detections(spark, sf), ["plan_id", "kind"], [F.desc("confidence"), F.col("det_id")]).select("plan_id", "kind", "det_id", "confidence")


@query("e02_split_levels", "WITH s AS (SELECT p_brand, p_partkey, p_size * 150 AS z, lag(p_size * 150) OVER w AS before, lead(p_size * 150) OVER w AS after FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)) SELECT p_brand, p_partkey, coalesce(z - before < 200, false) OR coalesce(after - z < 200, false) AS split FROM s")
def e02(spark, sf):
    """Storeys closer than 200 to a neighbour in height."""
    w = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    z = F.col("p_size") * 150
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("b", F.lag(z).over(w)).withColumn("a", F.lead(z).over(w))
    return p.select("p_brand", "p_partkey", (F.coalesce(z - F.col("b") < 200, F.lit(False)) | F.coalesce(F.col("a") - z < 200, F.lit(False))).alias("split"))


@query("e03_source_index", f"{CTE} SELECT plan_id, det_id, row_number() OVER (PARTITION BY plan_id ORDER BY det_id, x0, y0) - 1 AS source_index FROM wall")
def e03(spark, sf):
    return walls(spark, sf).select(*K, (F.row_number().over(Window.partitionBy("plan_id").orderBy("det_id", "x0", "y0")) - 1).cast("long").alias("source_index"))


@query("e04_axis_local_index", f"{CTE} SELECT plan_id, label, det_id, row_number() OVER (PARTITION BY plan_id, label ORDER BY len DESC, det_id, x0, y0) - 1 AS local_index FROM wall")
def e04(spark, sf):
    w = Window.partitionBy("plan_id", "label").orderBy(F.desc("len"), "det_id", "x0", "y0")
    return walls(spark, sf).select("plan_id", "label", "det_id", (F.row_number().over(w) - 1).cast("long").alias("local_index"))


@query("e05_ring_edges", f"{CTE} SELECT plan_id, det_id, 1 AS i, x2 - x1 AS dx, y2 - y1 AS dy FROM det UNION ALL SELECT plan_id, det_id, 2, x3 - x2, y3 - y2 FROM det UNION ALL SELECT plan_id, det_id, 3, x4 - x3, y4 - y3 FROM det UNION ALL SELECT plan_id, det_id, 4, x1 - x4, y1 - y4 FROM det")
def e05(spark, sf):
    d = detections(spark, sf).select(*K, F.posexplode(G.edges(F.col("points"))).alias("i", "e"))
    return d.select(*K, (F.col("i") + 1).alias("i"), (F.col("e.b.x") - F.col("e.a.x")).alias("dx"), (F.col("e.b.y") - F.col("e.a.y")).alias("dy"))


@query("e06_latest_job_state", "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(event_id) FILTER (WHERE true) >= 0 AS seen FROM events GROUP BY user_id")
def e06(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), (F.max("event_id") >= 0).alias("seen"))


@query("e08_drop_short_links", f"{LABELS}, tied AS (SELECT plan_id, split_part(id, '#', 1) AS det_id, count(DISTINCT id) AS n FROM lab GROUP BY 1, 2) SELECT w.plan_id, w.det_id FROM wall w LEFT JOIN tied t ON w.plan_id = t.plan_id AND w.det_id = t.det_id WHERE NOT (len < 1500 AND coalesce(t.n, 0) >= 2)")
def e08(spark, sf):
    """Axes below 1500 whose ends both lie within 100 of other ends go."""
    return R.drop_short_links(axis_walls(spark, sf).select(*K, *W.AXIS, "thickness"), 1500.0).select(*K)


@query("f01_gaps_ascending", f"SELECT plan_id, a_det_id, b_det_id, gap FROM ({SQL['c12_gap_proposals']}) WHERE gap <= 100 ORDER BY gap, plan_id, a_det_id, b_det_id")
def f01(spark, sf):
    """Gaps between ends up to 100, smallest first."""
    return c12(spark, sf).where("gap <= 100").select("plan_id", "a_det_id", "b_det_id", "gap").orderBy("gap", "plan_id", "a_det_id", "b_det_id")


@query("f02_first_issues", f"{CTE}, r AS (SELECT plan_id, det_id, row_number() OVER (PARTITION BY plan_id ORDER BY det_id, x0, y0) AS k FROM det WHERE {REASON} IS NOT NULL) SELECT plan_id, det_id, k FROM r WHERE k <= 5")
def f02(spark, sf):
    """The first five issues of each plan: a report's feature, not a cap on the work."""
    d = detections(spark, sf).where(Q.validation_reason().isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("plan_id").orderBy("det_id", "x0", "y0")).cast("long"))
    return d.where("k <= 5").select(*K, "k")


@query("f03_sorted_names", f"{CTE} SELECT plan_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM det GROUP BY plan_id")
def f03(spark, sf):
    return detections(spark, sf).groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


@query("f04_largest_per_group", f"{CTE} SELECT plan_id, kind, arg_max(det_id, (len * thk, det_id)) AS det_id FROM det GROUP BY plan_id, kind")
def f04(spark, sf):
    return detections(spark, sf).groupBy("plan_id", "kind").agg(F.max_by("det_id", F.struct(F.col("len") * F.col("thk"), F.col("det_id"))).alias("det_id"))


@query("f05_counts_descending", f"{CTE} SELECT label, count(*) AS n FROM det GROUP BY label ORDER BY n DESC, label")
def f05(spark, sf):
    return detections(spark, sf).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


PSET = "WITH t AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size % 2 = 0), c AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size % 3 = 0)"


def psets(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    one = lambda m: p.where(F.col("p_size") % m == 0).select("p_brand", "p_type").distinct()
    return one(2), one(3)


@query("g01_property_diff", PSET + " SELECT 'missing' AS side, p_brand, p_type FROM (SELECT * FROM t EXCEPT SELECT * FROM c) UNION ALL SELECT 'extra', p_brand, p_type FROM (SELECT * FROM c EXCEPT SELECT * FROM t)")
def g01(spark, sf):
    t, c = psets(spark, sf)
    return t.subtract(c).select(F.lit("missing").alias("side"), "*").unionByName(c.subtract(t).select(F.lit("extra").alias("side"), "*"))


@query("g01b_count_diff", "WITH t AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1), c AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY 1) SELECT coalesce(t.p_brand, c.p_brand) AS p_brand, coalesce(t.n, 0) - coalesce(c.n, 0) AS diff FROM t FULL JOIN c ON t.p_brand = c.p_brand")
def g01b(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    one = lambda m, n: p.where(F.col("p_size") % m == 0).groupBy("p_brand").agg(F.count("*").alias(n))
    return one(2, "t").join(one(3, "c"), "p_brand", "full").select("p_brand", (F.coalesce("t", F.lit(0)) - F.coalesce("c", F.lit(0))).alias("diff"))


@query("g02_conformance", PSET + " SELECT 'match' AS side, p_brand, p_type FROM (SELECT * FROM t INTERSECT SELECT * FROM c) UNION ALL SELECT 'missing', p_brand, p_type FROM (SELECT * FROM t EXCEPT SELECT * FROM c)")
def g02(spark, sf):
    t, c = psets(spark, sf)
    return t.intersect(c).select(F.lit("match").alias("side"), "*").unionByName(t.subtract(c).select(F.lit("missing").alias("side"), "*"))


@query("g04_layer_union", f"{CTE} SELECT plan_id, det_id, 'wall' AS layer, thk, NULL::DOUBLE AS length FROM wall UNION ALL SELECT plan_id, det_id, 'axis', NULL, len FROM wall")
def g04(spark, sf):
    w = walls(spark, sf)
    return w.select(*K, F.lit("wall").alias("layer"), "thk").unionByName(w.select(*K, F.lit("axis").alias("layer"), F.col("len").alias("length")), allowMissingColumns=True)


@query("g05_split_layers", f"{CTE} SELECT plan_id, det_id, lower(kind) AS layer FROM det WHERE kind IN ('WALL', 'DOOR', 'WINDOW')")
def g05(spark, sf):
    return detections(spark, sf).where(F.col("kind").isin("WALL", "DOOR", "WINDOW")).select(*K, F.lower("kind").alias("layer"))

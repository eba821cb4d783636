"""Quality of plans and reports (D4, D5, D7-D10): expressions over counters, and checks over wall and opening tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.operators.openings import assign_openings, on_wall
from planlake.operators.spatial import computed
from planlake.operators.walls import cols, length, parallel_overlaps


def validation_reason(least_confidence: float = 0.5, least_area: float = 30000.0, wall_length: tuple[float, float] = (500.0, 3000.0), confidence: str = "confidence", points: str = "points", kind: str = "kind") -> Column:
    """Why a detection is rejected, by the first rule that it fails, or null: confidence, points (four for walls, three else),
    geometry (area), wall too short, wall too long (the longer side of its box)."""
    wall, p = F.col(kind) == "WALL", F.col(points)
    b = G.bounds(p)
    size = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"])
    few = F.size(p) < F.when(wall, 4).otherwise(3)
    rules = F.when(F.col(confidence) < least_confidence, "confidence").when(few, "points").when(G.polygon_area(p) < least_area, "geometry")
    return rules.when(wall & (size < wall_length[0]), "wall too short").when(wall & (size > wall_length[1]), "wall too long")


def reject_bucket(reason: Column) -> Column:
    """The kind of rule behind a reason: confidence, points, geometry, dimensions."""
    return F.when(reason.startswith("wall"), "dimensions").otherwise(reason)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 1 where there is nothing to judge."""
    return F.when(whole > 0, part / whole).otherwise(1.0)


def quality_score(total: Column, valid: Column, spaces: Column, closed: Column, axes: Column, parallel: Column, mean_quality: Column, errors: Column) -> Column:
    """Product of the valid, closed and parallel rates and the mean quality, lowered by a tenth per error (half at most), held in 0..1."""
    score = rate(valid, total) * rate(closed, spaces) * rate(parallel, axes) * F.coalesce(mean_quality, F.lit(1.0)) * (1 - F.least(0.1 * errors, F.lit(0.5)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def report_summary(scores: DataFrame, critical: DataFrame | None = None, key: str = "plan_id") -> DataFrame:
    """Per plan counts, mean, least and greatest score, pass rate, geometric accuracy, completeness, compliance and overall (.4/.3/.3).

    ``scores`` is what ``walls.wall_scores`` gives; ``critical`` has (key, n_critical), none where it lacks a plan.
    """
    n = F.count(F.lit(1))
    passed, warned = F.count_if(F.col("status") == "PASS"), F.count_if(F.col("status") == "WARN")
    s = scores.groupBy(key).agg(n.alias("n"), passed.alias("passed"), warned.alias("warned"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.avg("iou").alias("iou"), F.avg(F.abs("centroid_delta")).alias("off"))
    if critical is not None:
        s = s.join(critical.select(key, "n_critical"), key, "left")
    worst = F.coalesce("n_critical", F.lit(0)) if critical is not None else F.lit(0)
    accuracy = 0.7 * F.col("iou") + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("off") / 500)
    completeness = (F.col("passed") + 0.5 * F.col("warned")) / F.col("n")
    # Critical issues count twice; walls that pass make up for some of them.
    compliance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - 2 * worst / F.col("n")) + 0.3 * F.col("passed") / F.col("n"))
    s = s.withColumns({"accuracy": accuracy, "completeness": completeness, "compliance": compliance, "pass_rate": F.col("passed") / F.col("n")})
    overall = 0.4 * F.col("accuracy") + 0.3 * F.col("completeness") + 0.3 * F.col("compliance")
    return s.withColumn("overall", overall).drop("off")


def reconstruction_stats(axes: DataFrame, source_angle: Column, spaces: DataFrame, key: str = "plan_id") -> DataFrame:
    """Per plan the share of axes within 10 degrees of their source's direction, how many differ by more than 30, the share of
    closed spaces, and whether any falls below its limit (0.7, and 0.9 for spaces). ``spaces`` has a boolean ``closed``."""
    off = G.angle_delta(G.line_angle(*cols("")), source_angle)
    a = axes.where(length() > 0).withColumn("off", off).groupBy(key).agg(F.avg(F.when(F.col("off") <= 10, 1.0).otherwise(0.0)).alias("parallel_ratio"), F.count_if(F.col("off") > 30).alias("turned"))
    s = spaces.groupBy(key).agg(F.avg(F.col("closed").cast("double")).alias("closed_ratio"))
    j = a.join(s, key, "full")
    warned = F.coalesce(F.col("parallel_ratio") < 0.7, F.lit(False)) | F.coalesce(F.col("closed_ratio") < 0.9, F.lit(False))
    return j.withColumns({"turned": F.coalesce("turned", F.lit(0)), "warned": warned})


def pre_export_checks(walls: DataFrame, openings: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Per plan with walls: counts of walls, axes, thickness bands, short axes, unmatched and far openings, and the severity.

    A wall's axis counts from 0.001 mm; thickness is invalid below 40 or above 1000 mm, thin below 80; an axis is short
    below 100 mm; an opening is far beyond 500 mm. Severity: critical without an axis, else attention if anything is counted or
    fewer than half of the walls have an axis, else ok.
    """
    t, has = F.col("thickness"), F.coalesce(length() >= 0.001, F.lit(False))
    invalid = t.isNull() | (t < 40) | (t > 1000)
    w = walls.groupBy(key).agg(F.count("*").alias("n"), F.count_if(has).alias("axes"), F.count_if(has & invalid).alias("invalid"), F.count_if(has & (t >= 40) & (t < 80)).alias("thin"), F.count_if(has & (t > 1000)).alias("thick"), F.count_if(has & (length() < 100)).alias("short"))
    a = assign_openings(openings, walls, key=key, id_col=id_col)
    o = a.groupBy(key).agg(F.count_if(F.col("wall_id").isNull()).alias("unmatched"), F.count_if(F.col("wall_distance") > 500).alias("far"))
    counted = ["invalid", "thin", "thick", "short", "unmatched", "far"]
    r = w.join(o, key, "left").na.fill(0, ["unmatched", "far"])
    some = reduce(Column.__or__, [F.col(c) > 0 for c in counted]) | (F.col("axes") < 0.5 * F.col("n"))
    return r.withColumn("severity", F.when(F.col("axes") == 0, "critical").when(some, "attention").otherwise("ok"))


def readiness(walls: Column, rectangular: Column, constant: Column, connects: Column, boundaries: Column, layers: Column, format_ok: Column) -> Column:
    """100 minus the parts for footprints (20), thickness (10; both, 30, without any), connections (15), boundaries (10), layers (5), format (10)."""
    none = (walls == 0) | (rectangular == 0)
    part = lambda share, points: F.floor((1 - share / F.greatest(walls, F.lit(1))) * points)
    shape = F.when(none, 30).otherwise(part(rectangular, 20) + part(constant, 10))
    lacks = lambda c, points: F.when(c, 0).otherwise(points)
    score = 100 - shape - lacks(connects > 0, 15) - lacks(boundaries > 0, 10) - lacks(layers > 0, 5) - lacks(format_ok, 10)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")


def model_metrics(walls: DataFrame, connections: DataFrame, boundaries: DataFrame, layers: DataFrame, tolerance: float = 1.0, key: str = "plan_id") -> DataFrame:
    """Per plan of ``walls`` (footprints ``points``): walls, rectangular footprints (four corners, all square), constant thickness (four
    corners, opposite sides equal within the tolerance), and the rows of connections, boundaries and layers."""
    p = F.col("points")
    sides = G.let(p, lambda q: F.transform(G.edges(q), lambda e: F.struct((e["b"]["x"] - e["a"]["x"]).alias("dx"), (e["b"]["y"] - e["a"]["y"]).alias("dy"))))
    w = computed(walls.select(key, "points"), __s=sides)
    four, s = F.size("points") == 4, [F.col("__s")[i] for i in range(4)]
    n = [G.hypot(e["dx"], e["dy"]) for e in s]
    turns = [F.abs(a["dx"] * b["dx"] + a["dy"] * b["dy"]) <= tolerance for a, b in zip(s, s[1:] + s[:1], strict=True)]
    square, even = reduce(Column.__and__, turns), (F.abs(n[0] - n[2]) <= tolerance) & (F.abs(n[1] - n[3]) <= tolerance)
    m = w.withColumns({"__r": F.when(four, square), "__e": F.when(four, even)}).groupBy(key).agg(F.count("*").alias("n_walls"), F.count_if("__r").alias("rectangular"), F.count_if("__e").alias("constant"))
    rows = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    parts = [rows(connections, "connections"), rows(boundaries, "boundaries"), rows(layers, "layers")]
    return reduce(lambda a, b: a.join(b, key, "left"), parts, m).na.fill(0, ["connections", "boundaries", "layers"])


def quantity_consistency(axes: DataFrame, quantities: DataFrame, name: str = "Length", tolerance: float = 0.05, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Elements whose stored quantity (key, id, name, value) differs from the axis' length by more than the share ``tolerance`` of it:
    key, id, stored, length. An element with several stored values has a row for each that differs."""
    q = quantities.where((F.col("name") == name) & F.col("value").isNotNull()).select(key, id_col, F.col("value").alias("stored"))
    j = q.join(axes.select(key, id_col, length().alias("length")), [key, id_col])
    return j.where(F.abs(F.col("stored") - F.col("length")) > tolerance * F.col("length"))


def plan_qa(walls: DataFrame, connections: DataFrame, openings: DataFrame, hosts: DataFrame, rooms: DataFrame, tolerance: float = 10.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Per plan with walls the counters and the four numbers of issues with their total.

    connections: (key, id, neighbours); hosts: (key, id, wall_id) of the openings; rooms: (key, area, closed, n_walls).
    Issues: parallel walls on one another; openings without a host or beyond their wall's ends; rooms that aren't closed or
    have no area. A wall without a neighbour counts as disconnected, not as an issue; one whose axis has no length is one.
    """
    w = walls.select(key, id_col, length().alias("l")).join(connections.select(key, id_col, "neighbours"), [key, id_col], "left")
    w = w.groupBy(key).agg(F.count("*").alias("walls"), F.count_if(F.col("neighbours") > 0).alias("connected"), F.count_if(F.coalesce(F.col("l") <= 0, F.lit(True))).alias("connectivity_issues"))
    overlaps = parallel_overlaps(walls, tolerance, key=key, id_col=id_col).groupBy(key).agg(F.count("*").alias("overlap_issues"))
    p = on_wall(hosts.where("wall_id IS NOT NULL"), openings, walls, key, id_col)
    beyond = (F.round("span_from", 6) < -tolerance) | (F.round(F.col("span_to") - F.col("w_length"), 6) > tolerance)
    inside = p.groupBy(key).agg(F.count("*").alias("in_walls"), F.count_if(beyond).alias("beyond"))
    every = hosts.groupBy(key).agg(F.count("*").alias("openings"), F.count_if(F.col("wall_id").isNull()).alias("lost"))
    r = rooms.groupBy(key).agg(F.count("*").alias("rooms"), F.count_if(F.col("n_walls") > 0).alias("bounded"), F.sum((~F.col("closed")).cast("int") + (F.col("area") <= 0).cast("int")).alias("room_issues"))
    q = reduce(lambda a, b: a.join(b, key, "left"), [overlaps, every, inside, r], w).na.fill(0)
    q = q.withColumn("opening_issues", F.col("lost") + F.col("beyond")).drop("lost", "beyond")
    return q.withColumn("total", F.col("connectivity_issues") + F.col("overlap_issues") + F.col("opening_issues") + F.col("room_issues"))

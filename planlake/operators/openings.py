"""Openings on walls at any angle.

Openings have a key (plan_id), an id (det_id), a ring ``points`` and a type ``kind``; walls are those of ``walls``.
Key and id columns are parameters. An opening's direction is that of the long side of the least rectangle around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.operators.rings import with_least_rect
from planlake.operators.spatial import CELL, best_match, computed, grid_join, nearest
from planlake.operators.walls import AXIS, axis_box, cols, length
from planlake.session import materialize

# Fixed values, metres: type -> sill, head, height.
VERTICAL = (("DOOR", 0.0, 2.0, 2.0), ("WINDOW", 0.9, 2.1, 1.2))


def with_vertical(openings: DataFrame, depth: Column) -> DataFrame:
    """+ sill, height, head, depth from the type's defaults."""
    spark = openings.sparkSession
    rules = spark.createDataFrame(list(VERTICAL), "kind string, sill double, head0 double, height double")
    d = openings.join(F.broadcast(rules), "kind")
    return d.withColumn("head", F.greatest(F.col("head0"), F.col("sill") + F.col("height"))).withColumn("depth", depth)


def centred(openings: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """key, o_id, o_cx, o_cy, o_angle (degrees), o_points, o_kind."""
    o = openings.select(key, F.col(id_col).alias("o_id"), F.col("points").alias("o_points"), F.col("kind").alias("o_kind"))
    o = computed(with_least_rect(o, "o_points", "__m"), __c=G.let(F.col("o_points"), G.centroid))
    angle = G.line_angle(F.lit(0.0), F.lit(0.0), F.col("__m.dx"), F.col("__m.dy"))
    return o.select(key, "o_id", "o_points", "o_kind", F.col("__c.x").alias("o_cx"), F.col("__c.y").alias("o_cy"), angle.alias("o_angle"))


def sided(walls: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """key, w_id, w_x1..w_y2, w_thickness."""
    return walls.where(length() > 0).select(key, F.col(id_col).alias("w_id"), *[F.col(c).alias(f"w_{c}") for c in (*AXIS, "thickness")])


def side_box(thick: bool) -> tuple[Column, ...]:
    """The box of the axis, or that of the whole wall."""
    return axis_box("w_", F.col("w_thickness") / 2 if thick else 0.0)


def measured(pairs: DataFrame) -> DataFrame:
    """+ s (place on the axis, 0..1), axis_distance, wall_distance (of the centre to the wall's rectangle), degrees."""
    n = length("w_")
    dx, dy = (F.col("w_x2") - F.col("w_x1")) / n, (F.col("w_y2") - F.col("w_y1")) / n
    vx, vy = F.col("o_cx") - F.col("w_x1"), F.col("o_cy") - F.col("w_y1")
    pairs = pairs.withColumns({"along": vx * dx + vy * dy, "across": vy * dx - vx * dy, "w_length": n})
    beyond = F.greatest(F.lit(0.0), -F.col("along"), F.col("along") - F.col("w_length"))
    beside = F.greatest(F.lit(0.0), F.abs("across") - F.col("w_thickness") / 2)
    return pairs.withColumns({
        "s": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("along") / F.col("w_length"))),
        "axis_distance": F.round(G.hypot(beyond, F.col("across")) + 1e-9, 6),
        "wall_distance": F.round(G.hypot(beyond, beside) + 1e-9, 6),
        "degrees": G.angle_delta(F.col("o_angle"), G.line_angle(*cols("w_"))),
    })


def near_axes(openings: DataFrame, walls: DataFrame, reach: float, key: str = "plan_id", id_col: str = "det_id", thick: bool = False) -> DataFrame:
    """Openings with the walls whose axis, or whose rectangle where ``thick``, comes within ``reach`` of their centre, measured."""
    pairs = grid_join(centred(openings, key, id_col), sided(walls, key, id_col), ("o_cx", "o_cy", "o_cx", "o_cy"), side_box(thick), reach, max(reach, CELL), key)
    return measured(pairs).where(F.col("wall_distance" if thick else "axis_distance") <= reach)


def host_wall(openings: DataFrame, walls: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Key, id, wall_id, holds_centre: the wall whose rectangle holds the opening's centre or, if none does, meets the opening.

    Of several the smallest id; openings that meet no wall have no row. Rings are convex; touching counts, to a micrometre. Walls
    without length and rows with null coordinates take no part.
    """
    corners, slack = ("x0", "y0", "x1", "y1"), 1e-6
    o = openings.where("size(points) > 0").select(key, F.col(id_col).alias("o_id"), F.col("points").alias("o_points"), F.struct(G.bounds(F.col("points")).alias("b"), G.let(F.col("points"), G.centroid).alias("c")).alias("m"))
    o = o.select(key, "o_id", "o_points", *[F.col(f"m.b.{c}").alias(f"__o{c}") for c in corners], F.col("m.c.x").alias("__mx"), F.col("m.c.y").alias("__my"))
    pairs = grid_join(o, sided(walls, key, id_col), tuple(f"__o{c}" for c in corners), side_box(True), slack, CELL, key)
    n, half = length("w_"), F.col("w_thickness") / 2
    pairs = pairs.withColumns({"__n": n, "__dx": (F.col("w_x2") - F.col("w_x1")) / n, "__dy": (F.col("w_y2") - F.col("w_y1")) / n})

    def within(x: Column, y: Column, w: Column, h: Column) -> Column:
        """Whether a box of half sides w, h about (x, y) meets the wall along it and across; exact for a point."""
        u, v = x - F.col("w_x1"), y - F.col("w_y1")
        along, across = u * F.col("__dx") + v * F.col("__dy"), F.abs(v * F.col("__dx") - u * F.col("__dy"))
        ea, ec = w * F.abs("__dx") + h * F.abs("__dy"), w * F.abs("__dy") + h * F.abs("__dx")
        return (along + ea >= -slack) & (along - ea <= F.col("__n") + slack) & (across - ec <= half + slack)

    x, y, w, h = ((F.col(f"__o{p}1") + sign * F.col(f"__o{p}0")) / 2 for sign in (1, -1) for p in "xy")
    pairs = pairs.withColumns({"__held": within(F.col("__mx"), F.col("__my"), F.lit(0.0), F.lit(0.0)), "__box": within(x, y, w, h)})
    wall = G.rect_from_axis(*cols("w_"), F.col("w_thickness"))
    # Only a ring whose box meets the wall and whose centre is outside needs the test by its sides.
    meets = F.when(F.col("__held"), True).when(F.col("__box"), G.let(wall, lambda r: G.convex_meets(F.col("o_points"), r, slack))).otherwise(False)
    best = pairs.where(meets).groupBy(key, "o_id").agg(F.min(F.struct((~F.col("__held")).alias("out"), F.col("w_id").alias("w_id"))).alias("b"))
    return best.select(key, F.col("o_id").alias(id_col), F.col("b.w_id").alias("wall_id"), (~F.col("b.out")).alias("holds_centre"))


def assign_openings(openings: DataFrame, walls: DataFrame, max_distance: float = 500.0, max_degrees: float = 30.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Each opening's wall: key, id, wall_id, axis_distance, wall_distance, degrees.

    The best by (axis distance, wall distance, angle) among the axes within ``max_distance`` and ``max_degrees``; an opening
    without one gets the wall whose rectangle is nearest at any distance, with null axis_distance and degrees. Ties go to the
    smaller wall id. An opening of a plan without walls comes back with nulls. Distances are those of the opening's centre.
    """
    order = [F.col("axis_distance"), F.col("wall_distance"), F.col("degrees"), F.col("w_id")]
    near = best_match(near_axes(openings, walls, max_distance, key, id_col).where(F.col("degrees") <= max_degrees), [key, "o_id"], order)
    near = materialize(near.select(key, "o_id", "w_id", "axis_distance", "wall_distance", "degrees"), "opening-walls")
    left = centred(openings, key, id_col).join(near, [key, "o_id"], "left_anti")
    # The few left over meet all walls of their plan; every task keeps one row of an opening.
    far = measured(left.join(sided(walls, key, id_col), key)).groupBy(key, "o_id").agg(F.min(F.struct("wall_distance", "w_id")).alias("m"))
    far = far.select(key, "o_id", F.col("m.w_id").alias("w_id"), F.lit(None).cast("double").alias("axis_distance"), F.col("m.wall_distance").alias("wall_distance"), F.lit(None).cast("double").alias("degrees"))
    found = near.unionByName(far).withColumnsRenamed({"o_id": id_col, "w_id": "wall_id"})
    return openings.select(key, id_col).distinct().join(found, [key, id_col], "left")


def place_openings(openings: DataFrame, walls: DataFrame, max_distance: float = 100.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """C4: each opening's nearest wall axis within ``max_distance``: key, id, wall_id, axis_distance, s; nulls without one, ties by wall id."""
    best = best_match(near_axes(openings, walls, max_distance, key, id_col), [key, "o_id"], [F.col("axis_distance"), F.col("w_id")])
    best = best.select(key, F.col("o_id").alias(id_col), F.col("w_id").alias("wall_id"), "axis_distance", "s")
    return openings.select(key, id_col).distinct().join(best, [key, id_col], "left")


def substitute_openings(placed: DataFrame, others: DataFrame, walls: DataFrame, far: float = 20.0, least_confidence: float = 0.85, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """For placed openings farther than ``far`` from their wall, another model's confident opening within ``far`` of that wall.

    key, id, other. ``others`` are openings with a confidence. Each takes the candidate nearest to it along the wall; one that several
    want goes to the nearest of them, so the result doesn't depend on the order of rows; the others then stay as they are.
    """
    n = G.hypot(F.col("w_x2") - F.col("w_x1"), F.col("w_y2") - F.col("w_y1"))
    near = near_axes(others.where(F.col("confidence") > least_confidence), walls, far, key, id_col).where(F.col("axis_distance") < far)
    near = near.select(key, F.col("w_id").alias("wall_id"), F.col("o_id").alias("other"), F.col("s").alias("__t"), n.alias("__n")).distinct()
    want = placed.where(F.col("axis_distance") > far).select(key, id_col, "wall_id", "s")
    pairs = want.join(near, [key, "wall_id"]).withColumn("__d", F.round(F.abs(F.col("s") - F.col("__t")) * F.col("__n"), 6))
    one = best_match(pairs, [key, id_col], [F.col("__d"), F.col("other")])
    return best_match(one, [key, "other"], [F.col("__d"), F.col(id_col)]).select(key, id_col, "other")


def uncovered(openings: DataFrame, others: DataFrame, least: float = 0.5, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """The openings (all columns) that no other opening overlaps by an IoU above ``least``; rings may have any angle, others must be convex."""
    boxed = lambda df, p: df.select(key, F.col(id_col).alias(f"{p}id"), F.col("points").alias(f"{p}points"), *[v.alias(f"{p}{n}") for n, v in zip(("lx", "ly", "hx", "hy"), (G.bounds(F.col("points"))[c] for c in ("x0", "y0", "x1", "y1")), strict=True)])
    pairs = grid_join(boxed(openings, "a_"), boxed(others, "b_"), ("a_lx", "a_ly", "a_hx", "a_hy"), ("b_lx", "b_ly", "b_hx", "b_hy"), key=key)
    hit = pairs.where(G.iou(F.col("b_points"), F.col("a_points")) > least).select(key, F.col("a_id").alias(id_col))
    return openings.join(hit, [key, id_col], "left_anti")


def on_wall(assigned: DataFrame, openings: DataFrame, walls: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Assigned openings with their wall's columns and the opening's spans along and across its axis (C31): span_from, span_to, width, cross."""
    o = centred(openings, key, id_col).join(assigned.select(key, F.col(id_col).alias("o_id"), F.col("wall_id").alias("w_id")), [key, "o_id"])
    p = measured(o.join(sided(walls, key, id_col), [key, "w_id"]))
    dx, dy = (F.col("w_x2") - F.col("w_x1")) / F.col("w_length"), (F.col("w_y2") - F.col("w_y1")) / F.col("w_length")
    spans = lambda f: F.transform("o_points", lambda q: f(q["x"] - F.col("w_x1"), q["y"] - F.col("w_y1")))
    p = p.withColumns({"__a": spans(lambda x, y: x * dx + y * dy), "__b": spans(lambda x, y: y * dx - x * dy)})
    return p.withColumns({"span_from": F.array_min("__a"), "span_to": F.array_max("__a"), "width": F.array_max("__a") - F.array_min("__a"), "cross": F.array_max("__b") - F.array_min("__b")}).drop("__a", "__b")


# Fixed values, mm: least depth of an opening, default width by type.
LEAST_DEPTH = 80.0
DEFAULT_WIDTH = (("DOOR", 900.0), ("WINDOW", 1200.0))


def default_width() -> Column:
    return F.when(F.col("o_kind") == DEFAULT_WIDTH[0][0], DEFAULT_WIDTH[0][1]).otherwise(DEFAULT_WIDTH[1][1])


def opening_placement(assigned: DataFrame, openings: DataFrame, walls: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Key, id, wall_id, width (span along the axis, half the default at least), depth, cx, cy (the centre, clamped to the axis)."""
    p = on_wall(assigned, openings, walls, key, id_col)
    return p.select(key, F.col("o_id").alias(id_col), F.col("w_id").alias("wall_id"), *[v.alias(c) for c, v in _placement().items()])


def _placement() -> dict[str, Column]:
    """width, depth, cx and cy of C31 out of the columns of ``on_wall``."""
    t = F.col("w_thickness")
    width = F.greatest("width", default_width() / 2)
    depth = F.greatest(F.least(t, F.greatest(F.col("cross"), F.least(t, F.lit(LEAST_DEPTH)))), F.least(t, F.lit(LEAST_DEPTH / 2)))
    at = lambda a, b: F.col(f"w_{a}") + F.col("s") * (F.col(f"w_{b}") - F.col(f"w_{a}"))
    return {"width": width, "depth": depth, "cx": at("x1", "x2"), "cy": at("y1", "y2")}


def fit_opening(assigned: DataFrame, openings: DataFrame, walls: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Each opening's rectangle along its wall's axis, moved to where it overlaps the detection most.

    key, id, step, iou, width, depth, cx, cy. The direction is the axis' nearer one of 0 and 90 degrees; centres are the middle of the
    detection's span and its centroid, moved by -150..150 mm in steps of 20; the first best wins. Below an IoU of 0.05 the
    placement of C31 is kept, with a null step.
    """
    p = on_wall(assigned, openings, walls, key, id_col)
    upright = G.angle_delta(G.line_angle(*cols("w_")), F.lit(90.0)) <= 45
    p = computed(p, ux=F.when(upright, 0.0).otherwise(1.0), uy=F.when(upright, 1.0).otherwise(0.0), **{f"__{c}": v for c, v in _placement().items()})
    ux, uy, t = F.col("ux"), F.col("uy"), F.col("w_thickness")
    along = F.transform("o_points", lambda q: (q["x"] - F.col("w_x1")) * ux + (q["y"] - F.col("w_y1")) * uy)
    across = F.transform("o_points", lambda q: (q["y"] - F.col("w_y1")) * ux - (q["x"] - F.col("w_x1")) * uy)
    p = computed(p, __a=along, __b=across, __area=G.polygon_area(F.col("o_points")), __mid=(F.col("o_cx") - F.col("w_x1")) * ux + (F.col("o_cy") - F.col("w_y1")) * uy)
    p = computed(p, __a0=F.array_min("__a"), __a1=F.array_max("__a"), __b0=F.array_min("__b"), __b1=F.array_max("__b"))
    names = [key, "o_id", "o_points", "w_x1", "w_y1", "ux", "uy", "__width", "__depth", "__cx", "__cy", "__area", "__mid", "__a0", "__a1", "__b0", "__b1"]
    cross = F.greatest(F.lit(1.0), F.col("__b1") - F.col("__b0"))
    p = p.select(*names, F.greatest(F.lit(1.0), F.col("__a1") - F.col("__a0")).alias("width"), F.least(t, F.greatest(cross, F.least(t, F.lit(LEAST_DEPTH)))).alias("depth"), ((F.col("__a1") + F.col("__a0")) / 2).alias("__span"))
    # A ring that fills its box along and across the direction is that box, and what it shares is a product of two stretches.
    box = (F.col("__a1") - F.col("__a0")) * (F.col("__b1") - F.col("__b0"))
    half, side = F.col("width") / 2, F.greatest(F.lit(0.0), F.least(F.col("__b1"), F.col("depth") / 2) - F.greatest(F.col("__b0"), -F.col("depth") / 2))
    p = computed(p, __box=(F.col("__area") > 0) & (F.abs(box - F.col("__area")) <= 1e-12 * box), __half=half, __side=side, __both=F.col("width") * F.col("depth") + F.col("__area"))

    def box_iou(place: Column) -> Column:
        def ratio(shared: Column) -> Column:
            union = F.col("__both") - shared
            return F.when(union > 0, shared / union).otherwise(0.0)

        stretch = F.least(F.col("__a1"), place + F.col("__half")) - F.greatest(F.col("__a0"), place - F.col("__half"))
        return G.let(F.greatest(F.lit(0.0), stretch) * F.col("__side"), ratio)

    def ring_iou(place: Column) -> Column:
        rect = G.rect_from_centre(F.col("w_x1") + ux * place, F.col("w_y1") + uy * place, F.col("width"), F.col("depth"), ux, uy)
        return G.iou(rect, F.col("o_points"))

    def best(iou) -> Column:
        """The first best of all places, chosen within the opening's row: places aren't rows of their own, to be shuffled and sorted."""
        tried = lambda turn, at: F.transform(F.sequence(F.lit(-150), F.lit(150), F.lit(20)), lambda step: F.struct((-F.round(iou(F.col(at) + step) + 1e-9, 6)).alias("iou"), F.lit(turn).alias("turn"), step.alias("step")))
        return F.array_min(F.concat(tried(0, "__span"), tried(1, "__mid")))

    p = computed(p, __m=F.when(F.col("__box"), best(box_iou)).otherwise(best(ring_iou)))
    place = F.when(F.col("__m.turn") == 0, F.col("__span")).otherwise(F.col("__mid")) + F.col("__m.step")
    p = p.select("*", (-F.col("__m.iou")).alias("iou"), F.col("__m.step").alias("step"), (F.col("w_x1") + ux * place).alias("cx"), (F.col("w_y1") + uy * place).alias("cy"))
    fits = F.col("iou") >= 0.05
    pick = lambda name: F.when(fits, F.col(name)).otherwise(F.col(f"__{name}")).alias(name)
    return p.select(key, F.col("o_id").alias(id_col), F.when(fits, F.col("step")).alias("step"), F.when(fits, F.col("iou")).otherwise(0.0).alias("iou"), *map(pick, ("width", "depth", "cx", "cy")))


def opening_bias(fitted: DataFrame, assigned: DataFrame, openings: DataFrame, walls: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Fitted openings (C30: key, id, cx, cy) moved back by their plan's bias: key, id, orientation, bias, cx, cy.

    An opening's offset is how far the fitted centre lies from the detection's along its wall; the bias is the median offset of the
    plan's openings in walls of the same orientation: V where the wall runs straight up, else H.
    """
    p = on_wall(assigned, openings, walls, key, id_col)
    n = F.col("w_length")
    p = p.select(key, F.col("o_id").alias(id_col), "o_cx", "o_cy", ((F.col("w_x2") - F.col("w_x1")) / n).alias("__dx"), ((F.col("w_y2") - F.col("w_y1")) / n).alias("__dy"))
    f = fitted.select(key, id_col, "cx", "cy").join(p, [key, id_col])
    off = (F.col("cx") - F.col("o_cx")) * F.col("__dx") + (F.col("cy") - F.col("o_cy")) * F.col("__dy")
    # Read twice: by the medians and by the openings that they move.
    f = materialize(f.withColumns({"__off": off, "orientation": F.when(F.abs("__dx") < 1e-6, "V").otherwise("H")}), "fitted-offsets")
    f = f.join(f.groupBy(key, "orientation").agg(F.median("__off").alias("bias")), [key, "orientation"])
    moved = lambda c: F.col(f"c{c}") - F.col(f"__d{c}") * F.col("bias")
    return f.select(key, id_col, "orientation", "bias", moved("x").alias("cx"), moved("y").alias("cy"))


def fill_to_opening(fills: DataFrame, openings: DataFrame, reach: float = 2000.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """For each fill (a door or window element, ring ``points``) the opening of its plan whose centre is nearest, at any distance:
    key, id, opening_id, distance; nulls in a plan without openings."""
    at = lambda df: df.withColumn("__c", G.let(F.col("points"), G.centroid)).select(key, id_col, F.col("__c.x").alias("x"), F.col("__c.y").alias("y"))
    best = nearest(at(fills), at(openings), reach, key, id_col).withColumnRenamed("other", "opening_id")
    return fills.select(key, id_col).distinct().join(best, [key, id_col], "left")


# The sizes tried, and the least width and depth that is left (mm).
SCALES = (1.0, 0.98, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5)
LEAST_SIZE = (100.0, 40.0)


def fit_inside(placed: DataFrame, walls: DataFrame, tolerance: float = 5.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """+ scale, the largest size at which a placed opening (key, id, wall_id, cx, cy, width, depth) lies inside its wall's
    rectangle by the tolerance, along and across the axis; null if none does."""
    w = sided(walls, key, id_col).withColumnRenamed("w_id", "wall_id")
    p = placed.withColumns({"o_cx": F.col("cx"), "o_cy": F.col("cy"), "o_angle": F.lit(0.0)}).join(w, [key, "wall_id"])
    p = measured(p)
    room = F.col("w_length") / 2 - F.abs(F.col("along") - F.col("w_length") / 2) - tolerance
    side = F.col("w_thickness") / 2 - F.abs("across") - tolerance
    # Both sides rounded: sizes that just fit mustn't hang on the last bit of a projection.
    size = lambda s, c: F.round(s * F.col(c), 6)
    fits = lambda s: (size(s / 2, "width") <= F.round(room, 6)) & (size(s / 2, "depth") <= F.round(side, 6)) & ((s == 1) | ((size(s, "width") >= LEAST_SIZE[0]) & (size(s, "depth") >= LEAST_SIZE[1])))
    return p.withColumn("scale", F.array_max(F.filter(F.array(*map(F.lit, SCALES)), fits))).select(*placed.columns, "scale")


def clip_to_wall(openings: DataFrame, walls: DataFrame, reach: float = 100.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Openings on their nearest wall within ``reach`` of its rectangle: key, id, wall_id, clipped (the ring's part inside the wall), area.

    Openings without such a wall have nulls; an opening that lies beside its wall has an empty ring and area 0.
    """
    pairs = near_axes(openings, walls, reach, key, id_col, thick=True)
    best = best_match(pairs, [key, "o_id"], [F.col("wall_distance"), F.col("axis_distance"), F.col("w_id")])
    rect = G.rect_from_axis(*cols("w_"), F.col("w_thickness"))
    best = best.withColumn("clipped", G.convex_clip(F.col("o_points"), rect)).select(key, F.col("o_id").alias(id_col), F.col("w_id").alias("wall_id"), "clipped")
    best = best.withColumn("area", F.when(F.size("clipped") > 0, G.polygon_area(F.col("clipped"))).otherwise(0.0))
    return openings.select(key, id_col).distinct().join(best, [key, id_col], "left")

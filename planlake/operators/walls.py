"""Walls by their axes at any angle: matches, connections, overlaps, gaps, scores.

A wall table has a key (plan_id), an id (det_id), an axis (x1, y1, x2, y2), a thickness and, where named, a confidence.
Key and id columns are parameters; other columns are ignored unless said. Rows with a null key, id or coordinate
take part in nothing. Axes without length have the direction (1, 0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.operators.graph import components
from planlake.operators.planar import regions
from planlake.operators.rings import with_iou, with_least_rect
from planlake.operators.spatial import barrier, best_match, computed, grid_join, self_pairs
from planlake.session import materialize

AXIS = ("x1", "y1", "x2", "y2")
#: Cells for endless lines: their least size, and how many a plan's extent has along an axis at most.
LINE_CELL, CELLS = 500.0, 256


def cols(prefix: str, names: tuple[str, ...] = AXIS) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def known(walls: DataFrame) -> DataFrame:
    """The walls whose ends are known."""
    return walls.where(" AND ".join(f"{c} IS NOT NULL" for c in AXIS))


def axis_box(prefix: str, grow: Column | float = 0.0) -> tuple[Column, ...]:
    """The box of the axis, grown: x0, y0, x1, y1."""
    x1, y1, x2, y2 = cols(prefix)
    return F.least(x1, x2) - grow, F.least(y1, y2) - grow, F.greatest(x1, x2) + grow, F.greatest(y1, y2) + grow


def rect_box(prefix: str, grow: Column | float = 0.0) -> tuple[Column, ...]:
    """The box of the wall's rectangle, grown: the same numbers as the bounds of ``geom.rect_from_axis``; the axis must have a length."""
    (x1, y1, x2, y2), n, t = cols(prefix), length(prefix), F.col(f"{prefix}thickness")
    ox, oy = F.abs((y2 - y1) / n * t / 2), F.abs((x2 - x1) / n * t / 2)
    return F.least(x1, x2) - ox - grow, F.least(y1, y2) - oy - grow, F.greatest(x1, x2) + ox + grow, F.greatest(y1, y2) + oy + grow


def length(prefix: str = "") -> Column:
    x1, y1, x2, y2 = cols(prefix)
    return G.hypot(x2 - x1, y2 - y1)


def angle_between(a: str = "a_", b: str = "b_") -> Column:
    """Degrees between two axes, 0..90."""
    return G.angle_delta(G.line_angle(*cols(a)), G.line_angle(*cols(b)))


def middle(prefix: str) -> tuple[Column, Column]:
    x1, y1, x2, y2 = cols(prefix)
    return (x1 + x2) / 2, (y1 + y2) / 2


def middle_to_line(point: str, line: str) -> Column:
    """Distance of one axis' middle to the other's endless line."""
    (mx, my), (x1, y1, x2, y2) = middle(point), cols(line)
    return F.abs((mx - x1) * (y2 - y1) - (my - y1) * (x2 - x1)) / length(line)


def middle_distance(a: str = "a_", b: str = "b_") -> Column:
    (ax, ay), (bx, by) = middle(a), middle(b)
    return G.hypot(ax - bx, ay - by)


def near_lines(first: DataFrame, second: DataFrame, max_degrees: float, max_distance: float, columns: tuple[str, ...] = (), key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Pairs (a_*, b_*) of a plan with directions within ``max_degrees`` and a's middle within ``max_distance`` of b's endless line: + degrees, distance.

    A middle lies in one cell of its plan's extent; an endless line is written to the cells of that extent which it comes near, at most one
    range of cells for each of up to CELLS columns or rows. Pairs meet by cell and by band of directions, so only near ones of a direction do.
    """
    bands = int(180 // max_degrees)
    names = [id_col, *AXIS, *columns]
    band = F.floor(G.line_angle(*cols("")) * bands / 180).cast("int") % bands
    (mx, my), n = middle(""), length()
    a = first.where(n > 0).select(key, *[F.col(c).alias(f"a_{c}") for c in names], mx.alias("__mx"), my.alias("__my"), F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda s: F.pmod(band + s, F.lit(bands))))).alias("__band"))
    extent = first.where(n > 0).groupBy(key).agg(F.min(mx).alias("__x0"), F.min(my).alias("__y0"), F.max(mx).alias("__x1"), F.max(my).alias("__y1"))
    size = F.greatest(F.lit(LINE_CELL), (F.col("__x1") - F.col("__x0")) / CELLS, (F.col("__y1") - F.col("__y0")) / CELLS)
    extent = extent.withColumn("__size", size)
    to = lambda v, low: F.floor((v - F.col(low)) / F.col("__size")).cast("int")
    a = a.join(extent, key).withColumns({"__cx": to(F.col("__mx"), "__x0"), "__cy": to(F.col("__my"), "__y0")}).drop("__mx", "__my", "__x0", "__y0", "__x1", "__y1", "__size")
    b = second.where(n > 0).select(key, *[F.col(c).alias(f"b_{c}") for c in names], band.alias("__band")).join(extent, key)
    dx, dy = F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    flat = F.abs(dx) >= F.abs(dy)
    # u runs along the axis that the line is nearer to, v across it; v = at + slope * u, counted from the extent's corner.
    b = b.withColumns({
        "__slope": F.when(flat, dy / F.nullif(dx, F.lit(0.0))).otherwise(dx / F.nullif(dy, F.lit(0.0))),
        "__nu": F.when(flat, to(F.col("__x1"), "__x0")).otherwise(to(F.col("__y1"), "__y0")),
        "__nv": F.when(flat, to(F.col("__y1"), "__y0")).otherwise(to(F.col("__x1"), "__x0")),
    })
    px, py = F.col("b_x1") - F.col("__x0"), F.col("b_y1") - F.col("__y0")
    b = b.withColumn("__at", F.when(flat, py - F.col("__slope") * px).otherwise(px - F.col("__slope") * py)).withColumn("__u", F.explode(F.sequence(F.lit(0), F.col("__nu"))))
    v = [F.col("__at") + F.col("__slope") * F.col("__size") * (F.col("__u") + i) for i in (0, 1)]
    pad = 1.5 * max_distance + 1e-3  # across a slope of 1 at most
    b = b.withColumns({"__from": F.greatest(F.lit(0), F.floor((F.least(*v) - pad) / F.col("__size")).cast("int")), "__to": F.least(F.col("__nv"), F.floor((F.greatest(*v) + pad) / F.col("__size")).cast("int"))})
    b = b.where(F.col("__from") <= F.col("__to")).withColumn("__v", F.explode(F.sequence("__from", "__to")))
    b = b.select(key, *[f"b_{c}" for c in names], "__band", F.when(flat, F.col("__u")).otherwise(F.col("__v")).alias("__cx"), F.when(flat, F.col("__v")).otherwise(F.col("__u")).alias("__cy"))
    pairs = a.join(b, [key, "__band", "__cx", "__cy"]).drop("__band", "__cx", "__cy").withColumns({"degrees": angle_between(), "distance": middle_to_line("a_", "b_")})
    return pairs.where((F.col("degrees") <= max_degrees) & (F.col("distance") <= max_distance))


def match_walls(first: DataFrame, second: DataFrame, max_degrees: float = math.degrees(0.2), max_distance: float = 30.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Each first wall's best second wall by confidence, length ratio, line distance and angle: key, id, other, score.

    Pairs with the same score go to the smaller id. Walls without a match are left out.
    """
    pairs = near_lines(first, second, max_degrees, max_distance, ("confidence",), key, id_col)
    score = F.col("b_confidence") * F.least(length("a_"), length("b_")) / F.greatest(length("a_"), length("b_")) * (1 - F.col("distance") / max_distance) * (1 - F.col("degrees") / max_degrees)
    best = best_match(pairs.withColumn("score", F.round(score + 1e-9, 6)), [key, f"a_{id_col}"], [F.desc("score"), F.col(f"b_{id_col}")])
    return best.select(key, F.col(f"a_{id_col}").alias(id_col), F.col(f"b_{id_col}").alias("other"), "score")


def dedupe_lines(lines: DataFrame, max_degrees: float = math.degrees(0.1), max_distance: float = 20.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """The lines without a better one (more confidence, then smaller id) of their direction whose middle lies near their line."""
    pairs = near_lines(lines, lines, max_degrees, max_distance, ("confidence",), key, id_col)
    better = (F.col("a_confidence") > F.col("b_confidence")) | ((F.col("a_confidence") == F.col("b_confidence")) & (F.col(f"a_{id_col}") < F.col(f"b_{id_col}")))
    gone = pairs.where(better).select(key, F.col(f"b_{id_col}").alias(id_col))
    return lines.join(gone, [key, id_col], "left_anti")


def parallel_overlaps(walls: DataFrame, tolerance: float = 100.0, max_degrees: float = math.degrees(0.1), key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Pairs of walls of nearly one direction whose middles lie within twice the tolerance."""
    mid = dict(zip(("mx", "my"), middle(""), strict=True))
    pairs = self_pairs(walls.withColumns(mid), ("mx", "my", "mx", "my"), list(AXIS), 2 * tolerance, id_col, key=key)
    return pairs.where((angle_between() < max_degrees) & (middle_distance() < 2 * tolerance)).select(key, f"a_{id_col}", f"b_{id_col}")


def wall_connections(walls: DataFrame, reach: float = 150.0, close: float = 75.0, max_degrees: float = 15.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """C20: pairs of axes that cross, or come within ``reach`` nearly square or parallel, or within ``close``: + how."""
    pairs = self_pairs(known(walls), axis_box, list(AXIS), reach, id_col, key=key)
    # Named columns behind a barrier: each is worked out once a pair, in compiled code.
    pairs = barrier(pairs.withColumns({"d": F.round(G.segments_distance(cols("a_"), cols("b_")), 6), "t": angle_between()}))
    aligned = (F.col("t") <= max_degrees) | (F.col("t") >= 90 - max_degrees)
    how = F.when(F.col("d") == 0, "cross").when(F.col("d") <= close, "near").when((F.col("d") <= reach) & aligned, "aligned")
    return pairs.withColumn("how", how).where("how IS NOT NULL").select(key, f"a_{id_col}", f"b_{id_col}", "how")


def refine_axes(axes: DataFrame, lines: DataFrame, max_degrees: float = 7.0, reach: float = 1000.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Each axis turned to the direction of the line with the least 10 * degrees + distance of the middles, at any distance.

    key, id, line_id, score and the new x1..y2; centre and length stay. Lines within ``reach`` are found by the grid; a score of ``reach`` or
    less can't be beaten from farther away. The axes left over meet the lines of their plan by direction, and each task keeps one
    line an axis. Axes without a line within ``max_degrees`` are left out; ties go to the smaller line id.
    """
    names = lambda p: [F.col(c).alias(f"{p}{c}") for c in (id_col, *AXIS)] + [m.alias(f"{p}{n}") for m, n in zip(middle(""), ("mx", "my"), strict=True)]
    left, right = axes.where(length() > 0).select(key, *names("a_")), lines.where(length() > 0).select(key, *names("b_"))
    pairs = grid_join(left, right, ("a_mx", "a_my", "a_mx", "a_my"), ("b_mx", "b_my", "b_mx", "b_my"), reach, key=key)
    pick = F.min(F.struct("score", f"b_{id_col}", *[f"b_{c}" for c in AXIS])).alias("m")

    def best(pairs: DataFrame) -> DataFrame:
        pairs = barrier(pairs.withColumns({"t": angle_between(), "d": middle_distance()})).where(F.col("t") <= max_degrees)
        return pairs.withColumn("score", F.round(10 * F.col("t") + F.col("d") + 1e-9, 6)).groupBy(key, f"a_{id_col}", *[f"a_{c}" for c in (*AXIS, "mx", "my")]).agg(pick)

    near = materialize(best(pairs).where(F.col("m.score") <= reach), "refined-near")
    rest = left.join(near, [key, f"a_{id_col}"], "left_anti")
    bands = int(180 // max_degrees)
    band = lambda p: F.floor(G.line_angle(*cols(p)) * bands / 180).cast("int") % bands
    spread = F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda s: F.pmod(band("a_") + s, F.lit(bands)))))
    far = best(rest.withColumn("__band", spread).join(right.withColumn("__band", band("b_")), [key, "__band"]))
    found = near.unionByName(far).select(key, *[f"a_{c}" for c in (id_col, *AXIS, "mx", "my")], F.col("m.score").alias("score"), *[F.col(f"m.b_{c}").alias(f"b_{c}") for c in (id_col, *AXIS)])
    dx, dy = (F.col("b_x2") - F.col("b_x1")) / length("b_"), (F.col("b_y2") - F.col("b_y1")) / length("b_")
    sign = F.when(dx * (F.col("a_x2") - F.col("a_x1")) + dy * (F.col("a_y2") - F.col("a_y1")) < 0, -0.5).otherwise(0.5) * length("a_")
    ends = [(F.col("a_mx") - dx * sign).alias("x1"), (F.col("a_my") - dy * sign).alias("y1"), (F.col("a_mx") + dx * sign).alias("x2"), (F.col("a_my") + dy * sign).alias("y2")]
    return found.select(key, F.col(f"a_{id_col}").alias(id_col), F.col(f"b_{id_col}").alias("line_id"), "score", *ends)


def axis_ends(walls: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """One row per end: key, id, thickness, e (1 or 2), x, y."""
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("e"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)]))
    return walls.select(key, id_col, "thickness", both.alias("end")).select(key, id_col, "thickness", "end.e", "end.x", "end.y")


def orientation_bases(axes: DataFrame, key: str = "plan_id") -> DataFrame:
    """Per plan how many axes lie nearest to 0, to 90 and to 45 or 135 degrees, and use_45: whether the last are more than a sixth.

    Ties go to 0, then to 90. Axes without length count as 0; those with null coordinates don't count.
    """
    a = G.line_angle(*cols(""))
    flat, up, slanted = F.least(a, 180 - a), F.abs(a - 90), F.least(F.abs(a - 45), F.abs(a - 135))
    nearest_base = F.when((flat <= up) & (flat <= slanted), 0).when(up <= slanted, 90).otherwise(45)
    d = axes.where(" AND ".join(f"{c} IS NOT NULL" for c in AXIS)).select(key, nearest_base.alias("base"))
    n = lambda v, name: F.count_if(F.col("base") == v).alias(name)
    d = d.groupBy(key).agg(n(0, "zero"), n(90, "ninety"), n(45, "forty_five"), F.count("*").alias("n"))
    return d.select(key, "zero", "ninety", "forty_five", (F.col("forty_five") > F.floor(F.col("n") / 6)).alias("use_45"))


def gap_classes(walls: DataFrame, near: float = 50.0, far: float = 100.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Of all pairs of a plan's walls, how many have their nearest ends ``near`` to ``far`` apart (medium) or farther (large); + small.

    Only pairs of ends within ``far`` are made; all other pairs are large, and counted as what is left of n (n - 1) / 2. Rows with the same id are
    no pair. Plans with a single id have no row.
    """
    ends = F.explode(F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)])).alias("p")
    rows = walls.withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows.select(key, id_col, "__row", ends).select(key, id_col, "__row", "p.x", "p.y"), "gap-ends")
    pairs = self_pairs(rows, ("x", "y", "x", "y"), ["__row"], far, id_col, key=key)
    gap = G.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    least = pairs.withColumn("g", gap).where(F.col("g") <= far).groupBy(key, "a___row", "b___row").agg(F.min("g").alias("g"))
    close = least.groupBy(key).agg(F.count_if(F.col("g") <= near).alias("small"), F.count_if(F.col("g") > near).alias("medium"))
    each = rows.groupBy(key, id_col).agg(F.count_distinct("__row").alias("k"))
    # Pairs of rows with different ids: half of (all rows squared less the ids' own squares).
    total = each.groupBy(key).agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).cast("long").alias("pairs")).where("pairs > 0")
    out = total.join(close, key, "left").na.fill(0, ["small", "medium"])
    return out.select(key, "small", "medium", (F.col("pairs") - F.col("small") - F.col("medium")).alias("large"))


def close_gaps(walls: DataFrame, reach: float = 100.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """C14: the walls with ends that lie within ``reach`` of each other, directly or through others, moved to their mean.

    All columns stay; x1..y2 change. One pass over clusters, so the result doesn't depend on the order of rows.
    """
    n = axis_ends(walls, key, id_col).withColumn("id", F.concat_ws("#", id_col, "e")).select(key, "id", "x", "y").distinct()
    near = self_pairs(n, ("x", "y", "x", "y"), [], reach, "id", key=key)
    near = near.where((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2 <= reach * reach)
    label = components(near.select(key, F.col("a_id").alias("src"), F.col("b_id").alias("dst")), keys=(key,)).withColumnRenamed("node", "id")
    placed = n.join(label, [key, "id"])
    mean = placed.groupBy(key, "component").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    moved = placed.join(mean, [key, "component"]).select(key, "id", "mx", "my").distinct()
    for e in (1, 2):
        own = moved.select(key, F.col("id").alias("__id"), F.col("mx").alias("__mx"), F.col("my").alias("__my"))
        walls = walls.withColumn("__id", F.concat_ws("#", id_col, F.lit(e))).join(own, [key, "__id"], "left")
        walls = walls.withColumns({f"x{e}": F.coalesce("__mx", f"x{e}"), f"y{e}": F.coalesce("__my", f"y{e}")}).drop("__id", "__mx", "__my")
    return walls


def wall_overlaps(walls: DataFrame, least: float = 100.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Pairs whose rectangles share more than ``least`` of length (area over mean thickness) and that are no T-junction: + overlap."""
    pairs = self_pairs(known(walls), lambda p: axis_box(p, F.col(f"{p}thickness") / 2), [*AXIS, "thickness"], 0.0, id_col, key=key)
    # Rectangles of the pairs that are near: those of all walls needn't be shuffled.
    pairs = computed(pairs, **{f"{p}rect": G.rect_from_axis(*cols(p), F.col(f"{p}thickness")) for p in ("a_", "b_")}).where("a_rect IS NOT NULL AND b_rect IS NOT NULL")
    area = G.shared_area(F.col("a_rect"), F.col("b_rect"))
    # Worked out once a pair, and ahead of the test for T-junctions.
    pairs = barrier(computed(pairs, overlap=area / ((F.col("a_thickness") + F.col("b_thickness")) / 2)).where(F.col("overlap") > least))
    half = F.greatest("a_thickness", "b_thickness") / 2

    def runs_into(a: str, b: str) -> Column:
        """An end of a lies at b's axis, inside its middle part."""
        margin = F.greatest(F.lit(50.0), 0.1 * length(b))
        out = F.lit(False)
        for i in (1, 2):
            p = G.project_on_line(F.col(f"{a}x{i}"), F.col(f"{a}y{i}"), *cols(b))
            along = F.round(p["s"] * length(b), 6)
            out = out | ((F.round(p["distance"], 6) <= half) & (along > margin) & (length(b) - along > margin))
        return out

    return pairs.where(~(runs_into("a_", "b_") | runs_into("b_", "a_"))).select(key, f"a_{id_col}", f"b_{id_col}", "overlap")


def resolve_overlaps(walls: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """C17: of walls that truly overlap, directly or through others, the largest stays (all columns); ties by id."""
    over = wall_overlaps(walls, key=key, id_col=id_col).select(key, F.col(f"a_{id_col}").alias("src"), F.col(f"b_{id_col}").alias("dst"))
    label = components(over, keys=(key,)).withColumnRenamed("node", id_col)
    w = walls.join(label, [key, id_col], "left").withColumn("component", F.coalesce("component", id_col)).withColumn("__area", length() * F.col("thickness"))
    return best_match(w, [key, "component"], [F.desc("__area"), F.col(id_col)]).drop("__area", "component")


def merge_collinear(axes: DataFrame, max_degrees: float = 1.0, offset: float = 5.0, gap: float = 5.0, least: float = 60.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Axes on one line that overlap, or follow each other within ``gap``, merged: key, id (the smallest of them), x1..y2, thickness
    (the mean by length, D19), n_merged; merged axes shorter than ``least`` go.

    Two axes are neighbours if their directions differ by ``max_degrees`` at most and, on the line of the longer one, the
    shorter one's middle lies within ``offset`` and its span within ``gap`` of the longer one's. Components of neighbours are merged
    on the direction of their longest axis (ties: smallest id), at the mean offset by length. No bins: lines a little apart always meet.
    Rows that repeat are one axis; axes without length are left out.
    """
    a = axes.select(key, id_col, *AXIS, "thickness").distinct().withColumn("n", F.round(length(), 6)).where("n > 0")
    a = materialize(a, "collinear-axes")
    # The shorter one's middle is near the line, its ends may lie farther off by what its half length makes of the angle.
    tilt = lambda p: axis_box(p, F.col(f"{p}n") / 2 * math.sin(math.radians(max_degrees)))
    pairs = self_pairs(a, tilt, [*AXIS, "n"], offset + gap, id_col, key=key)
    long = lambda c, mine="b_", other="a_": F.when(F.col("b_n") > F.col("a_n"), F.col(f"{mine}{c}")).otherwise(F.col(f"{other}{c}"))
    pairs = pairs.withColumns({**{f"l_{c}": long(c) for c in (*AXIS, "n")}, **{f"s_{c}": long(c, "a_", "b_") for c in AXIS}})
    pairs = pairs.withColumns({"ux": (F.col("l_x2") - F.col("l_x1")) / F.col("l_n"), "uy": (F.col("l_y2") - F.col("l_y1")) / F.col("l_n"), "turned": angle_between("l_", "s_")})
    on = lambda i: (F.col(f"s_x{i}") - F.col("l_x1")) * F.col("ux") + (F.col(f"s_y{i}") - F.col("l_y1")) * F.col("uy")
    off = lambda i: (F.col(f"s_y{i}") - F.col("l_y1")) * F.col("ux") - (F.col(f"s_x{i}") - F.col("l_x1")) * F.col("uy")
    pairs = barrier(pairs.withColumns({"from": F.least(on(1), on(2)), "to": F.greatest(on(1), on(2)), "off": F.round(F.abs(off(1) + off(2)) / 2, 6)}))
    apart = F.round(F.greatest(F.col("from") - F.col("l_n"), -F.col("to")), 6)
    near = pairs.where((F.col("turned") <= max_degrees) & (F.col("off") <= offset) & (apart <= gap))
    label = components(near.select(key, F.col(f"a_{id_col}").alias("src"), F.col(f"b_{id_col}").alias("dst")), keys=(key,)).withColumnRenamed("node", id_col)
    a = materialize(a.join(label, [key, id_col], "left").withColumn("component", F.coalesce("component", id_col)), "collinear-groups")
    lead = a.groupBy(key, "component").agg(F.min_by(F.struct(*AXIS, "n"), F.struct(-F.col("n"), id_col)).alias("l"))
    m = a.join(lead, [key, "component"]).withColumns({"ux": (F.col("l.x2") - F.col("l.x1")) / F.col("l.n"), "uy": (F.col("l.y2") - F.col("l.y1")) / F.col("l.n")})
    along = lambda i: (F.col(f"x{i}") - F.col("l.x1")) * F.col("ux") + (F.col(f"y{i}") - F.col("l.y1")) * F.col("uy")
    across = lambda i: (F.col(f"y{i}") - F.col("l.y1")) * F.col("ux") - (F.col(f"x{i}") - F.col("l.x1")) * F.col("uy")
    m = m.withColumns({"from": F.least(along(1), along(2)), "to": F.greatest(along(1), along(2)), "off": (across(1) + across(2)) / 2})
    by_length = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    m = m.groupBy(key, "component").agg(F.first("l").alias("l"), F.first("ux").alias("ux"), F.first("uy").alias("uy"), F.min("from").alias("from"), F.max("to").alias("to"), by_length("off").alias("off"), by_length("thickness").alias("thickness"), F.count(F.lit(1)).alias("n_merged"))
    at = lambda t: ((F.col("l.x1") + F.col(t) * F.col("ux") - F.col("off") * F.col("uy")), (F.col("l.y1") + F.col(t) * F.col("uy") + F.col("off") * F.col("ux")))
    ends = dict(zip(AXIS, (*at("from"), *at("to")), strict=True))
    return m.where(F.col("to") - F.col("from") >= least).select(key, F.col("component").alias(id_col), *[v.alias(c) for c, v in ends.items()], "thickness", "n_merged")


def merge_overlaps(walls: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """C17: walls that truly overlap (C16), directly or through others, merged: key, component (their smallest id), n_walls, area,
    n_holes, points (the outline of the union; of several parts, one row each). Walls that overlap nothing keep their rectangle."""
    over = wall_overlaps(walls, key=key, id_col=id_col).select(key, F.col(f"a_{id_col}").alias("src"), F.col(f"b_{id_col}").alias("dst"))
    label = components(over, keys=(key,)).withColumnRenamed("node", id_col)
    rect = walls.select(key, id_col, G.rect_from_axis(*cols(""), F.col("thickness")).alias("points")).where("points IS NOT NULL").distinct()
    rect = materialize(rect.join(label, [key, id_col], "left").withColumn("component", F.coalesce("component", id_col)), "overlapping-walls")
    n = rect.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n_walls"))
    alone = rect.join(n.where("n_walls = 1"), [key, "component"]).select(key, "component", "n_walls", G.polygon_area(F.col("points")).alias("area"), F.lit(0).cast("long").alias("n_holes"), "points")
    # Each group is a drawing of its own.
    groups = materialize(n.where("n_walls > 1").withColumn("__group", F.monotonically_increasing_id()), "overlapping-groups")
    drawn = rect.join(groups, [key, "component"]).select("__group", "points")
    merged = regions(drawn, "__group").where("covered").join(groups, "__group").select(key, "component", "n_walls", "area", "n_holes", "points")
    return alone.unionByName(merged)


def wall_scores(built: DataFrame, detected: DataFrame, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """Built axes measured against the detected polygons of the same id (C33): key, id, iou, thickness_delta, length_delta,
    centroid_delta, degrees, score (0..100), status.

    Detections have ``points``; their thickness, length and direction are those of the least rectangle around them. Walls without a
    detection are left out.
    """
    w = built.select(key, id_col, *AXIS, "thickness").join(detected.select(key, id_col, F.col("points").alias("__points")), [key, id_col])
    # Behind the join: what axis and polygon tell needn't be shuffled.
    w = computed(w, __rect=G.rect_from_axis(*cols(""), F.col("thickness")), __c=G.let(F.col("__points"), G.centroid))
    w = with_iou(with_least_rect(w, "__points", "__box"), "__rect", "__points", "__iou")
    mx, my = middle("")
    w = w.withColumns({
        "iou": F.round("__iou", 9),
        "thickness_delta": F.col("thickness") - F.col("__box.width"),
        "length_delta": length() - F.col("__box.length"),
        "centroid_delta": G.hypot(mx - F.col("__c.x"), my - F.col("__c.y")),
        "degrees": G.angle_delta(G.line_angle(*cols("")), G.line_angle(F.lit(0.0), F.lit(0.0), F.col("__box.dx"), F.col("__box.dy"))),
    })
    parts = ((0.2, "thickness_delta", 50.0), (0.2, "length_delta", 250.0), (0.1, "centroid_delta", 75.0), (0.1, "degrees", 15.0))
    score = 0.4 * F.col("iou")
    for weight, name, limit in parts:
        score = score + weight * G.score_component(F.col(name), limit)
    w = w.withColumn("score", F.round(100 * score + 1e-9, 6))
    off = F.round(F.abs("thickness_delta"), 6)
    status = F.when((F.col("iou") < 0.3) & (off > 80), "FAIL").when((F.col("score") >= 75) & (F.col("iou") >= 0.55) & (off <= 60), "PASS").otherwise("WARN")
    return w.select(key, id_col, "iou", "thickness_delta", "length_delta", "centroid_delta", "degrees", "score", status.alias("status"))


def geometry_choice(walls: DataFrame, points: str = "points") -> DataFrame:
    """Walls (x1..y2, thickness, polygon) + ``choice``: keep the detected polygon where the axis rectangle differs from it (IoU below
    0.75); the rectangle where the polygon fills more than 85 % of its own; else the axis."""
    w = computed(walls, __rect=G.rect_from_axis(*cols(""), F.col("thickness")), __area=G.polygon_area(F.col(points)))
    w = with_iou(with_least_rect(w, points, "__box"), "__rect", points, "__iou")
    choice = F.when(F.col("__iou") < 0.75, "polygon").when(F.col("__area") / F.nullif(F.col("__box.area"), F.lit(0.0)) > 0.85, "rectangle").otherwise("axis")
    return w.select(*walls.columns, choice.alias("choice"))

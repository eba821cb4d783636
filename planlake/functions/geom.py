"""Geometry as column expressions on ARRAY<STRUCT<x DOUBLE, y DOUBLE>> (B4-B42, C23). All run in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STANDARD_THICKNESS = (115.0, 240.0, 300.0, 400.0, 500.0)
EXTERNAL_DEFAULT, INTERNAL_DEFAULT = 240.0, 115.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p["x"])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p["y"])


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def fsum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once: columns in lambdas are copied wherever they are named."""
    return F.transform(F.array(value), body)[0]


def nxt(points: Column) -> Column:
    """The points moved up by one, the first one last."""
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def edges(points: Column) -> Column:
    """array<struct(a, b)> of the closed ring's sides."""
    return F.zip_with(points, nxt(points), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def px_to_mm(points: Column, px_per_mm: Column, flip_y: bool = False, height: Column | None = None) -> Column:
    """B4."""
    return F.transform(points, lambda p: point(p["x"] / px_per_mm, ((height - p["y"]) if flip_y else p["y"]) / px_per_mm))


def precision_error(points: Column, px_per_mm: Column, digits: int = 3) -> Column:
    """Largest round-trip error in pixels after rounding millimetres."""
    back = lambda v: F.abs(F.round(v / px_per_mm, digits) * px_per_mm - v)
    return F.array_max(F.transform(points, lambda p: F.greatest(back(p["x"]), back(p["y"]))))


def ring(points: Column) -> Column:
    """Closed ring, with one closing point."""
    open_ = F.when((F.size(points) > 1) & (points[0] == F.element_at(points, -1)), F.slice(points, 1, F.size(points) - 1)).otherwise(points)
    return F.concat(open_, F.slice(open_, 1, 1))


def polygon_area(points: Column) -> Column:
    """Shoelace."""
    return F.abs(signed_area(points))


def signed_area(points: Column) -> Column:
    return let(points, lambda q: fsum(F.transform(edges(q), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2)


def bounds(points: Column) -> Column:
    """B13."""
    return F.struct(F.array_min(xs(points)).alias("x0"), F.array_min(ys(points)).alias("y0"), F.array_max(xs(points)).alias("x1"), F.array_max(ys(points)).alias("y1"))


def snap_to_grid(points: Column, grid: Column) -> Column:
    """Half-even rounding to the grid."""
    return F.transform(points, lambda p: point(F.rint(p["x"] / grid) * grid, F.rint(p["y"] / grid) * grid))


def centroid(points: Column) -> Column:
    return point(fsum(xs(points)) / F.size(points), fsum(ys(points)) / F.size(points))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    l2 = dx * dx + dy * dy
    s = F.when(l2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / l2))).otherwise(0.0)
    return hypot(p["x"] - a["x"] - s * dx, p["y"] - a["y"] - s * dy)


def polygon_thickness(points: Column) -> Column:
    """Twice the least distance of the centroid to the boundary."""

    def nearest_side(v: Column) -> Column:
        return F.array_min(F.transform(v["sides"], lambda s: side_distance2(v["c"]["x"], v["c"]["y"], s)))

    # The centroid and the sides are worked out once, not at every place where they are named.
    return 2 * F.sqrt(let(let(points, lambda q: F.struct(centroid(q).alias("c"), ring_sides(q).alias("sides"))), nearest_side))


def drop_collinear(points: Column, tolerance: Column | float) -> Column:
    """Points closer to the line of their neighbours than the tolerance go; fewer than 3 left: unchanged."""
    before = F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.size(points) - 1))
    trio = F.arrays_zip(before.alias("p"), points.alias("q"), nxt(points).alias("r"))
    tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    kept = F.transform(F.filter(trio, lambda t: segment_distance(t["q"], t["p"], t["r"]) > tol), lambda t: t["q"])
    return F.when(F.size(kept) >= 3, kept).otherwise(points)


def line_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction in degrees, modulo 180."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))


def angle_delta(a: Column, b: Column) -> Column:
    """Folded to 0..90."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def edge_kinds(points: Column, tolerance: float = 5.0) -> Column:
    """H, V or O (other) for every side of the ring."""
    t = math.tan(math.radians(tolerance))
    dx, dy = (lambda e: F.abs(e["b"]["x"] - e["a"]["x"])), (lambda e: F.abs(e["b"]["y"] - e["a"]["y"]))
    return F.transform(edges(points), lambda e: F.when(dy(e) <= t * dx(e), "H").when(dx(e) <= t * dy(e), "V").otherwise("O"))


def right_angle(points: Column, tolerance: float = 5.0) -> Column:
    """Each point takes the coordinate of the one before it where their side is H or V; the first stays."""
    t = math.tan(math.radians(tolerance))

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        dx, dy = F.abs(p["x"] - last["x"]), F.abs(p["y"] - last["y"])
        return F.concat(done, F.array(point(F.when((dx <= t * dy) & ~(dy <= t * dx), last["x"]).otherwise(p["x"]), F.when(dy <= t * dx, last["y"]).otherwise(p["y"]))))

    return F.aggregate(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1), step)


def longest_edge(points: Column) -> Column:
    """struct(len2, dx, dy) of the longest side; ties by larger dx, then dy."""
    return F.array_max(F.transform(edges(points), lambda e: F.struct(((e["b"]["x"] - e["a"]["x"]) ** 2 + (e["b"]["y"] - e["a"]["y"]) ** 2).alias("len2"), (e["b"]["x"] - e["a"]["x"]).alias("dx"), (e["b"]["y"] - e["a"]["y"]).alias("dy"))))


def oriented_rect(points: Column) -> Column:
    """struct(area, width, length, dx, dy) of the least rectangle with a side along a pair of points (exact: a hull side is one).

    (dx, dy) is the unit direction of the long side, pointing right, or up.
    """

    def extent(d: Column) -> Column:
        n = hypot(d["x"], d["y"])
        along = F.transform(points, lambda p: (p["x"] * d["x"] + p["y"] * d["y"]) / n)
        across = F.transform(points, lambda p: (p["y"] * d["x"] - p["x"] * d["y"]) / n)
        span = lambda values: let(values, lambda v: F.array_max(v) - F.array_min(v))

        def rect(s: Column) -> Column:
            u, v = s["u"], s["v"]
            dx, dy = F.when(u >= v, d["x"] / n).otherwise(-d["y"] / n), F.when(u >= v, d["y"] / n).otherwise(d["x"] / n)
            sign = F.when((dx < -1e-12) | ((F.abs(dx) <= 1e-12) & (dy < 0)), -1.0).otherwise(1.0)
            return F.struct(F.round(u * v, 6).alias("area"), F.round(F.least(u, v), 6).alias("width"), F.round(F.greatest(u, v), 6).alias("length"), (dx * sign).alias("dx"), (dy * sign).alias("dy"))

        return let(F.struct(span(along).alias("u"), span(across).alias("v")), rect)

    return let(points, lambda q: _least_rect(q, extent))


def _least_rect(points: Column, extent: Callable[[Column], Column]) -> Column:
    later = lambda i: F.slice(points, i + 2, F.size(points))
    directions = F.flatten(F.transform(points, lambda a, i: F.transform(later(i), lambda b: point(b["x"] - a["x"], b["y"] - a["y"]))))
    return F.array_min(F.transform(F.filter(directions, lambda d: (d["x"] != 0) | (d["y"] != 0)), extent))


def default_thickness(external: Column) -> Column:
    """B22."""
    return F.when(external, EXTERNAL_DEFAULT).otherwise(INTERNAL_DEFAULT)


def snap_thickness(value: Column, external: Column) -> Column:
    """Default where unknown or below 40, the nearest standard where that is more than 10 away, else the value."""
    near = F.array_min(F.array(*[F.struct(F.abs(value - s).alias("d"), F.lit(s).alias("v")) for s in STANDARD_THICKNESS]))
    return F.when(value.isNull() | (value < 40), default_thickness(external)).when(near["d"] > 10, near["v"]).otherwise(value)


def snap_axis(x1: Column, y1: Column, x2: Column, y2: Column, bases: tuple[float, ...] = (0.0, 45.0, 90.0), tolerance: float = 10.0) -> Column:
    """The axis turned about its middle to the nearest base direction within the tolerance, length kept."""
    angle = line_angle(x1, y1, x2, y2)
    # In radians 90 degrees have a cosine of 6e-17: exact directions keep an upright axis upright, and its ends where they are.
    exact = lambda v: F.lit(0.0 if abs(v) < 1e-15 else v)
    best = F.array_min(F.array(*[F.struct(angle_delta(angle, F.lit(b)).alias("d"), F.lit(b).alias("b"), exact(math.cos(math.radians(b))).alias("ux"), exact(math.sin(math.radians(b))).alias("uy")) for b in bases]))
    half, mx, my = hypot(x2 - x1, y2 - y1) / 2, (x1 + x2) / 2, (y1 + y2) / 2
    sign = F.when(best["ux"] * (x2 - x1) + best["uy"] * (y2 - y1) < 0, -1.0).otherwise(1.0)
    cx, cy = best["ux"] * half * sign, best["uy"] * half * sign
    turn = best["d"] <= tolerance
    pick = lambda new, old: F.when(turn, new).otherwise(old)
    return F.struct(pick(mx - cx, x1).alias("x1"), pick(my - cy, y1).alias("y1"), pick(mx + cx, x2).alias("x2"), pick(my + cy, y2).alias("y2"))


def rect_from_axis(x1: Column, y1: Column, x2: Column, y2: Column, width: Column) -> Column:
    """The four corners; an axis without length has none."""
    n = hypot(x2 - x1, y2 - y1)
    ox, oy = -(y2 - y1) / n * width / 2, (x2 - x1) / n * width / 2
    return F.when(n > 0, F.array(point(x1 + ox, y1 + oy), point(x2 + ox, y2 + oy), point(x2 - ox, y2 - oy), point(x1 - ox, y1 - oy)))


def rect_from_centre(cx: Column, cy: Column, width: Column, depth: Column, dx: Column, dy: Column) -> Column:
    """Width along the unit direction (dx, dy)."""
    w, d = width / 2, depth / 2
    corner = lambda a, b: point(cx + a * w * dx - b * d * dy, cy + a * w * dy + b * d * dx)
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def project_on_line(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct(s, distance) with s clamped to 0..1."""
    dx, dy = x2 - x1, y2 - y1
    l2 = dx * dx + dy * dy
    s = F.when(l2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / l2))).otherwise(0.0)
    return F.struct(s.alias("s"), hypot(px - x1 - s * dx, py - y1 - s * dy).alias("distance"))


def apply_similarity(points: Column, scale: Column, cos_: Column, sin_: Column, tx: Column, ty: Column) -> Column:
    """B28."""
    return F.transform(points, lambda p: point(scale * (cos_ * p["x"] - sin_ * p["y"]) + tx, scale * (sin_ * p["x"] + cos_ * p["y"]) + ty))


def score_component(delta: Column, limit: float) -> Column:
    """B34."""
    return F.greatest(F.lit(0.0), 1 - F.least(F.abs(delta), F.lit(limit)) / limit)


def axis_measure(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct(length, dx, dy); direction (1, 0) for no length."""
    n = hypot(x2 - x1, y2 - y1)
    return F.struct(n.alias("length"), F.when(n > 0, (x2 - x1) / n).otherwise(1.0).alias("dx"), F.when(n > 0, (y2 - y1) / n).otherwise(0.0).alias("dy"))


def rect_check(points: Column, tolerance: float = 1.0) -> Column:
    """struct(thickness, ok): four corners, right angles, two distinct side lengths."""
    e = edges(points)
    lens = F.transform(e, lambda v: hypot(v["b"]["x"] - v["a"]["x"], v["b"]["y"] - v["a"]["y"]))
    turns = F.zip_with(e, nxt(e), lambda u, v: F.abs((u["b"]["x"] - u["a"]["x"]) * (v["b"]["x"] - v["a"]["x"]) + (u["b"]["y"] - u["a"]["y"]) * (v["b"]["y"] - v["a"]["y"])))
    square = (F.size(points) == 4) & F.forall(turns, lambda d: d <= tolerance)
    kinds = F.array_distinct(F.transform(lens, lambda v: F.round(v / tolerance)))
    return F.struct(F.array_min(lens).alias("thickness"), (square & (F.size(kinds) == 2)).alias("ok"))


def space_filter(points: Column, ex0: Column, ey0: Column, ex1: Column, ey1: Column, least_area: float = 5000.0, least_side: float = 200.0, reach: float = 150.0) -> Column:
    """Large and wide enough, and within ``reach`` of the envelope (ex0, ey0, ex1, ey1)."""
    b = bounds(points)
    wide = F.least(b["x1"] - b["x0"], b["y1"] - b["y0"]) >= least_side
    near = (b["x0"] <= ex1 + reach) & (b["x1"] >= ex0 - reach) & (b["y0"] <= ey1 + reach) & (b["y1"] >= ey0 - reach)
    return (polygon_area(points) >= least_area) & wide & near


def contains(points: Column, px: Column, py: Column) -> Column:
    """Strictly inside, by crossings of a ray to the right."""
    crossings = F.filter(edges(points), lambda e: ((e["a"]["y"] > py) != (e["b"]["y"] > py)) & (px < (e["b"]["x"] - e["a"]["x"]) * (py - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.pmod(F.size(crossings), F.lit(2)) == 1


def convex_meets(a: Column, b: Column, slack: float = 1e-6) -> Column:
    """Whether two convex rings (or points, as rings of one) share a point, within ``slack``: no side of either parts them."""

    def apart(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        off = lambda ring: F.transform(ring, lambda p: dx * (p["y"] - e["a"]["y"]) - dy * (p["x"] - e["a"]["x"]))
        gap = F.greatest(F.array_min(off(b)) - F.array_max(off(a)), F.array_min(off(a)) - F.array_max(off(b)))
        return gap > slack * hypot(dx, dy)

    return ~F.exists(F.concat(edges(a), edges(b)), apart)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """C23 for axis-parallel boxes (x0, y0, x1, y1)."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def convex_clip(poly: Column, convex: Column) -> Column:
    """The part of a polygon inside a convex one (Sutherland-Hodgman, one fold per side of the convex one)."""

    def cut(done: Column, e: Column) -> Column:
        # Each corner's side of the line is worked out once; then neighbours are compared.
        side = lambda p: (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"])
        sided = F.transform(done, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), side(p).alias("d")))

        def pieces(a: Column, b: Column) -> Column:
            t = a["d"] / (a["d"] - b["d"])
            cross = point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))
            end = point(b["x"], b["y"])
            inside, stays = a["d"] >= 0, b["d"] >= 0
            return F.when(inside & stays, F.array(end)).when(inside, F.array(cross)).when(stays, F.array(cross, end)).otherwise(F.slice(F.array(end), 1, 0))

        return F.flatten(let(sided, lambda q: F.zip_with(q, nxt(q), pieces)))

    turned = let(convex, lambda c: F.when(signed_area(c) >= 0, c).otherwise(F.reverse(c)))
    return F.aggregate(let(turned, edges), poly, cut)


def _below(a: Column, b: Column, length: Column, width: Column) -> Column:
    """Signed area between the side a-b and the base of a box (0, 0, length, width), inside the box; corners are structs (u, v)."""
    hold = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    slope = F.coalesce((b["v"] - a["v"]) / F.nullif(b["u"] - a["u"], F.lit(0.0)), F.lit(0.0))

    def ends(s: Column) -> Column:
        on = lambda u: a["v"] + (u - a["u"]) * s["slope"]
        return F.struct((s["to"] - s["from"]).alias("run"), F.least(on(s["from"]), on(s["to"])).alias("lo"), F.greatest(on(s["from"]), on(s["to"])).alias("hi"))

    def mean(s: Column) -> Column:
        low, high = F.greatest(s["lo"], F.lit(0.0)), F.least(s["hi"], width)
        over = F.greatest(F.lit(0.0), s["hi"] - F.greatest(s["lo"], width))
        height = (width * over + F.greatest(F.lit(0.0), high - low) * (low + high) / 2) / F.nullif(s["hi"] - s["lo"], F.lit(0.0))
        return F.when(s["run"] == 0, 0.0).otherwise(s["run"] * F.coalesce(height, hold(s["lo"], width)))

    return let(let(F.struct(hold(a["u"], length).alias("from"), hold(b["u"], length).alias("to"), slope.alias("slope")), ends), mean)


def rect_share(poly: Column, rect: Column) -> Column:
    """Area of a polygon without holes inside a rectangle of four corners: the areas below its sides, held to the rectangle's frame, add up."""

    def framed(f: Column) -> Column:
        local = F.transform(poly, lambda p: F.struct(((p["x"] - f["x"]) * f["ux"] + (p["y"] - f["y"]) * f["uy"]).alias("u"), ((p["x"] - f["x"]) * f["vx"] + (p["y"] - f["y"]) * f["vy"]).alias("v")))
        return F.abs(let(local, lambda q: fsum(F.zip_with(q, nxt(q), lambda a, b: _below(a, b, f["length"], f["width"])))))

    o, p, r = rect[0], rect[1], rect[3]
    n, m = hypot(p["x"] - o["x"], p["y"] - o["y"]), hypot(r["x"] - o["x"], r["y"] - o["y"])
    frame = F.struct(o["x"].alias("x"), o["y"].alias("y"), ((p["x"] - o["x"]) / n).alias("ux"), ((p["y"] - o["y"]) / n).alias("uy"), ((r["x"] - o["x"]) / m).alias("vx"), ((r["y"] - o["y"]) / m).alias("vy"), n.alias("length"), m.alias("width"))
    return let(frame, framed)


def is_rectangle(points: Column) -> Column:
    """Four corners, opposite sides equal, a right angle, no side without length."""
    o, p, q, r = (points[i] for i in range(4))
    ax, ay, bx, by = p["x"] - o["x"], p["y"] - o["y"], r["x"] - o["x"], r["y"] - o["y"]
    n = ax * ax + ay * ay + bx * bx + by * by
    shut = (F.abs(o["x"] + ax + bx - q["x"]) + F.abs(o["y"] + ay + by - q["y"])) ** 2 <= 1e-18 * n
    return (F.size(points) == 4) & shut & (F.abs(ax * bx + ay * by) <= 1e-9 * n) & (F.abs(ax * by - ay * bx) > 1e-9 * n)


def shared_area(poly: Column, convex: Column) -> Column:
    """Area of a polygon inside a convex one; boxes that lie apart are not clipped, and rectangles have a closed form."""
    def clipped(v: Column) -> Column:
        a, b = v["a"], v["b"]
        apart = (b["x0"] > a["x1"]) | (a["x0"] > b["x1"]) | (b["y0"] > a["y1"]) | (a["y0"] > b["y1"])
        return F.when(apart, 0.0).when(is_rectangle(convex), rect_share(poly, convex)).otherwise(polygon_area(convex_clip(poly, convex)))

    return let(F.struct(bounds(poly).alias("a"), bounds(convex).alias("b")), clipped)


def iou(rect: Column, poly: Column) -> Column:
    """Intersection over union of a convex polygon and any polygon without holes."""

    def ratio(v: Column) -> Column:
        union = v["a"] + v["b"] - v["both"]
        return F.when(union > 0, v["both"] / union).otherwise(0.0)

    measured = lambda v: F.struct(polygon_area(v["r"]).alias("a"), polygon_area(v["p"]).alias("b"), shared_area(v["p"], v["r"]).alias("both"))
    return let(let(F.struct(rect.alias("r"), poly.alias("p")), measured), ratio)


def segments_distance(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Distance of two segments (x1, y1, x2, y2); 0 where they cross."""
    pa, pb = (point(a[0], a[1]), point(a[2], a[3])), (point(b[0], b[1]), point(b[2], b[3]))
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    crosses = (turn(*pa, pb[0]) * turn(*pa, pb[1]) < 0) & (turn(*pb, pa[0]) * turn(*pb, pa[1]) < 0)
    return F.when(crosses, 0.0).otherwise(F.least(*[segment_distance(p, *pb) for p in pa], *[segment_distance(p, *pa) for p in pb]))


def ring_sides(points: Column) -> Column:
    """array<struct(x, y, dx, dy, l2)>: the sides of a closed ring by start, direction and squared length."""
    side = lambda e: F.struct(e["a"]["x"].alias("x"), e["a"]["y"].alias("y"), (e["b"]["x"] - e["a"]["x"]).alias("dx"), (e["b"]["y"] - e["a"]["y"]).alias("dy"))
    return F.transform(F.transform(edges(points), side), lambda s: s.withField("l2", s["dx"] * s["dx"] + s["dy"] * s["dy"]))


def side_distance2(x: Column, y: Column, side: Column) -> Column:
    """Squared distance of a point to one of ``ring_sides``."""

    def off(r: Column) -> Column:
        u, v, t = r["u"], r["v"], r["t"]
        cross = u * side["dy"] - v * side["dx"]
        end_u, end_v = u - side["dx"], v - side["dy"]
        return F.when(t <= 0, u * u + v * v).when(t >= side["l2"], end_u * end_u + end_v * end_v).otherwise(cross * cross / side["l2"])

    u, v = x - side["x"], y - side["y"]
    return let(F.struct(u.alias("u"), v.alias("v"), (u * side["dx"] + v * side["dy"]).alias("t")), off)


def sides_cross(s: Column, t: Column) -> Column:
    """Whether two of ``ring_sides`` cross in their inner parts."""
    turn = lambda p, x, y: p["dx"] * (y - p["y"]) - p["dy"] * (x - p["x"])
    parted = lambda p, q: turn(p, q["x"], q["y"]) * turn(p, q["x"] + q["dx"], q["y"] + q["dy"]) < 0
    return parted(s, t) & parted(t, s)


def rings_distance(a: Column, b: Column) -> Column:
    """Distance of two rings' areas (no holes, any shape): 0 where one holds a corner of the other or their sides meet."""

    def apart(v: Column) -> Column:
        p, q = v["p"], v["q"]
        crosses = F.exists(p, lambda s: F.exists(q, lambda t: sides_cross(s, t)))
        corners = lambda m, n: F.array_min(F.transform(m, lambda s: F.array_min(F.transform(n, lambda t: side_distance2(s["x"], s["y"], t)))))
        return F.when(crosses, 0.0).otherwise(F.sqrt(F.least(corners(p, q), corners(q, p))))

    holds = contains(a, b[0]["x"], b[0]["y"]) | contains(b, a[0]["x"], a[0]["y"])
    return F.when(holds, 0.0).otherwise(let(F.struct(ring_sides(a).alias("p"), ring_sides(b).alias("q")), apart))


def overlap_area(a: Column, b: Column) -> Column:
    """Area shared by two rings without holes, of any shape and turning either way.

    A ring is the signed sum of the strips below its sides, so the shared area is the signed sum, over pairs of sides, of the
    area below both: over the stretch that they share, the mean of their heights less half the mean of their difference.
    """

    def strips(points: Column, box: Column) -> Column:
        sloped = F.filter(edges(points), lambda e: e["a"]["x"] != e["b"]["x"])

        def strip(e: Column) -> Column:
            dx = e["b"]["x"] - e["a"]["x"]
            slope = (e["b"]["y"] - e["a"]["y"]) / dx
            at = e["a"]["x"] - box["x0"]
            return F.struct(F.least(at, at + dx).alias("s"), F.greatest(at, at + dx).alias("e"), slope.alias("m"), (e["a"]["y"] - box["y0"] - slope * at).alias("c"), F.signum(dx).alias("sign"))

        return F.transform(sloped, strip)

    def below(p: Column, q: Column) -> Column:
        start, end = F.greatest(p["s"], q["s"]), F.least(p["e"], q["e"])
        height = lambda r, x: r["m"] * x + r["c"]
        u, v = height(p, start) - height(q, start), height(p, end) - height(q, end)
        part = F.abs(u) + F.abs(v)
        apart = F.when(u * v >= 0, part / 2).otherwise((u * u + v * v) / (2 * part))
        mean = (height(p, start) + height(q, start) + height(p, end) + height(q, end)) / 4
        return F.when(end > start, p["sign"] * q["sign"] * (end - start) * (mean - apart / 2)).otherwise(0.0)

    def shared(v: Column) -> Column:
        return F.abs(fsum(F.transform(v["p"], lambda p: fsum(F.transform(v["q"], lambda q: below(p, q))))))

    def boxed(v: Column) -> Column:
        p, q = v["p"], v["q"]
        box = F.struct(F.least(p["x0"], q["x0"]).alias("x0"), F.least(p["y0"], q["y0"]).alias("y0"))
        apart = (q["x0"] > p["x1"]) | (p["x0"] > q["x1"]) | (q["y0"] > p["y1"]) | (p["y0"] > q["y1"])
        return F.when(apart, 0.0).otherwise(let(F.struct(strips(a, box).alias("p"), strips(b, box).alias("q")), shared))

    return let(F.struct(bounds(a).alias("p"), bounds(b).alias("q")), boxed)

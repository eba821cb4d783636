"""Measures of rings of four corners in plain arithmetic, which Spark compiles (B20, C23, D6); other rings go through the lambdas of ``geom``.

A lambda is interpreted, node by node and point by point: on four corners that costs about a hundred microseconds a ring. The arithmetic and its
order are those of ``geom``, so both ways give the same figures.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.operators.spatial import computed


def _corners(points: Column, prefix: str) -> dict[str, Column]:
    """The coordinates of the first four corners; NaN where one is missing."""
    return {f"{prefix}{c}{i}": F.coalesce(F.get(points, F.lit(i))[c], F.lit(float("nan"))) for i in range(4) for c in "xy"}


def _four(points: Column, prefix: str) -> Column:
    """Whether a ring has four corners, all known."""
    return F.coalesce(F.size(points) == 4, F.lit(False)) & reduce(Column.__and__, [~F.isnan(f"{prefix}{c}{i}") for i in range(4) for c in "xy"])


def corners(df: DataFrame, points: str, prefix: str) -> DataFrame:
    """``df`` + the coordinates of its rings' first four corners: prefix + x0..y3."""
    return df.withColumns(_corners(F.col(points), prefix))


def four_corners(points: Column, prefix: str) -> Column:
    """Whether a ring has four corners, all known."""
    return _four(points, prefix)


def in_four(prefix: str, px: Column, py: Column) -> Column:
    """``geom.contains`` of a ring of four corners."""

    def crossed(i: int) -> Column:
        (ax, ay), (bx, by) = ((F.col(f"{prefix}x{k}"), F.col(f"{prefix}y{k}")) for k in (i, (i + 1) % 4))
        return ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    # Without a slope a side is level, and its first test is false.
    return reduce(lambda a, b: a != b, [F.coalesce(crossed(i), F.lit(False)) for i in range(4)])


def with_least_rect(df: DataFrame, points: str, name: str) -> DataFrame:
    """``df`` + ``geom.oriented_rect`` of its rings."""
    d = df.withColumns(_corners(F.col(points), "__r")).withColumn("__four", _four(F.col(points), "__r"))
    x, y = ([F.col(f"__r{c}{i}") for i in range(4)] for c in "xy")
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        # One pair of corners a step, parted by an explode: a method that holds all six is too long for the JVM to compile. Later
        # expressions name earlier ones of their step.
        along, across = [", ".join(f % (c, c) for c in range(4)) for f in (f"__rx%d * __dx{k} + __ry%d * __dy{k}", f"__ry%d * __dx{k} - __rx%d * __dy{k}")]
        d = d.selectExpr(
            "*", f"__rx{j} - __rx{i} AS __dx{k}", f"__ry{j} - __ry{i} AS __dy{k}", f"nullif(sqrt(__dx{k} * __dx{k} + __dy{k} * __dy{k}), 0D) AS __n{k}",
            f"greatest({along}) AS __t{k}", f"least({along}) AS __f{k}", f"greatest({across}) AS __o{k}", f"least({across}) AS __i{k}",
            f"__t{k} / __n{k} - __f{k} / __n{k} AS __u{k}", f"__o{k} / __n{k} - __i{k} / __n{k} AS __v{k}",
            f"IF(__u{k} >= __v{k}, __dx{k} / __n{k}, -__dy{k} / __n{k}) AS __ex{k}", f"IF(__u{k} >= __v{k}, __dy{k} / __n{k}, __dx{k} / __n{k}) AS __ey{k}",
        )
        sign = f"IF(__ex{k} < -1e-12D OR abs(__ex{k}) <= 1e-12D AND __ey{k} < 0, -1D, 1D)"
        d = d.selectExpr("*", f"explode(array(IF(__n{k} IS NOT NULL, struct(round(__u{k} * __v{k}, 6) AS area, round(least(__u{k}, __v{k}), 6) AS width, round(greatest(__u{k}, __v{k}), 6) AS length, __ex{k} * {sign} AS dx, __ey{k} * {sign} AS dy), NULL))) AS __least{k}")
    least = F.array_min(F.array(*[F.col(f"__least{k}") for k in range(6)]))
    return computed(d.select(*df.columns, "__four", least.alias("__least")), **{name: F.when(F.col("__four"), F.col("__least")).otherwise(G.oriented_rect(F.col(points)))}).drop("__four", "__least")


def with_iou(df: DataFrame, rect: str, points: str, name: str) -> DataFrame:
    """``df`` + ``geom.iou`` of a rectangle's corners (``geom.rect_from_axis``, else null) and its ring."""
    d = df.withColumns(_corners(F.col(points), "__p") | _corners(F.col(rect), "__r"))
    d = d.withColumn("__four", _four(F.col(points), "__p") & _four(F.col(rect), "__r"))
    p, r = ([(F.col(f"__{s}x{i}"), F.col(f"__{s}y{i}")) for i in range(4)] for s in "pr")
    minus = lambda a, b: (a[0] - b[0], a[1] - b[1])
    (ax, ay), (bx, by) = minus(r[1], r[0]), minus(r[3], r[0])
    d = d.withColumns({"__n": F.nullif(G.hypot(ax, ay), F.lit(0.0)), "__m": F.nullif(G.hypot(bx, by), F.lit(0.0))})
    n, m = F.col("__n"), F.col("__m")
    d = computed(d, __ux=ax / n, __uy=ay / n, __vx=bx / m, __vy=by / m)
    ux, uy, vx, vy = (F.col(f"__{c}") for c in ("ux", "uy", "vx", "vy"))
    local = {}
    for i, (x, y) in enumerate(p):
        local |= {f"__u{i}": (x - r[0][0]) * ux + (y - r[0][1]) * uy, f"__v{i}": (x - r[0][0]) * vx + (y - r[0][1]) * vy}
    d = computed(d, **local)
    hold = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    for i in range(4):
        # The area below a side, inside the rectangle: ``geom._below``.
        j = (i + 1) % 4
        au, av, bu, bv = (F.col(f"__{c}{k}") for k in (i, j) for c in "uv")
        d = d.withColumns({"__from": hold(au, n), "__to": hold(bu, n), "__slope": F.coalesce((bv - av) / F.nullif(bu - au, F.lit(0.0)), F.lit(0.0))})
        on = lambda u, au=au, av=av: av + (u - au) * F.col("__slope")
        d = d.withColumns({"__run": F.col("__to") - F.col("__from"), "__s": on(F.col("__from")), "__e": on(F.col("__to"))})
        d = d.withColumns({"__lo": F.least("__s", "__e"), "__hi": F.greatest("__s", "__e")})
        lo, hi, run = F.col("__lo"), F.col("__hi"), F.col("__run")
        low, high = F.greatest(lo, F.lit(0.0)), F.least(hi, m)
        over = F.greatest(F.lit(0.0), hi - F.greatest(lo, m))
        height = (m * over + F.greatest(F.lit(0.0), high - low) * (low + high) / 2) / F.nullif(hi - lo, F.lit(0.0))
        d = computed(d, **{f"__below{i}": F.when(run == 0, 0.0).otherwise(run * F.coalesce(height, hold(lo, m)))})
    total = lambda terms: reduce(Column.__add__, terms, F.lit(0.0))
    area = lambda q: F.abs(total([a[0] * b[1] - b[0] * a[1] for a, b in zip(q, q[1:] + q[:1], strict=True)]) / 2)
    apart = reduce(Column.__or__, [F.least(*[a[c] for a in s]) > F.greatest(*[b[c] for b in t]) for s, t in ((p, r), (r, p)) for c in (0, 1)])
    # Without a side the rectangle is none: the general way tells what is left of it.
    d = d.withColumns({"__four": F.col("__four") & n.isNotNull() & m.isNotNull() & (n * m > 0), "__both": F.when(apart, 0.0).otherwise(F.abs(total([F.col(f"__below{i}") for i in range(4)]))), "__a": area(r), "__b": area(p)})
    d = computed(d, __ok=F.coalesce(F.col("__four"), F.lit(False)), __share=F.col("__both"), __union=F.col("__a") + F.col("__b") - F.col("__both"))
    ratio = F.when(F.col("__union") > 0, F.col("__share") / F.col("__union")).otherwise(0.0)
    return computed(d.select(*df.columns, "__ok", ratio.alias("__ratio")), **{name: F.when(F.col("__ok"), F.col("__ratio")).otherwise(G.iou(F.col(rect), F.col(points)))}).drop("__ok", "__ratio")

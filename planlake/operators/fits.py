"""Lines and similarities fitted to points of each key in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.functions import geom as G


def line_fit(points: DataFrame, x: str = "x", y: str = "y", key: str = "plan_id") -> DataFrame:
    """The line along the principal direction of each key's points: key, n, angle, x1, y1, x2, y2.

    A first pass takes centroid and covariances, a second the extent along the direction. Without covariance the line runs along the
    axis of larger variance, upwards where both are equal (a single point: no length). Angles lie in (-90, 90] degrees, so the line
    doesn't depend on the order of the points. Points with a null coordinate and rows with a null key are left out.
    """
    p = points.select(key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna()
    cxy, cxx, cyy = F.covar_pop("__x", "__y"), F.var_pop("__x"), F.var_pop("__y")
    m = p.groupBy(key).agg(F.count("*").alias("n"), F.avg("__x").alias("__cx"), F.avg("__y").alias("__cy"), cxy.alias("__cxy"), cxx.alias("__cxx"), cyy.alias("__cyy"))
    upright = F.when(F.col("__cxx") > F.col("__cyy"), 0.0).otherwise(F.pi() / 2)
    angle = F.when(F.abs("__cxy") < 1e-6, upright).otherwise(0.5 * F.atan2(2 * F.col("__cxy"), F.col("__cxx") - F.col("__cyy")))
    m = m.withColumn("angle", angle).drop("__cxy", "__cxx", "__cyy").withColumns({"__dx": F.cos("angle"), "__dy": F.sin("angle")})
    along = F.col("__dx") * (F.col("__x") - F.col("__cx")) + F.col("__dy") * (F.col("__y") - F.col("__cy"))
    line = ["n", "angle", "__cx", "__cy", "__dx", "__dy"]
    j = p.join(m, key).groupBy(key).agg(*[F.first(c).alias(c) for c in line], F.min(along).alias("__lo"), F.max(along).alias("__hi"))
    ends = [(F.col(f"__c{c}") + F.col(f"__d{c}") * F.col(e)).alias(f"{c}{i}") for i, e in ((1, "__lo"), (2, "__hi")) for c in "xy"]
    return j.select(key, "n", "angle", *ends)


def fit_similarity(pairs: DataFrame, key: str = "plan_id", x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2", min_matches: int = 3) -> DataFrame:
    """The similarity that takes points (x1, y1) of each key to (x2, y2): key, n, scale, rotation, cos, sin, tx, ty as B28 takes them.

    The scale is the ratio of the mean radii about the centroids; the rotation is the one of least squares, from the summed dot and
    cross products of all pairs, which are covariances. Keys with fewer than ``min_matches`` pairs have no row; where the first
    points are all one the scale is 1, and where no direction stands out the rotation is 0. Pairs with a null are left out.
    """
    names = {"__ax": x1, "__ay": y1, "__bx": x2, "__by": y2}
    p = pairs.select(key, *[F.col(c).cast("double").alias(n) for n, c in names.items()]).dropna()
    dot = F.covar_pop("__ax", "__bx") + F.covar_pop("__ay", "__by")
    cross = F.covar_pop("__ax", "__by") - F.covar_pop("__ay", "__bx")
    m = p.groupBy(key).agg(F.count("*").alias("n"), dot.alias("__dot"), cross.alias("__cross"), *[F.avg(c).alias(f"{c}0") for c in names]).where(F.col("n") >= min_matches)
    radius = lambda s: F.avg(G.hypot(F.col(f"__{s}x") - F.col(f"__{s}x0"), F.col(f"__{s}y") - F.col(f"__{s}y0")))
    keep = ["n", "__dot", "__cross", *[f"{c}0" for c in names]]
    j = p.join(m, key).groupBy(key).agg(*[F.first(c).alias(c) for c in keep], radius("a").alias("__ra"), radius("b").alias("__rb"))
    length = G.hypot(F.col("__dot"), F.col("__cross"))
    turn = lambda v, still: F.when(length > 1e-6, F.col(v) / length).otherwise(still)
    j = j.withColumns({"scale": F.when(F.col("__ra") > 1e-6, F.col("__rb") / F.col("__ra")).otherwise(1.0), "cos": turn("__dot", 1.0), "sin": turn("__cross", 0.0)})
    tx = F.col("__bx0") - F.col("scale") * (F.col("cos") * F.col("__ax0") - F.col("sin") * F.col("__ay0"))
    ty = F.col("__by0") - F.col("scale") * (F.col("sin") * F.col("__ax0") + F.col("cos") * F.col("__ay0"))
    return j.select(key, "n", "scale", F.atan2("sin", "cos").alias("rotation"), "cos", "sin", tx.alias("tx"), ty.alias("ty"))

"""User steps: column functions chained on a table, a vectorised wrapper and SQL names."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlake.functions import geom as G

Step = Callable[[Column], Column]


def apply_steps(df: DataFrame, steps: dict[str, Step], points: str = "points", valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each step rewrites the points; the first invalid result stops a row's chain and its last good points stay.

    Adds ``failed_step``: the name of the step that failed, or null.
    """
    ok = valid or (lambda p: F.coalesce((F.size(p) >= 3) & F.forall(p, lambda q: q["x"].isNotNull() & q["y"].isNotNull()), F.lit(False)))
    df = df.withColumn("failed_step", F.lit(None).cast("string"))
    for name, step in steps.items():
        df = df.withColumn("__new", F.when(F.col("failed_step").isNull(), step(F.col(points))))
        df = df.withColumn("__ok", F.col("failed_step").isNull() & ok(F.col("__new")))
        df = df.withColumn("failed_step", F.when(F.col("failed_step").isNull() & ~F.col("__ok"), name).otherwise(F.col("failed_step")))
        df = df.withColumn(points, F.when(F.col("__ok"), F.col("__new")).otherwise(F.col(points)))
    return df.drop("__new", "__ok")


def numpy_step(f: Callable[[np.ndarray], np.ndarray]) -> Step:
    """A user's numpy function of an (n, 2) array as a step; batches cross in Arrow. A result of another length fails."""

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def run(points: pd.Series) -> pd.Series:
        def one(rows: object) -> list | None:
            if rows is None:
                return None
            a = np.array([(r["x"], r["y"]) for r in rows], dtype=float).reshape(-1, 2)
            b = np.asarray(f(a), dtype=float)
            return [{"x": x, "y": y} for x, y in b] if b.shape == a.shape else None

        return points.map(one)

    return run


def register_sql(spark: SparkSession) -> None:
    """polygon_area, polygon_bounds and line_angle as SQL functions over columns, for SQL users.

    They are SQL expressions, so Catalyst inlines them.
    """
    ring = "array<struct<x: double, y: double>>"
    area = "abs(aggregate(transform(sequence(0, size(p) - 1), i -> p[i].x * p[(i + 1) % size(p)].y - p[(i + 1) % size(p)].x * p[i].y), 0D, (a, v) -> a + v)) / 2"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION polygon_area(p {ring}) RETURNS double RETURN {area}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION polygon_width(p {ring}) RETURNS double RETURN array_max(p.x) - array_min(p.x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION line_angle(x1 double, y1 double, x2 double, y2 double) RETURNS double RETURN pmod(degrees(atan2(y2 - y1, x2 - x1)), 180D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION snap_to(v double, g double) RETURNS double RETURN rint(v / g) * g")


STANDARD_STEPS: dict[str, Step] = {
    "collinear": lambda p: G.drop_collinear(p, 2.0),
    "grid": lambda p: G.snap_to_grid(p, F.lit(10.0)),
    "right_angles": G.right_angle,
}

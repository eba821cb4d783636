"""Floor-plan tables derived from the star-schema test tables with integer arithmetic, as Spark SQL and as DuckDB SQL.

The text below is valid in both engines, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlake.functions.geom import point

LABELS = ("external-wall", "external_wall", "Internal Wall", "internal-walls", "Door", "window", "stair")

_BASE = """
SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS plan_id,
       concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20))) AS det_id,
       CASE l_linenumber {labels} ELSE 'other' END AS label,
       CAST((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 1000 AS DOUBLE) / 1000 AS confidence,
       CAST((l_partkey * 37) % 3000 AS DOUBLE) AS x0,
       CAST((l_suppkey * 53 + l_orderkey * 7) % 3000 AS DOUBLE) AS y0,
       CAST(300 + 60 * CAST(l_quantity AS INT) AS DOUBLE) AS len,
       CAST(80 + 60 * (l_suppkey % 5) AS DOUBLE) AS thk,
       CAST(l_partkey % 7 - 3 AS DOUBLE) AS jit,
       l_partkey % 2 = 0 AS horizontal,
       l_linenumber AS line_no
FROM lineitem"""

_CORNERS = """
SELECT *, x0 AS x1, y0 AS y1,
       CASE WHEN horizontal THEN x0 + len ELSE x0 + thk END AS x2, y0 AS y2,
       CASE WHEN horizontal THEN x0 + len ELSE x0 + thk + jit END AS x3,
       CASE WHEN horizontal THEN y0 + thk + jit ELSE y0 + len END AS y3,
       x0 AS x4, CASE WHEN horizontal THEN y0 + thk ELSE y0 + len END AS y4,
       CASE WHEN horizontal THEN x0 ELSE x0 + thk / 2 END AS ax1, CASE WHEN horizontal THEN y0 + thk / 2 ELSE y0 END AS ay1,
       CASE WHEN horizontal THEN x0 + len ELSE x0 + thk / 2 END AS ax2, CASE WHEN horizontal THEN y0 + thk / 2 ELSE y0 + len END AS ay2,
       CASE WHEN horizontal THEN x0 + len ELSE x0 + thk END AS bx, CASE WHEN horizontal THEN y0 + thk ELSE y0 + len END AS by_,
       CASE WHEN line_no <= 4 THEN 'WALL' WHEN line_no = 5 THEN 'DOOR' WHEN line_no = 6 THEN 'WINDOW' WHEN line_no = 7 THEN 'STAIR' ELSE 'other' END AS kind
FROM base"""

_CASES = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(LABELS, 1))

#: CTEs for both engines: det has one detection per lineitem row.
DET = f"WITH base AS ({_BASE.format(labels=_CASES)}), det AS ({_CORNERS})"
#: For DuckDB: walls and openings by plan.
CTE = DET + ", wall AS (SELECT * FROM det WHERE kind = 'WALL'), opening AS (SELECT * FROM det WHERE kind IN ('DOOR', 'WINDOW'))"

#: For both engines: walls and openings with axes in several directions (unit vectors ux, uy with whole-number triangles).
TILT = DET + """, dir AS (SELECT *,
       CASE WHEN jit = 3 THEN 0.6e0 WHEN jit = -3 THEN 0.8e0 WHEN jit = 2 THEN 0.28e0 WHEN horizontal THEN 1e0 ELSE 0e0 END AS ux,
       CASE WHEN jit = 3 THEN 0.8e0 WHEN jit = -3 THEN 0.6e0 WHEN jit = 2 THEN 0.96e0 WHEN horizontal THEN 0e0 ELSE 1e0 END AS uy FROM det),
tilt AS (SELECT plan_id, det_id, kind, label, confidence, line_no, jit, thk AS thickness, len AS length, ux, uy,
       x0 AS x1, y0 AS y1, x0 + len * ux AS x2, y0 + len * uy AS y2 FROM dir),
tw AS (SELECT * FROM tilt WHERE kind = 'WALL'),
op AS (SELECT plan_id, det_id, kind, confidence, horizontal, len, thk, x0, y0, bx, by_, (x0 + bx) / 2 AS cx, (y0 + by_) / 2 AS cy FROM det WHERE kind IN ('DOOR', 'WINDOW'))"""


def _from(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(TILT.replace("FROM lineitem", "FROM {lineitem}") + f" SELECT * FROM {name}", lineitem=lineitem)


def tilted_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walls by axis (x1, y1, x2, y2), thickness, length and confidence."""
    return _from(spark, sf_dir, "tw")


def rect_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings with their box as a ring."""
    df = _from(spark, sf_dir, "op")
    return df.withColumn("points", F.array(*[point(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("bx", "y0"), ("bx", "by_"), ("x0", "by_"))]))


def axis_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis-parallel walls of ``det`` with the library's column names, their detected polygon and label."""
    names = {"ax1": "x1", "ay1": "y1", "ax2": "x2", "ay2": "y2", "thk": "thickness", "len": "length"}
    return walls(spark, sf_dir).drop("x1", "y1", "x2", "y2").withColumnsRenamed(names)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per detection: plan_id, det_id, label, confidence, corner and axis columns, and points."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    df = spark.sql(DET.replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM det", lineitem=lineitem)
    corners = [point(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(1, 5)]
    return df.withColumn("points", F.array(*corners))


def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where("kind = 'WALL'")


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where("kind IN ('DOOR', 'WINDOW')")

"""Sinks: GeoJSON, reports, mirrored artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature(points: Column, geometry: str, properties: Column) -> Column:
    """One GeoJSON feature as a JSON string; geometry is Polygon or LineString."""
    xy = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    shape = F.array(F.concat(xy, F.slice(xy, 1, 1))) if geometry == "Polygon" else xy
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), shape.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def feature_lines(df: DataFrame, geometry: str = "Polygon", properties: tuple[str, ...] = ("det_id", "label")) -> DataFrame:
    """(plan_id, feature) rows: one feature a row, so a plan of any size is spread over tasks."""
    return df.select("plan_id", feature(F.col("points"), geometry, F.struct(*properties)).alias("feature"))


def feature_collections(df: DataFrame, geometry: str = "Polygon", properties: tuple[str, ...] = ("det_id", "label")) -> DataFrame:
    """(plan_id, geojson) with one FeatureCollection per plan; for plans that fit one document."""
    rows = feature_lines(df, geometry, properties).groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("f"))
    return rows.select("plan_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("geojson"))


def write_geojson(df: DataFrame, path: str, layer: str, geometry: str = "Polygon", properties: tuple[str, ...] = ("det_id", "label")) -> None:
    """One text file per plan below path/layer, partitioned by plan."""
    feature_collections(df, geometry, properties).write.mode("overwrite").partitionBy("plan_id").text(f"{path}/{layer}")


def write_report(df: DataFrame, path: str) -> None:
    """One JSON line per row, partitioned by plan if there is one."""
    w = df.write.mode("overwrite")
    (w.partitionBy("plan_id") if "plan_id" in df.columns else w).json(path)


def mirror(df: DataFrame, prefix: str) -> None:
    """Artifacts (job_id, ...) to any store Spark can write, below prefix/artifacts, partitioned by job."""
    df.write.mode("overwrite").partitionBy("job_id").parquet(f"{prefix.rstrip('/')}/artifacts")

"""Queries of the readers and writers (A rows): documents made from the test tables are written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.plans.demo import CTE, detections, walls
from planlake.plans.registry import query, r6, s6
from planlake.plans.scalar_queries import AREA
from planlake.session import new_folder
from planlake.sources import readers, writers


def written(docs: DataFrame, name: str) -> str:
    """The folder of documents, one per line."""
    path = new_folder(docs.sparkSession, name)
    docs.write.text(path)
    return path


def model_documents(rows: DataFrame) -> DataFrame:
    """One model document per plan out of rows with the fields of predictions."""
    image = F.struct(F.lit(4000).alias("width"), F.lit(3000).alias("height"))
    names = [c for c in rows.columns if c != "plan_id"]
    d = rows.groupBy("plan_id").agg(F.collect_list(F.struct(*names)).alias("predictions"))
    return d.select(F.to_json(F.struct(image.alias("image"), F.col("plan_id").cast("string").alias("inference_id"), "predictions")).alias("value"))


def plan() -> Column:
    return F.col("inference_id").cast("long").alias("plan_id")


@query("a01_topology_model", f"{CTE} SELECT plan_id, count(*) FILTER (WHERE line_no IN (1, 4)) AS walls, count(*) FILTER (WHERE line_no NOT IN (1, 2, 4)) AS openings, {s6('sum(greatest(x2, x3)) FILTER (WHERE line_no NOT IN (1, 2, 4))')} AS right FROM det GROUP BY plan_id HAVING count(*) FILTER (WHERE line_no NOT IN (1, 2, 4)) > 0")
def a01(spark, sf):
    """Walls with two points or more; everything else by its box. Walls of line 2 have a single point."""
    n = F.col("line_no")
    name = F.when(n.isin(1, 2), "external-walls").when(n == 4, "internal-walls").otherwise(F.col("label"))
    d = detections(spark, sf).select("plan_id", name.alias("class"), "confidence", F.when(n == 2, F.slice("points", 1, 1)).otherwise(F.col("points")).alias("points"))
    w, o = readers.read_topology_model(spark, written(model_documents(d), "topology"), lines=True)
    w = w.groupBy(plan()).agg(F.count("*").alias("walls"))
    o = o.groupBy(plan()).agg(F.count("*").alias("openings"), r6(F.sum("box.x1")).alias("right"))
    return o.join(w, "plan_id", "left").na.fill(0, ["walls"])


@query("a02_room_model", f"{CTE} SELECT plan_id, count(*) AS rooms, {s6(f'sum({AREA})')} AS area FROM det WHERE line_no IN (3, 7) GROUP BY plan_id")
def a02(spark, sf):
    """Rooms with three points or more; those of line 6 have two."""
    n = F.col("line_no")
    d = detections(spark, sf).select("plan_id", F.when(n.isin(3, 6, 7), "room").otherwise("hall").alias("class"), F.when(n == 6, F.slice("points", 1, 2)).otherwise(F.col("points")).alias("points"))
    r = readers.read_room_model(spark, written(model_documents(d), "rooms"), lines=True)
    return r.groupBy(plan()).agg(F.count("*").alias("rooms"), r6(F.sum("area")).alias("area"))


@query("a03_box_model", f"{CTE} SELECT plan_id, count(*) AS walls, {s6('sum(thk)')} AS thickness, {s6('sum(CASE WHEN horizontal THEN x0 ELSE x0 + thk / 2 END)')} AS left FROM wall WHERE line_no <> 2 GROUP BY plan_id".replace("AS left", "AS starts"))
def a03(spark, sf):
    """Centrelines of boxes along their longer side; boxes of line 2 have no width."""
    d = detections(spark, sf)
    w, h = F.col("bx") - F.col("x0"), F.col("by_") - F.col("y0")
    rows = d.select("plan_id", F.when(F.col("kind") == "WALL", "wall").otherwise(F.col("label")).alias("class"), ((F.col("x0") + F.col("bx")) / 2).alias("x"), ((F.col("y0") + F.col("by_")) / 2).alias("y"), F.when(F.col("line_no") == 2, 0.0).otherwise(w).alias("width"), h.alias("height"))
    lines, _ = readers.read_box_model(spark, written(model_documents(rows), "boxes"), lines=True)
    return lines.groupBy(plan()).agg(F.count("*").alias("walls"), r6(F.sum("thickness")).alias("thickness"), r6(F.sum("line.x1")).alias("starts"))


@query("a06_latest_jobs", "SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, (ts, event_id)) AS status, CAST(count(*) AS INTEGER) AS progress FROM events GROUP BY user_id")
def a06(spark, sf):
    """Job files of the first states, then those of the last states; the files changed last count."""
    path = new_folder(spark, "jobs")
    e, at = spark.read.parquet(f"{sf}/events.parquet"), F.struct("ts", "event_id")
    jobs = e.groupBy(F.col("user_id").cast("string").alias("id"))
    jobs.agg(F.min_by("event_type", at).alias("status"), F.lit(0).alias("progress")).write.json(path)
    jobs.agg(F.max_by("event_type", at).alias("status"), F.count("*").cast("int").alias("progress")).write.mode("append").json(path)
    return readers.read_jobs(spark, path).select("id", "status", "progress")


@query("a07_read_geojson", f"{CTE} SELECT plan_id, det_id, label AS type, {s6(AREA)} AS area FROM det WHERE kind <> 'other'")
def a07(spark, sf):
    """Collections written per plan and read back, one row per feature."""
    d = detections(spark, sf).where("kind <> 'other'").withColumnRenamed("label", "type")
    docs = writers.feature_collections(d.withColumn("plan", F.col("plan_id").cast("string")), properties=("det_id", "type", "plan"))
    f = readers.read_geojson(spark, written(docs.select("geojson"), "geojson"), lines=True)
    p = lambda k: F.element_at("properties", k)
    return f.select(p("plan").cast("long").alias("plan_id"), p("det_id").alias("det_id"), "type", r6(G.polygon_area(F.col("points"))).alias("area"))


@query("a09_write_report", f"{CTE} SELECT plan_id, det_id, confidence FROM wall")
def a09(spark, sf):
    """Report lines written by plan and read back."""
    path = new_folder(spark, "report")
    writers.write_report(walls(spark, sf).select(F.pmod("plan_id", F.lit(8)).alias("plan_id"), F.col("plan_id").alias("plan"), "det_id", "confidence"), path)
    return spark.read.schema("plan long, det_id string, confidence double").json(path).select(F.col("plan").alias("plan_id"), "det_id", "confidence")


@query("a10_spf_entities", "SELECT o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN 'IFCWALL' ELSE 'IFCDOOR' END AS type, o_custkey AS ref FROM orders")
def a10(spark, sf):
    """Statements over several lines, with semicolons, references and doubled quotes in strings; and the references between them."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "IfcWall").otherwise("IfcDoor")
    text = F.concat(F.lit("#"), F.col("o_orderkey").cast("string"), F.lit("= "), kind, F.lit("('x;''#7;',\n#"), F.col("o_custkey").cast("string"), F.lit(",$);"))
    e = readers.read_spf_entities(spark, written(o.select(text), "spf"))
    return e.join(readers.spf_references(e).select("id", "ref"), "id").select("id", "type", "ref")


@query("a11_mirror", "SELECT user_id AS job_id, event_id FROM events")
def a11(spark, sf):
    """Artifacts copied to another folder, here by a seventh of the jobs each."""
    path = new_folder(spark, "mirror")
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.pmod("user_id", F.lit(7)).alias("job_id"), F.col("user_id").alias("job"), "event_id")
    writers.mirror(e, path)
    return spark.read.parquet(f"{path}/artifacts").select(F.col("job").alias("job_id"), "event_id")

"""Sources: prediction JSON, GeoJSON, job files, model files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.session import materialize

POINT = "struct<x: double, y: double>"
PREDICTION = f"struct<class: string, label: string, class_id: int, detection_id: string, confidence: double, points: array<{POINT}>, x: double, y: double, width: double, height: double>"
MODEL = f"image struct<width: int, height: int>, inference_id string, time double, predictions array<{PREDICTION}>"
WALL_CLASSES = ("internal-walls", "external-walls")


def predictions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per prediction of each model document: file, inference_id, image size, sequence and the prediction's fields.

    A file is one document, or has one per line where ``lines`` says so; then large files are split between tasks.
    """
    j = spark.read.schema(MODEL).option("multiLine", not lines).json(path)
    rows = j.select(F.input_file_name().alias("file"), "inference_id", F.col("image.width").alias("image_width"), F.col("image.height").alias("image_height"), F.posexplode("predictions").alias("seq", "p"))
    return rows.select("file", "inference_id", "image_width", "image_height", "seq", "p.*")


def read_topology_model(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """A1: (walls with two points or more, openings as the box of their points)."""
    p = predictions(spark, path, lines)
    wall = F.col("class").isin(*WALL_CLASSES)
    b = G.bounds(F.col("points"))
    return p.where(wall & (F.size("points") >= 2)), p.where(~wall & (F.size("points") > 0)).select("file", "inference_id", "seq", "class", "confidence", b.alias("box"))


def read_room_model(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A2: rooms with three points or more."""
    return predictions(spark, path, lines).where((F.col("class") == "room") & (F.size("points") >= 3)).withColumn("area", G.polygon_area(F.col("points")))


def read_box_model(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """A3: (walls as centrelines of their boxes, opening boxes); boxes without width or height are dropped.

    x and y are the box's centre; the centreline runs along the longer side.
    """
    p = predictions(spark, path, lines).where((F.col("width") > 0) & (F.col("height") > 0))
    flat = F.col("width") >= F.col("height")
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    line = F.struct(F.when(flat, x - w / 2).otherwise(x).alias("x1"), F.when(flat, y).otherwise(y - h / 2).alias("y1"), F.when(flat, x + w / 2).otherwise(x).alias("x2"), F.when(flat, y).otherwise(y + h / 2).alias("y2"))
    walls = p.where(F.col("class") == "wall").select("file", "inference_id", "seq", "confidence", line.alias("line"), F.least(w, h).alias("thickness"))
    return walls, p.where(F.col("class") != "wall").select("file", "inference_id", "seq", "class", "confidence", x.alias("cx"), y.alias("cy"), "width", "height")


def coerce_points(points: Column) -> Column:
    """A4: an array of JSON strings, each {"x", "y"}, {"0", "1"} or a pair, as points; what is none of these is skipped."""

    def one(s: Column) -> Column:
        get = lambda *paths: F.coalesce(*[F.get_json_object(s, p).try_cast("double") for p in paths])
        return G.point(get("$.x", "$.0", "$[0]"), get("$.y", "$.1", "$[1]"))

    return F.filter(F.transform(points, one), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def to_detections(df: DataFrame) -> DataFrame:
    """A5: label from class, label or raw class; corner box from centre box; a bad confidence becomes 0."""
    raw = F.get_json_object("raw", "$.class") if "raw" in df.columns else F.lit(None)
    c = F.col("confidence").try_cast("double")
    out = df.withColumn("label", F.coalesce(F.nullif("class", F.lit("")), F.nullif("label", F.lit("")), raw))
    out = out.withColumn("confidence", F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c))
    return out.withColumn("x0", F.col("x") - F.col("width") / 2).withColumn("y0", F.col("y") - F.col("height") / 2)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per job; of several files of a job the one changed last counts."""
    j = spark.read.schema("id string, status string, progress int, input_files array<string>, meta string").json(path)
    j = j.select("*", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"))
    return j.groupBy("id").agg(F.max_by(F.struct("status", "progress", "input_files", "meta"), F.struct("at", "file")).alias("j")).select("id", "j.*")


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per feature (a file is one collection, or has one per line): type (WALL by default), geometry type, ring or line; of several parts the largest or longest."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.input_file_name().alias("file"), F.posexplode("features").alias("seq", "f"))
    c, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    pts = lambda a: F.transform(a, lambda p: G.point(p[0], p[1]))
    ring = pts(F.from_json(c, "array<array<array<double>>>")[0])
    line = pts(F.from_json(c, "array<array<double>>"))
    parts = F.transform(F.from_json(c, "array<array<array<array<double>>>>"), lambda poly: pts(poly[0]))
    largest = F.array_max(F.transform(parts, lambda p: F.struct(G.polygon_area(p).alias("size"), p.alias("p"))))["p"]
    lines = F.transform(F.from_json(c, "array<array<array<double>>>"), pts)
    length = lambda p: G.fsum(F.transform(F.slice(G.edges(p), 1, F.size(p) - 1), lambda e: G.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))
    longest = F.array_max(F.transform(lines, lambda p: F.struct(length(p).alias("size"), p.alias("p"))))["p"]
    points = F.when(kind == "Polygon", ring).when(kind == "LineString", line).when(kind == "MultiPolygon", largest).when(kind == "MultiLineString", longest)
    return f.select("file", "seq", F.col("f.properties").alias("properties"), F.coalesce(F.element_at("f.properties", "type"), F.lit("WALL")).alias("type"), kind.alias("geometry"), points.alias("points"))


#: A string of a model file; a doubled quote in it reads as two strings side by side.
SPF_STRING = "'[^']*+'"
#: One argument: text without commas, strings, and lists to two levels.
SPF_ARGUMENT = f"(?:[^,()']++|{SPF_STRING}|\\((?:[^()']++|{SPF_STRING}|\\((?:[^()']++|{SPF_STRING})*+\\))*+\\))++"


def spf_statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, s) of every statement of model files, cut at the semicolons outside strings.

    Files are read in splits as pieces between semicolons. A piece lies outside strings where the quotes before it are even in number:
    they are summed within its split and over the file's earlier splits. The pieces of a statement are put together within their split, which
    is shuffled once; only what a split's edges cut is put together over splits, by the number of such statements ended before.
    A comment may hold neither quotes nor semicolons.
    """
    t = spark.read.option("lineSep", ";").text(path)
    meta = F.col("_metadata")
    t = t.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("n"), "value")
    t = t.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit("'"), F.lit(""))))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per = t.groupBy("file", "split").agg(F.sum("quotes").alias("__v"))
    t = t.join(per.select("file", "split", F.coalesce(F.sum("__v").over(earlier), F.lit(0)).alias("before")), ["file", "split"])
    w = Window.partitionBy("file", "split").orderBy("n")
    t = t.withColumn("after", F.col("before") + F.sum("quotes").over(w)).withColumn("ended", (F.col("after") % 2 == 0).cast("long"))
    t = t.withColumn("k", F.sum("ended").over(w) - F.col("ended"))
    piece = F.struct("n", "value", (F.col("after") - F.col("quotes")).alias("quotes"))
    t = t.groupBy("file", "split", "k").agg(F.array_sort(F.collect_list(piece)).alias("v"), F.max("ended").alias("ended"))
    text = lambda: F.array_join(F.transform("v", lambda p: p["value"]), ";").alias("s")
    t = materialize(t.select("file", "split", "k", "ended", (F.col("v")[0]["quotes"] % 2 == 0).alias("begins"), text()), "spf-statements")
    cut = t.where("NOT begins OR ended = 0")
    # A split has two such parts at most.
    over = Window.partitionBy("file").orderBy("split", "k")
    cut = cut.withColumn("whole", F.sum("ended").over(over) - F.col("ended"))
    joined = cut.groupBy("file", "whole").agg(F.array_sort(F.collect_list(F.struct("split", "k", F.col("s").alias("value")))).alias("v"))
    return t.where("begins AND ended = 1").select("file", "s").unionByName(joined.select("file", text()))


def read_spf_entities(spark: SparkSession, path: str) -> DataFrame:
    """A10: (file, id, type, args) of every #id=TYPE(args); statement, comments taken out, line ends as blanks."""
    s = F.regexp_replace(F.regexp_replace("s", f"({SPF_STRING})|/\\*(?s:.*?)\\*/", "$1"), "[\\r\\n]+", " ")
    t = spf_statements(spark, path).select("file", F.trim(s).alias("s"))
    rx = "^#([0-9]+)\\s*=\\s*([A-Za-z0-9_]+)\\s*\\((.*)\\)$"
    return t.where(F.col("s").rlike(rx)).select("file", F.regexp_extract("s", rx, 1).cast("long").alias("id"), F.upper(F.regexp_extract("s", rx, 2)).alias("type"), F.regexp_extract("s", rx, 3).alias("args"))


def references(args: Column) -> Column:
    """The ids referred to in arguments, outside strings, in their order."""
    found = F.regexp_extract_all(F.regexp_replace(args, SPF_STRING, ""), F.lit("#([0-9]+)"), 1)
    return F.transform(found, lambda r: r.cast("long"))


def spf_references(entities: DataFrame) -> DataFrame:
    """A10: (file, id, ref) edges between statements."""
    return entities.select("file", "id", F.explode(references(F.col("args"))).alias("ref"))


def spf_arguments(args: Column) -> Column:
    """A10: the arguments of a statement one by one, lists as their text."""
    return F.transform(F.regexp_extract_all(args, F.lit(SPF_ARGUMENT), 0), lambda a: F.trim(a))

"""Elements and relations of read model files, and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake.session import bounded_broadcast
from planlake.sources.readers import references, spf_arguments

# Relation type -> name, place of the relating and of the related arguments (from 1).
RELATIONS = (
    ("IFCRELVOIDSELEMENT", "voids", 5, 6),
    ("IFCRELFILLSELEMENT", "fills", 5, 6),
    ("IFCRELASSOCIATESMATERIAL", "material", 6, 5),
    ("IFCRELCONTAINEDINSPATIALSTRUCTURE", "storey", 6, 5),
    ("IFCRELSPACEBOUNDARY", "boundary", 5, 6),
    ("IFCRELCONNECTSPATHELEMENTS", "connects", 6, 7),
)
WALLS = ("IFCWALL", "IFCWALLSTANDARDCASE")
# Check -> element types, relation each must have, its side there.
CHECKS = (
    ("opening_without_void", ("IFCOPENINGELEMENT",), "voids", "related"),
    ("opening_without_fill", ("IFCOPENINGELEMENT",), "fills", "relating"),
    ("element_without_material", (*WALLS, "IFCSLAB"), "material", "related"),
    ("element_without_storey", (*WALLS, "IFCDOOR", "IFCWINDOW", "IFCSLAB"), "storey", "related"),
    ("space_without_boundary", ("IFCSPACE",), "boundary", "relating"),
    ("filling_without_host", ("IFCDOOR", "IFCWINDOW"), "fills", "related"),
)
#: The check of relations themselves: a connection whose side is no wall, a boundary whose element isn't in the model.
DANGLING = "relation_to_missing_element"


def _text(argument: Column) -> Column:
    """A string argument without its quotes; null for anything else."""
    return F.when(argument.startswith("'"), F.replace(F.substr(argument, F.lit(2), F.length(argument) - 2), F.lit("''"), F.lit("'")))


def model_elements(entities: DataFrame) -> DataFrame:
    """(file, id, type, guid, name, predefined) of the statements (A10) that begin with a global id and are no relations.

    ``predefined`` is the last argument where that is an enumeration (.FLOOR.).
    """
    e = entities.where(~F.col("type").startswith("IFCREL") & F.col("args").startswith("'")).withColumn("a", spf_arguments(F.col("args")))
    return e.select("file", "id", "type", _text(F.get("a", 0)).alias("guid"), _text(F.get("a", 2)).alias("name"), F.nullif(F.regexp_extract(F.get("a", F.size("a") - 1), "^[.](\\w+)[.]$", 1), F.lit("")).alias("predefined"))


def model_relations(entities: DataFrame) -> DataFrame:
    """(file, rel_id, rel, relating, related) of the known relations (A10), one row per related element; related is null where none is named."""
    rules = entities.sparkSession.createDataFrame(list(RELATIONS), "type string, rel string, relating_at int, related_at int")
    r = entities.join(F.broadcast(rules), "type").withColumn("a", spf_arguments(F.col("args")))
    ids = lambda at: references(F.get("a", F.col(at) - 1))
    r = r.select("file", F.col("id").alias("rel_id"), "rel", F.get(ids("relating_at"), 0).alias("relating"), ids("related_at").alias("to"))
    return r.select("file", "rel_id", "rel", "relating", F.explode_outer("to").alias("related"))


def missing_relations(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """(file, issue, id) of every element without a relation it needs, and of every relation to an element that isn't there.

    One anti-join answers the first six checks. Elements are in a storey only if what contains them is one.
    """
    spark = elements.sparkSession
    storeys = elements.where("type = 'IFCBUILDINGSTOREY'").select("file", F.col("id").alias("relating")).distinct()
    stored = relations.where("rel = 'storey'").join(bounded_broadcast(storeys, 100_000), ["file", "relating"], "left_semi")
    valid = relations.where("rel <> 'storey'").unionByName(stored.select(relations.columns))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("id")) for s in ("relating", "related")])).alias("s")
    has = valid.select("file", "rel", sides).select("file", "rel", "s.*").distinct()
    rules = spark.createDataFrame([(c, t, r, s) for c, types, r, s in CHECKS for t in types], "issue string, type string, rel string, side string")
    need = elements.select("file", "id", "type").join(F.broadcast(rules), "type")
    lacking = need.join(has, ["file", "id", "rel", "side"], "left_anti").select("file", "issue", "id")
    ends = relations.where("rel = 'connects'").select("file", "rel_id", sides).select("file", "rel_id", "s.id", F.lit(True).alias("wall"))
    bounds = relations.where("rel = 'boundary' AND related IS NOT NULL").select("file", "rel_id", F.col("related").alias("id"), F.lit(False).alias("wall"))
    known = elements.select("file", "id", F.explode(F.when(F.col("type").isin(*WALLS), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("wall"))
    loose = ends.unionByName(bounds).join(known, ["file", "id", "wall"], "left_anti").select("file", F.lit(DANGLING).alias("issue"), F.col("rel_id").alias("id"))
    return lacking.unionByName(loose.distinct())


def referential_checks(elements: DataFrame, relations: DataFrame, first: int = 5) -> DataFrame:
    """(file, issue, n, first_ids): for each model and each of the seven checks the number of cases and the smallest ids."""
    missing = missing_relations(elements, relations)
    # Ranked in slices first, so that no model's cases meet in one task.
    slices = Window.partitionBy("file", "issue", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    top = missing.withColumn("__k", F.row_number().over(slices)).where(F.col("__k") <= first)
    top = top.withColumn("__k", F.row_number().over(Window.partitionBy("file", "issue").orderBy("id"))).where(F.col("__k") <= first)
    top = top.groupBy("file", "issue").agg(F.array_sort(F.collect_list("id")).alias("first_ids"))
    n = missing.groupBy("file", "issue").agg(F.count("*").alias("n"))
    files = elements.select("file").union(relations.select("file")).distinct()
    files = files.withColumn("issue", F.explode(F.array(*[F.lit(c) for c, *_ in CHECKS], F.lit(DANGLING))))
    out = files.join(n, ["file", "issue"], "left").join(top, ["file", "issue"], "left")
    return out.select("file", "issue", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first_ids", F.array().cast("array<bigint>")).alias("first_ids"))


def boundary_completeness(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """(file, id, n_boundaries, floor, ceiling, wall) of every space: a slab of kind FLOOR, a covering of kind CEILING, a wall among its boundaries."""
    spaces = elements.where("type = 'IFCSPACE'").select("file", "id")
    b = relations.where("rel = 'boundary'").select("file", F.col("relating").alias("id"), "rel_id", "related")
    what = elements.select("file", F.col("id").alias("related"), "type", "predefined")
    b = b.join(what, ["file", "related"], "left")
    is_ = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    kind = F.col("predefined")
    per = b.groupBy("file", "id").agg(
        F.count("rel_id").alias("n_boundaries"),
        is_((F.col("type") == "IFCSLAB") & (kind == "FLOOR")).alias("floor"),
        is_((F.col("type") == "IFCCOVERING") & (kind == "CEILING")).alias("ceiling"),
        is_(F.col("type").isin(*WALLS)).alias("wall"),
    )
    return spaces.join(per, ["file", "id"], "left").na.fill(0, ["n_boundaries"]).na.fill(False, ["floor", "ceiling", "wall"])

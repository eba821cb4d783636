"""Queries over models read from their files (A10): model text made from orders and line items is written, read and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.operators import model as M
from planlake.plans.registry import query
from planlake.session import materialize, new_folder
from planlake.sources import readers

TYPES = ("IfcWallStandardCase", "IfcOpeningElement", "IfcSlab", "IfcSpace", "IfcDoor", "IfcWindow", "IfcCovering")
SIZE = 2000
MATERIAL, STOREY, BUILDING, RELATION = 900_000_001, 900_000_002, 900_000_003, 1_000_000_000

#: In DuckDB: elements t (type by place), relations of line items, and their sides.
MODEL = f"""WITH e AS (SELECT o_orderkey // {SIZE} AS model, o_orderkey AS id, o_orderkey % 7 AS t FROM orders),
 l AS (SELECT l_orderkey // {SIZE} AS model, l_orderkey AS id, l_orderkey + l_partkey % 13 AS other, l_linenumber AS n, l_partkey % 5 = 0 AS building, l_suppkey % 11 = 0 AS bare, {RELATION} + l_orderkey * 8 + l_linenumber AS rid FROM lineitem),
 sides AS (SELECT model, n, building, id AS x FROM l UNION ALL SELECT model, n, building, other FROM l)"""


def model_entities(spark, sf) -> DataFrame:
    """One file for every 2,000 order keys: orders are elements, line items relations between them. Names hold semicolons and quotes."""
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    ref = lambda c: F.concat(F.lit("#"), s(c))
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("model", F.floor(F.col("o_orderkey") / SIZE))
    k = F.pmod("o_orderkey", F.lit(7)).cast("int")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), k + 1)
    last = F.when(k == 2, ".FLOOR.").when(k == 6, ".CEILING.").otherwise("$")
    element = F.concat(ref("o_orderkey"), F.lit("="), kind, F.lit("('g"), s("o_orderkey"), F.lit("',$,'it''s;\n#1',$,$,(("), F.lit("1.,2.),(3.,4.)),$,"), last, F.lit(");"))
    fixed = F.array(F.lit(f"#{MATERIAL}=IfcMaterial('Brick');"), F.lit(f"#{STOREY}=IfcBuildingStorey('s',$,'Ground');"), F.lit(f"#{BUILDING}=IfcBuilding('b',$,'House');"))
    i = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("model", F.floor(F.col("l_orderkey") / SIZE))
    n = F.col("l_linenumber")
    own, other = ref("l_orderkey"), ref(F.col("l_orderkey") + F.pmod("l_partkey", F.lit(13)))
    pair = F.concat(F.lit("("), own, F.lit(","), other, F.lit(")"))
    rel = lambda name, *args: F.concat(F.lit(f"{name}('r',$,$,'d;',"), F.concat_ws(",", *args), F.lit(");"))
    where = F.when(F.col("l_partkey") % 5 == 0, f"#{BUILDING}").otherwise(f"#{STOREY}")
    text = (
        F.when(n == 1, rel("IfcRelVoidsElement", other, own))
        .when(n == 2, rel("IfcRelFillsElement", own, other))
        .when(n == 3, rel("IfcRelAssociatesMaterial", pair, F.lit(f"#{MATERIAL}")))
        .when(n == 4, rel("IfcRelContainedInSpatialStructure", pair, where))
        .when(n.isin(5, 6), rel("IfcRelSpaceBoundary", own, F.when(F.col("l_suppkey") % 11 == 0, "$").otherwise(other), F.lit("$"), F.lit(".PHYSICAL."), F.lit(".INTERNAL.")))
        .otherwise(rel("IfcRelConnectsPathElements", F.lit("$"), own, other))
    )
    relation = F.concat(ref(F.col("l_orderkey").cast("long") * 8 + n + RELATION), F.lit("= "), text)
    rows = o.select("model", element.alias("value")).union(o.select("model").distinct().select("model", F.explode(fixed))).union(i.select("model", relation))
    path = new_folder(spark, "models")
    rows.repartition("model").write.partitionBy("model").text(path)
    return materialize(readers.read_spf_entities(spark, path), "model-entities")


def number(df: DataFrame) -> DataFrame:
    """The model's number out of its folder."""
    return df.withColumn("model", F.regexp_extract("file", "model=([0-9]+)", 1).cast("long")).drop("file")


def lacking(types: str, has: str) -> str:
    return f"SELECT e.model, id FROM e WHERE t IN ({types}) AND NOT EXISTS (SELECT 1 FROM {has})"


CASES = {
    "opening_without_void": lacking("1", "l WHERE l.model = e.model AND n = 1 AND l.id = e.id"),
    "opening_without_fill": lacking("1", "l WHERE l.model = e.model AND n = 2 AND l.id = e.id"),
    "element_without_material": lacking("0, 2", "sides b WHERE b.model = e.model AND n = 3 AND x = e.id"),
    "element_without_storey": lacking("0, 2, 4, 5", "sides b WHERE b.model = e.model AND n = 4 AND NOT building AND x = e.id"),
    "space_without_boundary": lacking("3", "l WHERE l.model = e.model AND n IN (5, 6) AND l.id = e.id"),
    "filling_without_host": lacking("4, 5", "l WHERE l.model = e.model AND n = 2 AND l.other = e.id"),
    M.DANGLING: "SELECT DISTINCT l.model, rid AS id FROM l LEFT JOIN e a ON a.model = l.model AND a.id = l.id LEFT JOIN e b ON b.model = l.model AND b.id = l.other WHERE (n = 7 AND (coalesce(a.t, 9) <> 0 OR coalesce(b.t, 9) <> 0)) OR (n IN (5, 6) AND NOT bare AND b.id IS NULL)",
}


@query("c26_model_checks", f"{MODEL}, m AS (" + " UNION ALL ".join(f"SELECT model, '{c}' AS issue, id FROM ({q})" for c, q in CASES.items()) + f"), r AS (SELECT *, row_number() OVER (PARTITION BY model, issue ORDER BY id) AS k FROM m), f AS (SELECT DISTINCT model, unnest([{', '.join(repr(c) for c in CASES)}]) AS issue FROM e) SELECT f.model, f.issue, count(id) AS n, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE k <= 5), '') AS first_five FROM f LEFT JOIN r ON f.model = r.model AND f.issue = r.issue GROUP BY f.model, f.issue")
def c26m(spark, sf):
    """Seven checks on relations taken from the files' statements by argument place."""
    e = model_entities(spark, sf)
    checks = M.referential_checks(M.model_elements(e), M.model_relations(e))
    return number(checks).select("model", "issue", "n", F.array_join(F.col("first_ids").cast("array<string>"), ",").alias("first_five"))


@query("d36_model_boundaries", f"{MODEL} SELECT s.model, s.id, count(l.id) AS n_boundaries, coalesce(bool_or(b.t = 2), false) AS floor, coalesce(bool_or(b.t = 6), false) AS ceiling, coalesce(bool_or(b.t = 0), false) AS wall FROM e s LEFT JOIN l ON l.model = s.model AND l.id = s.id AND n IN (5, 6) LEFT JOIN e b ON b.model = l.model AND b.id = l.other AND NOT bare WHERE s.t = 3 GROUP BY s.model, s.id")
def d36m(spark, sf):
    """Floor, ceiling and wall among each space's boundaries, out of the files."""
    e = model_entities(spark, sf)
    return number(M.boundary_completeness(M.model_elements(e), M.model_relations(e))).select("model", "id", "n_boundaries", "floor", "ceiling", "wall")

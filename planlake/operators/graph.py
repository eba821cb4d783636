"""Connected components by min-hooking and contraction (K2), on any edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.session import materialize

MAX_ROUNDS = 60


def components(edges: DataFrame, src: str = "src", dst: str = "dst", keys: tuple[str, ...] = ()) -> DataFrame:
    """Label every node of ``edges`` with the smallest node of its component.

    Each round hooks a node on its smallest neighbour, jumps pointers until they end at roots and
    contracts the edge table; edges between merged nodes vanish, so the table shrinks
    and a component of any size takes a logarithmic number of rounds. ``keys`` are extra
    columns (for example plan_id) that separate independent graphs. Null ends are ignored.
    Returns ``keys + (node, component)``. Raises after MAX_ROUNDS rather than return a partial result.

    Nodes that aren't single numbers are numbered first, so the rounds shuffle two numbers a row instead of keys and names.
    """
    k = list(keys)
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*k, F.col(src).alias("u"), F.col(dst).alias("v"))
    if not k and dict(e.dtypes)["u"] in ("int", "bigint"):
        return _numbered(e)
    e = materialize(e, "cc-named")
    nodes = e.select(*k, F.explode(F.array("u", "v")).alias("node")).distinct()
    nodes = materialize(nodes.withColumn("number", F.monotonically_increasing_id()), "cc-nodes")
    for end in ("u", "v"):
        e = e.join(nodes.withColumnsRenamed({"node": end, "number": f"__{end}"}), [*k, end]).drop(end)
    found = _numbered(e.select(F.col("__u").alias("u"), F.col("__v").alias("v")))
    named = nodes.join(found.select(F.col("node").alias("number"), "component"), "number", "left").withColumn("component", F.coalesce("component", "number"))
    named = materialize(named.drop("number"), "cc-components")
    least = named.groupBy("component").agg(F.min("node").alias("least"))
    return named.join(least, "component").select(*k, "node", F.col("least").alias("component"))


def _numbered(e: DataFrame) -> DataFrame:
    """The components of edges (u, v) between numbers: node, component."""
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    e = materialize(e, "cc-edges")
    labels = e.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    e = e.where("u <> v")
    for _ in range(MAX_ROUNDS):
        if e.isEmpty():
            return labels
        p = materialize(e.groupBy("u").agg(F.min("v").alias("p")).withColumn("p", F.least("u", "p")), "cc-hooks")
        while True:
            # Jump until every node points at a root: only then does a round halve a long chain's or a grid's nodes.
            for _ in range(2):
                q = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
                p = p.join(q, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
            p = materialize(p, "cc-parents")
            q = p.where("u <> p").select(F.col("u").alias("p"))
            if p.join(q, "p", "left_semi").isEmpty():
                break
        up = p.select(F.col("u").alias("component"), F.col("p").alias("root"))
        labels = materialize(
            labels.join(up, ["component"], "left").select("node", F.coalesce("root", "component").alias("component")),
            "cc-labels",
        )
        pv = p.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = e.join(p, ["u"]).join(pv, ["v"]).select(F.col("p").alias("u"), F.col("pv").alias("v"))
        e = materialize(e.where("u <> v").distinct(), "cc-edges")
    raise RuntimeError("components did not converge")

"""Embedding near-dedup by dual traversal of cover trees.

Unit vectors with cosine >= t are those at Euclidean distance <= r, r^2 = 2 - 2t. Distinct vectors are dealt to the
nearest of some pivots, one for about BLOCK vectors; each pivot's vectors are a block, or several where there are more, with
the pivot's covering radius. Pairs of blocks whose balls lie farther than r apart are never brought together. Each block gets a
cover tree: nested levels of centres whose radii halve (1, 1/2, 1/4), every node a contiguous range with its true
covering radius. Two trees are walked together level by level: a pair of nodes at distance D with covering radii
a, b is dropped if D > r + a + b, taken whole if D + a + b <= r, and otherwise replaced by the pairs of its
children. At the leaves the cosine decides, in double precision, so the links are exact. The top levels are compared in
single precision after a contraction to fewer coordinates, which only brings points nearer: what it drops is dropped for sure.

A task returns link counts and a spanning forest of the links it found, never the pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.llm.forest import join_roots
from planlake.llm.segments import give_back
from planlake.operators.graph import components
from planlake.session import bounded_broadcast, materialize

COSINE = 0.9
BLOCK = 8192
MAX_PIVOTS = 1024
BROADCAST_PAIRS = 500_000
RADII = (1.0, 0.5, 0.25)
SLACK = 1e-9
PAIRS_AT_ONCE = 50_000
ROWS_AT_ONCE = 256
SINGLE_SLACK = 1e-5
CENTRES_AT_ONCE = 256


@dataclass
class Tree:
    """Vectors in depth-first order; levels[l] = (first point, end point, covering radius) of the nodes; a node's centre is its first point.

    What travels are the vectors as they came; ``unit`` is worked out again where a tree arrives.
    """

    ids: np.ndarray
    weight: np.ndarray
    vec: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def __post_init__(self) -> None:
        self.unit = units(self.vec)
        self.short: np.ndarray | None = None
        # A coarse level that hardly gathers anything only loosens the bounds: walks begin below it.
        counts = [len(lo) for lo, _, _ in self.levels]
        self.top = next((i for i in range(len(counts) - 2) if 2 * counts[i] <= counts[i + 1]), len(counts) - 2)

    def dumps(self) -> bytes:
        return pickle.dumps((self.ids, self.weight, self.vec, self.levels), protocol=5)


def units(vec: np.ndarray) -> np.ndarray:
    v = vec.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True, initial=0)  # no overflow in the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def contracted(unit: np.ndarray, cosine: float) -> np.ndarray:
    """Some coordinates after a fixed rotation, and the length of the rest as one more: inner products of unit vectors only grow."""
    dim = unit.shape[1]
    k = int((1 - cosine) * dim + 5 * np.sqrt((1 - cosine) * dim + 16))
    if k + 1 >= dim:
        return unit.astype(np.float32)
    turn, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(dim, k)))
    part = unit @ turn
    rest = np.sqrt(np.maximum(0, 1 - (part * part).sum(1)))
    return np.column_stack([part, rest]).astype(np.float32)


def top_pairs(a: Tree, b: Tree, top: int, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of level ``top`` that may hold a link; of one tree each pair once, with itself too."""
    for t in (a, b):
        if t.short is None:
            t.short = contracted(t.unit, cosine)
    (la, _, ra), (lb, _, rb) = a.levels[top], b.levels[top]
    reach = np.sqrt(2 - 2 * cosine) + SLACK
    out = [(np.zeros(0, int), np.zeros(0, int))]
    # Nodes of one point have one bound a row; only the others need one for every pair.
    for cols in (np.flatnonzero(rb == 0), np.flatnonzero(rb > 0)):
        radius, z = rb[cols], b.short[lb[cols]]
        for i in range(0, len(la) if len(cols) else 0, ROWS_AT_ONCE):
            j = int(np.searchsorted(cols, i)) if same else 0
            if j == len(cols):
                break
            far = reach + ra[i : i + ROWS_AT_ONCE, None] + (radius[None, j:] if radius[0] else 0.0)
            far = np.minimum(far, 2)
            least = (1 - far * far / 2 - SINGLE_SLACK).astype(np.float32)
            x, y = np.nonzero(a.short[la[i : i + ROWS_AT_ONCE]] @ z[j:].T >= least)
            x, y = x + i, cols[y + j]
            out.append((x[x <= y], y[x <= y]) if same else (x, y))
    x, y = (np.concatenate(v) for v in zip(*out, strict=True))
    return x, y


def balls(unit: np.ndarray, points: np.ndarray, least: float) -> list[np.ndarray]:
    """The points in groups: the first point not yet taken is a centre and takes every free one at cosine >= ``least``."""
    out = []
    while len(points):
        centres = points[:CENTRES_AT_ONCE]
        near = unit[points] @ unit[centres].T >= least
        free = np.ones(len(points), dtype=bool)
        for k in range(len(centres)):
            if free[k]:
                own = near[:, k] & free
                own[k] = True
                free &= ~own
                own[k] = False
                out.append(np.concatenate([centres[k : k + 1], points[own]]))
        points = points[free]
    return out


def cover_tree(ids: np.ndarray, weight: np.ndarray, vec: np.ndarray) -> Tree:
    unit = units(vec)
    order = np.arange(len(ids))
    bounds = [0, len(ids)]
    starts = []
    for radius in RADII:
        # Cut each range of the level above into balls of this radius, the range's own centre first.
        least = 1 - radius * radius / 2
        parts = [ball for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) for ball in (balls(unit, order[lo:hi], least) if hi - lo > 1 else [order[lo:hi]])]
        cuts = (np.cumsum([0, *map(len, parts)])[:-1]).tolist() if parts else []
        order = np.concatenate(parts) if parts else order
        bounds = [*cuts, len(ids)]
        starts.append(np.array(cuts, dtype=np.int64))
    unit = unit[order]
    levels = []
    for lo in [*starts, np.arange(len(ids))]:
        hi = np.append(lo[1:], len(ids))
        centre = np.repeat(lo, hi - lo)
        apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", unit, unit[centre]))) if len(ids) else np.zeros(0)
        apart[lo] = 0
        levels.append((lo, hi, np.maximum.reduceat(apart, lo) if len(lo) else apart))
    return Tree(ids[order], weight[order], vec[order], levels)


def walk(a: Tree, b: Tree, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of point ranges (a from, a to, b from, b to) all of whose pairs link; for one tree each pair of points once, not with itself."""
    r = np.sqrt(2 - 2 * cosine)
    top = max(a.top, b.top)
    x, y = top_pairs(a, b, top, same, cosine)
    for level in range(top, len(a.levels)):
        (la, ha, ra), (lb, hb, rb) = a.levels[level], b.levels[level]
        leaf = level == len(a.levels) - 1
        nx, ny = [], []
        for k in range(0, len(x), PAIRS_AT_ONCE):
            p, q = x[k : k + PAIRS_AT_ONCE], y[k : k + PAIRS_AT_ONCE]
            s = np.einsum("ij,ij->i", a.unit[la[p]], b.unit[lb[q]])
            if leaf:
                hit = s >= cosine
                if same:
                    hit &= p != q
                yield la[p[hit]], ha[p[hit]], lb[q[hit]], hb[q[hit]]
                continue
            apart = np.sqrt(np.maximum(0, 2 - 2 * s)) + (ra[p] + rb[q])
            own = (p == q) & same
            whole = ~own & (apart <= r - SLACK)
            yield la[p[whole]], ha[p[whole]], lb[q[whole]], hb[q[whole]]
            open_ = own | (~whole & (apart - 2 * (ra[p] + rb[q]) <= r + SLACK))
            p, q, own = p[open_], q[open_], own[open_]
            (ca, _, _), (cb, _, _) = a.levels[level + 1], b.levels[level + 1]
            fa, fb = np.searchsorted(ca, la[p]), np.searchsorted(cb, lb[q])
            na, nb = np.searchsorted(ca, ha[p]) - fa, np.searchsorted(cb, hb[q]) - fb
            n = na * nb
            row = np.repeat(np.arange(len(p)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cx, cy = fa[row] + at // nb[row], fb[row] + at % nb[row]
            keep = ~own[row] | (cx <= cy)
            nx.append(cx[keep])
            ny.append(cy[keep])
        if leaf:
            return
        x, y = (np.concatenate(v) if v else np.zeros(0, int) for v in (nx, ny))


def links(a: Tree, b: Tree, same: bool, cosine: float) -> pa.RecordBatch:
    """node, n (weight of what it links to in the other tree), root (a node of its local component) for the points with links."""
    n = len(a.ids)
    shift = 0 if same else n
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    sums = (np.concatenate([[0], np.cumsum(t.weight)]) for t in (a, b))
    wa, wb = sums
    count = np.zeros(len(ids) + 1, dtype=np.int64)
    root = np.arange(len(ids))
    for fa, ta, fb, tb in walk(a, b, same, cosine):
        if not len(fa):
            continue
        np.add.at(count, fa, wb[tb] - wb[fb])
        np.add.at(count, ta, wb[fb] - wb[tb])
        np.add.at(count, fb + shift, wa[ta] - wa[fa])
        np.add.at(count, tb + shift, wa[fa] - wa[ta])
        # Every point of one range is tied to the first point of the other.
        size, other = ta - fa, tb - fb
        u = np.concatenate([np.repeat(fa - np.cumsum(size) + size, size) + np.arange(size.sum()), np.repeat(fb - np.cumsum(other) + other, other) + np.arange(other.sum()) + shift])
        v = np.concatenate([np.repeat(fb + shift, size), np.repeat(fa, other)])
        root = join_roots(root, u, v)
    total = np.cumsum(count[:-1])
    hit = total > 0
    return pa.record_batch([pa.array(x) for x in (ids[hit], total[hit], ids[root[hit]])], names=["node", "n", "root"])


def linked(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(node, n, root) of the classes (node, weight, vec) whose vectors all have ``dim`` components: link counts and forests, several rows for a node."""
    spark = classes.sparkSession
    wanted = min(MAX_PIVOTS, max(1, -(-classes.count() // BLOCK)))
    pivots = classes.orderBy(F.xxhash64("node"), "node").limit(wanted).select("vec").toArrow().column("vec")  # at most MAX_PIVOTS rows

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(-1, dim)

    centre = units(matrix(pivots.combine_chunks()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                s = units(matrix(part.column("vec"))) @ centre.T
                near = s.argmax(1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * s[np.arange(len(near)), near]))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(near.astype(np.int32)), pa.array(apart)], names=["node", "pivot", "apart"])

    # Nodes with their pivots are narrow; the vectors move once more, to their blocks.
    dealt = materialize(classes.select("node", "vec").mapInArrow(deal, "node long, pivot int, apart double"), "vec-dealt")
    groups = {x["pivot"]: x for x in dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect()}  # at most MAX_PIVOTS rows
    plan = {}
    for p, x in sorted(groups.items()):
        plan[p] = (sum(k for _, k in plan.values()), -(-x["n"] // BLOCK))
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    near = [(*plan[p], *plan[q]) for p in plan for q in plan if p <= q and np.linalg.norm(centre[p] - centre[q]) <= reach + groups[p]["radius"] + groups[q]["radius"]]
    blocks = spark.createDataFrame([(p, *x) for p, x in plan.items()], "pivot int, first int, cuts int")
    block = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("cuts"))).cast("int").alias("block")
    placed = dealt.join(F.broadcast(blocks), "pivot").select("node", block).join(classes, "node")

    def build(key: tuple, frame: pa.Table) -> pa.Table:
        t = frame.combine_chunks()
        tree = cover_tree(*(np.asarray(t.column(c)) for c in ("node", "weight")), matrix(t.column("vec").chunk(0)))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([tree.dumps()], pa.binary())})

    trees = materialize(placed.select("block", "node", "weight", "vec").groupBy("block").applyInArrow(build, "block int, tree binary"), "vec-trees")
    pairs = spark.createDataFrame(near, "p int, pk int, q int, qk int")
    pairs = pairs.select(F.explode(F.expr("sequence(p, p + pk - 1)")).alias("x"), "q", "qk").select("x", F.explode(F.expr("sequence(q, q + qk - 1)")).alias("y")).where("x <= y")

    def traverse(key: tuple, frame: pa.Table) -> pa.Table:
        x, y = (k.as_py() for k in key)
        tree = {b.as_py(): Tree(*pickle.loads(t.as_buffer())) for b, t in zip(frame.column("block"), frame.column("tree"), strict=True)}
        found = pa.Table.from_batches([links(tree[x], tree[y], x == y, cosine)])
        del tree, frame
        give_back()
        return found

    # Each pair of blocks is a task's worth of work that gets the two trees, one if a block meets itself.
    sides = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    work = trees.join(bounded_broadcast(sides, BROADCAST_PAIRS), "block").select("x", "y", "block", "tree")
    return materialize(work.groupBy("x", "y").applyInArrow(traverse, "node long, n long, root long"), "vec-links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per input row: id, n_links (other rows at cosine >= ``cosine``), component_id, kept (id = component_id).

    component_id is the smallest id reachable by links, itself included. Vectors that are null, empty or zero, or that hold
    null or non-finite components link with nothing. Vectors of different lengths have no cosine: each length is compared for itself,
    one after the other. Repeated vectors link with each other and are compared as one; rows that share an id each have their
    vector's links. A null id is no row's component; a row with a null id comes back with its own links and its group's component.
    Other columns are ignored. Empty tables give empty results.
    """
    single = vectors.schema[vec_col].dataType.jsonValue().get("elementType") == "float"
    vec = F.transform(F.col(vec_col).cast(f"array<{'float' if single else 'double'}>"), lambda x: x + F.lit(0).cast("float" if single else "double"))  # no negative zeros
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(ok, F.lit(False)).alias("ok"))
    prints = [F.xxhash64("vec").alias("fp"), F.xxhash64(F.lit(11), "vec", F.lit(13)).alias("fp2")]
    rows = rows.select("id", "ok", F.when(F.col("ok"), F.col("vec")).alias("vec"), *prints)
    classes = rows.where("ok").groupBy("vec").agg(F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    # A class has a number of its own: several classes can have one smallest id. The numbers are fixed once written.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vec-classes")
    dims = [x["dim"] for x in classes.select(F.size("vec").alias("dim")).distinct().orderBy("dim").collect()]  # lengths, not rows
    none = vectors.sparkSession.createDataFrame([], "node long, n long, root long")
    found = reduce(DataFrame.unionByName, [linked(classes.where(F.size("vec") == d).select("node", "weight", "vec"), d, cosine) for d in dims], none)
    label = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    numbered = classes.select("node", "fp", "fp2", "rep", "weight")
    smallest = label.join(numbered.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = label.join(smallest, "component").select("node", "component_id")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    of_class = numbered.join(counts, "node", "left").join(named, "node", "left")
    of_class = of_class.select("fp", "fp2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    of_class = materialize(of_class, "vec-labels")
    out = rows.where("ok").select("id", "fp", "fp2").join(of_class, ["fp", "fp2"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.expr("id <=> component_id").alias("kept"))

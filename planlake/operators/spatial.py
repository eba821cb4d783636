"""Spatial joins inside a plan: equi-join on (plan_id, grid cell), one pair per match, then the exact predicate.

A row's box covers cells; two boxes that meet share a cell. Each pair is kept in the cell that holds the
lower-left corner of the boxes' intersection only, so no duplicate pair is made and none has to be removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake.session import materialize

#: Wider than most walls are long: a row is shuffled once for each cell of its box.
CELL = 4000.0


def _celled(df: DataFrame, box: tuple[Column | str, ...], grow: float, cell: float, prefix: str | None = None) -> DataFrame:
    """``df`` once for each cell of its grown box; with a ``prefix`` the grown corners are kept too."""
    box = [F.col(c) if isinstance(c, str) else c for c in box]
    low, high = [c - grow for c in box[:2]], [c + grow for c in box[2:]]
    if prefix:
        df = df.withColumns({f"__{prefix}{i}": c for i, c in enumerate((*low, *high))})
    to = lambda c: F.floor(c / cell).cast("int")
    df = df.withColumn("__cx", F.explode(F.sequence(to(low[0]), to(high[0]))))
    return df.withColumn("__cy", F.explode(F.sequence(to(low[1]), to(high[1]))))


def grid_join(left: DataFrame, right: DataFrame, left_box: tuple, right_box: tuple, reach: float = 0.0, cell: float = CELL, key: str = "plan_id", alike: bool = False) -> DataFrame:
    """Pairs of rows of one plan whose boxes (x0, y0, x1, y1: columns, or expressions over a side's columns) come within ``reach`` along both axes.

    Other columns of the two sides must have different names. Rows with a null key or corner join nothing.
    A plan with very many rows is split by its cells; AQE splits what skew is left. ``alike`` says that both sides are one table: both
    are then grown before they are written to cells, so that they are one shuffle, which Spark writes once and reads twice.
    """
    left_box, right_box = (tuple(F.col(c) if isinstance(c, str) else c for c in box) for box in (left_box, right_box))
    a = _celled(left, left_box, reach, cell)
    b = _celled(right, right_box, reach if alike else 0.0, cell)
    pairs = a.join(b, [key, "__cx", "__cy"])
    # The boxes are worked out again from their columns: that costs less than to shuffle them beside these.
    a0, a1, a2, a3 = *[c - reach for c in left_box[:2]], *[c + reach for c in left_box[2:]]
    b0, b1, b2, b3 = right_box
    meets = (a0 <= b2) & (b0 <= a2) & (a1 <= b3) & (b1 <= a3)
    home = (F.floor(F.greatest(a0, b0) / cell) == F.col("__cx")) & (F.floor(F.greatest(a1, b1) / cell) == F.col("__cy"))
    return barrier(pairs.where(meets & home)).drop("__cx", "__cy")


def barrier(df: DataFrame) -> DataFrame:
    """``df``, with later filters kept above its own: else the optimizer puts a costly predicate into the join, ahead of the box tests."""
    return df.where(F.monotonically_increasing_id() >= 0)


def computed(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` + columns that are worked out once a row: a filter on a plain column would copy its expression below the projection."""
    one = F.struct(*[v.alias(k) for k, v in values.items()])
    return df.withColumn("__one", F.explode(F.array(one))).select(*df.columns, *[F.col(f"__one.{k}").alias(k) for k in values])


def renamed(df: DataFrame, prefix: str, columns: list[str], key: str = "plan_id") -> DataFrame:
    """The key and the columns, prefixed."""
    return df.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def self_pairs(df: DataFrame, box: tuple | Callable[[str], tuple], columns: list[str], reach: float = 0.0, id_col: str = "det_id", cell: float = CELL, key: str = "plan_id") -> DataFrame:
    """Pairs (a_*, b_*) of different rows of a plan, each once (a id < b id), whose boxes come within ``reach``.

    A box is four columns, or a function that gives it out of a side's prefix, which needs no columns of its own.
    """
    given = callable(box)
    cols = list(dict.fromkeys([id_col, *columns, *([] if given else box)]))
    # Both sides are one table: were one of them broadcast, pairs would be worked out in the few tasks that read it.
    a, b = renamed(df, "a_", cols, key), renamed(df, "b_", cols, key).hint("merge")
    boxes = [box(p) if given else tuple(f"{p}{c}" for c in box) for p in ("a_", "b_")]
    pairs = grid_join(a, b, *boxes, reach, cell, key, alike=True)
    return barrier(pairs.where(F.col(f"a_{id_col}") < F.col(f"b_{id_col}")))


def nearest(left: DataFrame, right: DataFrame, reach: float = 2000.0, key: str = "plan_id", id_col: str = "det_id") -> DataFrame:
    """For each point (key, id, x, y) of ``left`` the nearest of ``right`` in its plan, at any distance: key, id, other, distance; ties go to the smallest id.

    Points meet within ``reach`` first; those without a hit look eight times as far, and so on, so dense plans are never joined in full
    and the number of passes is logarithmic in the extent. Points of plans that have none in ``right`` are left out, and so are those with
    coordinates that are null, not finite or beyond 1e12.
    """
    sound = " AND ".join(f"abs({c}) < 1e12" for c in ("x", "y"))
    one = lambda df, p: df.where(sound).select(key, F.col(id_col).alias(f"__{p}"), F.col("x").alias(f"__{p}x"), F.col("y").alias(f"__{p}y")).distinct()
    a, b = one(left, "l"), one(right, "r")
    rest, found = materialize(a.join(b.select(key).distinct(), key, "left_semi"), "nearest-left"), None
    while True:
        pairs = grid_join(rest, b, ("__lx", "__ly", "__lx", "__ly"), ("__rx", "__ry", "__rx", "__ry"), reach, reach, key)
        d = F.sqrt((F.col("__lx") - F.col("__rx")) ** 2 + (F.col("__ly") - F.col("__ry")) ** 2)
        pairs = pairs.withColumn("__d", F.round(d + 1e-9, 6)).where(F.col("__d") <= reach)
        hit = materialize(pairs.groupBy(key, "__l").agg(F.min(F.struct("__d", "__r")).alias("m")), "nearest-hits")
        found = hit if found is None else found.unionByName(hit)
        rest, reach = materialize(rest.join(hit.select(key, "__l"), [key, "__l"], "left_anti"), "nearest-left"), reach * 8
        if rest.isEmpty():
            return found.select(key, F.col("__l").alias(id_col), F.col("m.__r").alias("other"), F.col("m.__d").alias("distance"))


def best_match(pairs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """For each left row the pair that comes first; end the order with an id to make it total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return pairs.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")

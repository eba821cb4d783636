"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

The mix closest to the corpus in relative entropy under one token constraint per source has rates
rate(d) = min(MAX_REPEAT, exp(tilt_source * size_d / mean_size_source)). The dual of that problem
separates by source into one monotone equation in the tilt, solved for all sources at once by
distributed, bracketed Newton iterations over a histogram of (source, size): an exact summary, so the
texts are read once. The rates are then rounded to whole copies by systematic rounding in size order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
TOLERANCE = 1e-12
TILT_DIGITS = 8
MAX_NEWTON = 60
CELL_ROWS = 200
BROADCAST_SOURCES = 100_000
SETTLING = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t-\\r; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    t = F.regexp_replace(F.trim(t), " {2,}", " ")
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> + weight, target. Weights repeat in code-point order, null last.

    target = min(max_repeat * size, level * weight) with the one level at which targets sum to all sizes:
    resharing the excess by weight until no target is above its cap ends there. One row per source, so the
    windows over all sources are small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    t = t.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_w", F.sum("weight").over(every))
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("used_w", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("try", (F.col("total") - F.col("full")) / (F.col("all_w") - F.col("used_w")))
    # The first source, in order of cap per weight, that the level does not fill sets the level.
    level = F.min(F.when(F.col("try") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("try").alias("level")))).over(every)
    return t.withColumn("level", level["level"]).select(
        "source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def newton_tilts(hist: DataFrame, targets: DataFrame, max_repeat: int = MAX_REPEAT, small: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """The tilt of each source. hist: source, size, n (size > 0); targets: source, target. One row per source comes back.

    Each iteration is one aggregate of the histogram per source; a Newton step that leaves the bracket is
    replaced by its middle, so it always converges. ``small`` is the hint for tables with one row per source. A target of max_repeat times the source gets the tilt
    at which every document of the source is repeated max_repeat times.
    """
    top = F.log(F.lit(float(max_repeat)))
    mean = hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    # Between these tilts lies every reachable target: at hi all are at the cap, at lo next to nothing is taken.
    state = targets.join(mean, targets["source"].eqNullSafe(mean["source"])).select(
        targets["source"], "target", "mean", (top * F.col("mean") / F.col("least")).alias("hi"), (F.lit(-60.0) * F.col("mean") / F.col("least")).alias("lo"), F.lit(0.0).alias("tilt"), F.lit(False).alias("done")
    )
    state = materialize(state, "mix-state")
    for _ in range(MAX_NEWTON):
        open_ = state.where("NOT done")
        if open_.isEmpty():
            break
        h = hist.alias("h").join(small(open_.alias("s")), F.expr("h.source <=> s.source"))
        x = F.col("tilt") * F.col("size") / F.col("mean")
        rate = F.when(x >= top, F.lit(float(max_repeat))).otherwise(F.exp(x))
        slope = F.when(x >= top, F.lit(0.0)).otherwise(F.exp(x) * F.col("size") * F.col("size") / F.col("mean"))
        step = h.groupBy(F.col("s.source").alias("source"), "target", "mean", "hi", "lo", "tilt").agg(
            (F.sum(F.col("n") * F.col("size") * rate) - F.first("target")).alias("gap"), F.sum(F.col("n") * slope).alias("slope")
        )
        step = step.withColumn("hi", F.when(F.col("gap") >= 0, F.col("tilt")).otherwise(F.col("hi"))).withColumn("lo", F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("lo")))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - F.col("gap") / F.col("slope"))
        middle = (F.col("lo") + F.col("hi")) / 2
        step = step.withColumn("next", F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(middle))
        done = (F.abs(F.col("gap")) <= F.col("target") * TOLERANCE) | (F.col("hi") - F.col("lo") <= 1e-13 * (F.abs(F.col("hi")) + F.abs(F.col("lo"))))
        step = step.select("source", "target", "mean", "hi", "lo", F.when(done, F.col("tilt")).otherwise(F.col("next")).alias("tilt"), done.alias("done"))
        state = materialize(state.where("done").unionByName(step), "mix-state")
    # Sums in another order differ in their last bits; rounded tilts don't, so reruns agree.
    return state.select("source", "mean", F.round("tilt", TILT_DIGITS).alias("tilt"))


def settled(cells: DataFrame, targets: DataFrame, max_repeat: int, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cells (source, size, n, rate, taken: copies of all n documents) after SETTLING corrections of one copy per source.

    Rounding leaves a source up to half a large document away from its target. Each correction adds or takes one copy
    in the cell that brings the source closest, if that helps; ties go to the smaller size.
    """
    for _ in range(SETTLING):
        have = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("taken")).alias("have"))
        goal = have.alias("a").join(small(targets.alias("t")), F.expr("a.source <=> t.source")).select("a.source", (F.col("target") - F.col("have")).alias("gap"))
        c = cells.alias("c").join(small(goal.alias("g")), F.expr("c.source <=> g.source")).select("c.*", "gap")
        more = F.col("gap") > 0
        can = F.when(more, F.col("taken") < F.col("n") * max_repeat).otherwise(F.col("taken") > 0)
        gain = F.round(F.abs("gap") - F.abs(F.abs("gap") - F.col("size")), 6)
        best = c.where(can & (gain > 0)).groupBy("source").agg(F.max_by("size", F.struct(gain, -F.col("size"))).alias("at"), F.first(F.when(more, 1).otherwise(-1)).alias("step"))
        moved = cells.alias("c").join(small(best.alias("b")), F.expr("c.source <=> b.source AND c.size = b.at"), "left")
        cells = materialize(moved.select("c.source", "c.size", "c.n", "c.rate", (F.col("taken") + F.coalesce("step", F.lit(0))).alias("taken")), "mix-cells")
    return cells


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, rate, copies.

    A document's size is its word count (null and empty texts: 0, never taken). Rows with a null source form
    a source of their own, last in order. copies is floor(rate) or one more, but for SETTLING corrections of one copy
    per source; equal-sized documents are rounded together and the running remainder passes through the sizes in order. Which of several equal-sized documents get the extra copy
    follows a hash of the id and the text, so reruns agree; repeated rows get answers that agree as a set. A source whose words are all missing has target 0. Empty tables give empty results.
    """
    plan = _plan(docs, id_col, text_col, source_col, weights, max_repeat)
    return plan.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies")


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """What ``mix`` gives, with the text's hash: id, source, mark, size, source_size, target, rate, copies."""
    base = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("mark"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    hist = materialize(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialize(source_targets(sizes, weights, max_repeat), "mix-targets")
    full = hist.where("size > 0")
    # Tables with one row per source are broadcast if their number, counted here, allows.
    small = F.broadcast if targets.count() <= BROADCAST_SOURCES else lambda d: d
    tilts = newton_tilts(full, targets.where("source_size > 0").select("source", "target"), max_repeat, small)
    # Rates per (source, size): how many copies all its n documents take together.
    h = full.alias("h").join(small(tilts.alias("s")), F.expr("h.source <=> s.source")).select(
        F.col("h.source").alias("source"), "size", "n", F.least(F.lit(float(max_repeat)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(2.0 + max_repeat)))).alias("rate")
    )
    h = h.withColumn("whole", F.least(F.floor(F.col("rate") + 1e-9), F.lit(max_repeat))).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    up = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("end", F.sum(F.round(F.col("part") * F.col("n"), 9)).over(up))
    h = h.withColumn("extra", (F.floor(F.col("end") + 0.5) - F.floor(F.col("end") - F.round(F.col("part") * F.col("n"), 9) + 0.5)).cast("long"))
    h = h.select("source", "size", "n", "rate", (F.col("whole") * F.col("n") + F.col("extra")).cast("long").alias("taken"))
    h = settled(materialize(h, "mix-cells"), targets, max_repeat, small)
    h = h.select("source", "size", "n", "rate", F.expr("taken div n").alias("whole"), F.expr("taken % n").alias("extra"))
    # extra of the n documents of a cell get one more copy. Large cells are cut into sub-cells by hash;
    # each gets its share of the extra by a running sum over the cell's few sub-cells.
    cells = h.select("source", "size", "n", "rate", "whole", "extra", F.ceil(F.col("n") / CELL_ROWS).alias("cuts"))
    spread = F.xxhash64(F.col("id"), F.col("mark"), F.lit(29))
    rows = base.alias("b").join(cells.alias("c"), F.expr("b.source <=> c.source AND b.size = c.size")).select(
        "b.id", "b.source", "b.mark", "b.size", "rate", "whole", "extra", "n", F.pmod(F.xxhash64(F.col("b.id"), F.col("b.mark"), F.lit(31)), F.col("cuts")).alias("cut"), spread.alias("spread")
    )
    sub = rows.groupBy("source", "size", "cut").agg(F.count(F.lit(1)).alias("m"), F.first("extra").alias("extra"), F.first("n").alias("n"))
    to = F.sum("m").over(Window.partitionBy("source", "size").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sub = sub.withColumn("to", to).withColumn("share", F.expr("(extra * to) div n - (extra * (to - m)) div n"))
    sub = materialize(sub.where("share > 0").select("source", "size", "cut", "share"), "mix-shares")
    rank = F.row_number().over(Window.partitionBy("source", "size", "cut").orderBy("spread", F.col("id").asc_nulls_last(), "mark"))
    rows = rows.withColumn("rank", rank)
    rows = rows.alias("r").join(sub.alias("s"), F.expr("r.source <=> s.source AND r.size = s.size AND r.cut = s.cut"), "left").select(
        "r.id", "r.source", "r.mark", "r.size", "rate", (F.col("whole") + F.when(F.col("rank") <= F.coalesce("share", F.lit(0)), 1).otherwise(0)).cast("long").alias("copies")
    )
    none = base.where("size = 0").select("id", "source", "mark", "size", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"))
    rows = rows.unionByName(none)
    return rows.alias("r").join(small(targets.alias("t")), F.expr("r.source <=> t.source")).select("r.id", "r.source", "mark", "size", "source_size", "target", "rate", "copies")


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns unchanged.

    Rows are matched with their copies by id, source and text, null ids and sources included. Rows equal in all three share their
    copies evenly; what is left over goes to the first of them by a hash of the whole row.
    """
    plan = _plan(docs, id_col, text_col, source_col, WEIGHTS, MAX_REPEAT)
    plan = plan.groupBy("id", "source", "mark").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike")).where("copies > 0")
    plan = materialize(plan.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("mark").alias("__mark"), F.col("copies").alias("__copies"), F.col("alike").alias("__alike")), "mix-plan")
    tagged = docs.withColumn("__text", F.xxhash64(text_col))
    same = docs[id_col].eqNullSafe(plan["__id"]) & docs[source_col].eqNullSafe(plan["__source"]) & (F.col("__text") == F.col("__mark"))
    found = tagged.join(plan, same)
    single = found.where("__alike = 1")
    several = found.where("__alike > 1")
    order = Window.partitionBy("__id", "__source", "__mark").orderBy(F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]))
    rank = F.row_number().over(order)
    several = several.withColumn("__copies", F.expr("__copies div __alike") + F.when(rank <= F.expr("__copies % __alike"), 1).otherwise(0)).where("__copies > 0")
    return single.unionByName(several).withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)

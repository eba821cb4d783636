"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Every row gets a run number (a hash of its id). A run holds the run's entries in the order of their digests, cut into
slices by the digest's first byte so that no run has to fit one task. Level 0 keeps one entry per digest and run:
the retained identifier and a row count. Each further round brings 2**FAN_BITS neighbouring runs together slice by
slice (run >> FAN_BITS, the binomial exchange), sorts what the sorted runs have into one order, where equal digests
are neighbours, and keeps the first of each, until one run is left. The decision then travels back down the same tree,
so a digest that holds a third of all rows is met by at most one entry per run at any level, and the rows
themselves meet their run's entry only.

An entry is identified by SHA-256 and verified by two independent figures of the same text
(byte length and xxhash64); all three must agree for rows to merge, at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake.session import materialize

RUN_BITS = 8
FAN_BITS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty; A-Z lower-cased and nothing else."""
    t = F.coalesce(text, F.lit(""))
    # lower() is Unicode-wide; it equals the A-Z form on texts of ASCII bytes only.
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def digest_entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, run, sha, n_bytes, check) for each row: small, whatever the text's length."""
    norm = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    # xxhash64 of the id spreads copies over the runs; null ids have a run too.
    return norm.select(
        "id",
        F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << RUN_BITS)).cast("int").alias("run"),
        F.sha2("norm", 256).alias("sha"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
    )


KEY = ["sha", "n_bytes", "check"]


def merged(runs: DataFrame, bits: int, keep: str) -> DataFrame:
    """Runs (run, slice, KEY, keep_id, group_size) after merging 2**bits neighbours each: sorted, one entry per digest."""
    near = runs.withColumn("run", F.shiftright("run", bits)).repartition("run", "slice")
    first = F.desc_nulls_last("keep_id") if keep == "max" else F.asc_nulls_last("keep_id")
    place = ["run", "slice", *KEY]
    near = near.sortWithinPartitions(*place, first)
    # The windows need exactly this partitioning and order: neighbours in the merged order are compared, nothing is sorted again.
    alike = Window.partitionBy(*place).orderBy(first)
    whole = alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = near.withColumns({"turn": F.row_number().over(alike), "group_size": F.sum("group_size").over(whole)})
    return near.where("turn = 1").drop("turn")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "min" or "max" identifier. Null text counts as empty, so null and empty texts are one
    group. A null id loses to any other; a group of null ids only keeps keep_id null and marks its rows
    kept. Repeated rows (same id, same text) each count in group_size and each carry the same answer.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    entries = materialize(digest_entries(docs, id_col, text_col), "dedup-digests")
    best = {"max": F.max, "min": F.min}[keep]
    # Rows of one digest within a task and run shrink to one entry before anything moves.
    level = entries.groupBy("run", *KEY).agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    levels = [materialize(merged(level.withColumn("slice", F.substring("sha", 1, 2)), 0, keep), "dedup-run")]
    for _ in range(0, RUN_BITS, FAN_BITS):
        levels.append(materialize(merged(levels[-1], FAN_BITS, keep), "dedup-run"))
    down = levels.pop().drop("slice")
    while levels:
        children = levels.pop().select("run", *KEY, F.shiftright("run", FAN_BITS).alias("up"))
        down = children.join(down.withColumnRenamed("run", "up"), ["up", *KEY]).drop("up")
    return entries.join(down, ["run", *KEY]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.expr("id <=> keep_id").alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; of repeated rows (same id, same text) one stays."""
    kept = classify(docs, id_col, text_col, keep).where("kept")
    kept = kept.groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.count(F.lit(1)).alias("__alike"))
    kept = materialize(kept, "dedup-kept")
    tagged = docs.withColumn("__text", F.sha2(normalised(F.col(text_col)), 256)).withColumn("__own", F.col(id_col).cast("long"))
    stay = tagged.join(kept, tagged["__own"].eqNullSafe(kept["__id"]) & (tagged["__text"] == kept["__sha"]))
    # Only repeated rows meet again; the others pass through one join.
    repeated = stay.where("__alike > 1").dropDuplicates(["__id", "__sha"])
    return stay.where("__alike = 1").unionByName(repeated).select(*docs.columns)

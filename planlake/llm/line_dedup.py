"""Line dedup by a log-template tree (DataFrame functions only).

A line's tokens are parsed down a tree of fixed depth: by their number, then by the leading tokens, where a token
with a digit is a variable field. At a leaf, lines that differ are generalised: a place is kept where most of the
leaf's distinct lines agree and becomes a variable field elsewhere. A line that fits its leaf's template, if
enough places of that are kept, belongs to it; any other line is its own template. Templates found in LEAST_DOCS
documents or more are boilerplate and their lines are dropped from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.session import bounded_broadcast, materialize

LEAST_DOCS = 3
DEPTH = 3
AGREE = 0.6
KEPT = 0.7
FIELD = "<*>"
BROADCAST_ROWS = 500_000
BLANK = "[ \\t\\x0B\\f\\r]"


def masked(line: Column) -> Column:
    """The line's tokens joined by single spaces, each token with a digit replaced by FIELD."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(line, F.lit(c))
    # Few lines are rewritten; the rest only pass cheap tests.
    one = F.when(odd, F.regexp_replace(F.regexp_replace(line, f"^{BLANK}+|{BLANK}+$", ""), f"{BLANK}+", " ")).otherwise(line)
    # Anchored at token starts and possessive, so a long token is read once.
    return F.when(line.rlike("[0-9]"), F.regexp_replace(one, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(one)


def n_tokens(mask: Column) -> Column:
    return F.octet_length(mask) - F.octet_length(F.replace(mask, F.lit(" "), F.lit(""))) + 1


def leaf_of(mask: Column) -> Column:
    """Where the tree puts a line: number of tokens and the first DEPTH of them."""
    return F.xxhash64(n_tokens(mask), F.substring_index(mask, " ", DEPTH))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mask) of every line that has a token."""
    lines = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("line"))
    return lines.select("id", masked(F.col("line")).alias("mask")).where("mask <> ''")


def recurring(docs: DataFrame, id_col: str, text_col: str, least_docs: int) -> DataFrame:
    """(id, line): which documents have which lines, by hash of the masked line, whose template is found in ``least_docs`` documents or more."""
    lines = lines_of(docs, id_col, text_col)
    seen = lines.select("id", leaf_of(F.col("mask")).alias("leaf"), F.xxhash64("mask").alias("line")).distinct()
    seen = materialize(seen, "lines-seen")
    per_line = seen.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"))
    leaves = seen.select("leaf", "id").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"))
    varied = per_line.groupBy("leaf").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    mixed = materialize(leaves.where(F.col("docs") >= least_docs).join(varied, "leaf").select("leaf", "variants"), "lines-leaves")
    # Only leaves with several lines need their texts again.
    own = lines.withColumn("leaf", leaf_of(F.col("mask"))).join(bounded_broadcast(mixed.select("leaf"), BROADCAST_ROWS), "leaf", "left_semi")
    variants = materialize(own.select("leaf", "mask").distinct(), "lines-variants")
    tokens = variants.select("leaf", F.xxhash64("mask").alias("line"), F.posexplode(F.split("mask", " ", -1)).alias("place", "token"))
    common = tokens.groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("n")).join(mixed, "leaf")
    common = materialize(common.where((F.col("n") >= AGREE * F.col("variants")) & (F.col("token") != FIELD)).select("leaf", "place", "token"), "lines-kept")
    kept = common.groupBy("leaf").agg(F.count(F.lit(1)).alias("kept"))
    size = n_tokens(F.col("mask"))
    fits = tokens.join(common, ["leaf", "place", "token"]).groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("met"))
    general = variants.select("leaf", F.xxhash64("mask").alias("line"), size.alias("size")).join(fits, ["leaf", "line"]).join(kept, "leaf")
    general = general.where((F.col("met") == F.col("kept")) & (F.col("kept") >= KEPT * F.col("size"))).select("leaf", "line", F.lit(True).alias("general"))
    general = materialize(general, "lines-general")
    # A template is a leaf's general one, or a single line.
    named = seen.join(general, ["leaf", "line"], "left").select("id", "leaf", "line", F.when(F.col("general"), F.lit(0)).otherwise(F.col("line")).alias("template"), F.coalesce("general", F.lit(False)).alias("general"))
    key = ["leaf", "template", "general"]
    often = named.select(*key, "id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least_docs).select(*key)
    template = per_line.select("leaf", "line").join(general, ["leaf", "line"], "left").select("line", "leaf", F.when(F.col("general"), F.lit(0)).otherwise(F.col("line")).alias("template"), F.coalesce("general", F.lit(False)).alias("general"))
    bad = materialize(template.join(often, key, "left_semi").select("line").distinct(), "lines-recurring")
    return seen.select("id", "line").join(bounded_broadcast(bad, BROADCAST_ROWS), "line", "left_semi")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of ``docs`` with boilerplate lines dropped from the text, + n_lines, n_dropped; other columns unchanged.

    Lines are separated by newlines; lines without a token are never dropped; the rest keep their order and the newlines between
    them. Null text stays null with no lines. A document counts once for a template, by its id: repeated rows are one
    document, rows with a null id are one document together. A text whose lines all go becomes empty. Columns named
    n_lines or n_dropped are replaced. Empty tables give empty results.
    """
    rows = docs.drop("n_lines", "n_dropped")
    hits = recurring(docs, id_col, text_col, least_docs).groupBy("id").agg(F.collect_set("line").alias("__bad"))
    hits = materialize(hits.select(F.col("id").alias("__id"), "__bad"), "lines-hits")
    joined = rows.join(hits, rows[id_col].eqNullSafe(hits["__id"]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    stays = F.filter(lines, lambda x: ~F.array_contains("__bad", F.xxhash64(masked(x))))
    joined = joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    joined = joined.withColumn("__stays", F.when(F.col("__bad").isNotNull(), stays))
    joined = joined.withColumn("n_dropped", F.when(F.col("__stays").isNull(), 0).otherwise(F.col("n_lines") - F.size("__stays")).cast("long"))
    joined = joined.withColumn(text_col, F.when(F.col("__stays").isNull(), F.col(text_col)).otherwise(F.array_join("__stays", "\n")))
    return joined.select(*rows.columns, "n_lines", "n_dropped")

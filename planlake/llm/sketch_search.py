"""Ranked lexical search by hashed max-sketches.

``build`` writes an index of a table of documents: of each document the number of its terms and a sketch, and of each term the
number of documents that hold it. A sketch folds the document's terms into COORDINATES by a hash and keeps the
largest number of occurrences in each. A document's impact on a term grows with the occurrences and else depends on its length
only, so the impact of a coordinate's largest number is the largest impact of its terms: never below that of any of them.

``search`` takes items in blocks against all documents. A block of sketches, as impacts, times the weights of the items'
terms, folded by the same hash, gives for each document and item an upper bound of the score in one matrix product. Documents are
scored exactly, from their whole texts, in the order of falling bounds: first the SEEDS documents with the largest bounds, then, in steps while they
are many, all that are left whose bound reaches the item's k-th best exact score. What is not scored has a bound below that score, so the result is exact.

Scores are whole numbers. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); its impact is
(10^9 tf) div (1000 tf + 8 m) with m = 25 + (75 n N) div L, for N documents with terms, L terms in all, n in the document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planlake.llm.segments import slices
from planlake.llm.shingles import LOWER
from planlake.session import bounded_broadcast, materialize

TOP = 10
COORDINATES = 4096
SEEDS = 64
PAIRS_AT_ONCE = 200_000
ITEMS_AT_ONCE = 500
DOCS_AT_ONCE = 512
TERMS_HELD = 200_000
BROADCAST_ROWS = 500_000
#: Bounds are products in single precision; all their parts are positive, so this covers their rounding.
SINGLE_SLACK = 1e-3
#: Bytes of terms: ASCII letters and digits, and all of other characters.
IN_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(document number of each term, its number among the distinct terms, the distinct terms): only A-Z are lower-cased."""
    # Arrow's ascii_lower gives wrong texts for a slice of a longer array, so bytes are lower-cased here.
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = LOWER[np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = IN_TERM[data]
    fresh = np.ones(len(data) + 1, dtype=bool)  # a term ends before a byte that isn't one, and where a text ends
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets[offsets < len(data)]] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    # The bytes of all terms one after the other; a term's length is the number of them up to the next term's start.
    place = np.cumsum(inside) - inside
    cuts = np.append(place[starts], inside.sum()).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return doc, np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(terms of each document; document, term and occurrences of each pair that occurs; the distinct terms)."""
    doc, code, names = terms_of(texts)
    pairs, tf = np.unique(doc * max(1, len(names)) + code, return_counts=True)
    return np.bincount(doc, minlength=len(texts)).astype(np.int64), pairs // max(1, len(names)), pairs % max(1, len(names)), tf, names


def folds(terms: Iterable[bytes], coordinates: int) -> np.ndarray:
    """The coordinate of each term."""
    return np.fromiter(map(zlib.crc32, terms), dtype=np.int64) % coordinates


@dataclass
class Index:
    """What ``build`` writes: sketches (row, id, text_hash, n, at, tf: one row per document with terms) and frequencies (term, df)."""

    sketches: DataFrame
    frequencies: DataFrame
    coordinates: int


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    m = 25 + 75 * n * docs // max(1, terms)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES) -> Index:
    """The index, written in the shared folder.

    Null text counts as empty. Documents without terms are in no result and count nowhere. Rows without an id are documents with the id
    null; repeated rows are documents of their own. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def frequencies() -> pa.RecordBatch:
            names, df = pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([names, df, *(pa.nulls(len(names), f.type) for f in list(schema)[2:])], schema=schema)

        for batch, texts in slices(batches, 2):
            n, doc, code, tf, names = counted(texts)
            held.update(dict(zip(names, np.bincount(code, minlength=len(names)).tolist(), strict=True)))
            if len(held) > TERMS_HELD:
                yield frequencies()
            fold = folds(names, coordinates)
            key = doc * coordinates + fold[code]
            order = np.argsort(key, kind="stable")
            key, tf = key[order], tf[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            top = np.maximum.reduceat(tf, first) if len(first) else tf
            ends = np.searchsorted(key[first], np.arange(len(texts) + 1) * coordinates).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((key[first] % coordinates).astype(np.int16), top.astype(np.int32))]
            part = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.binary()), pa.nulls(len(texts), pa.int64()), batch.column(0), batch.column(1), pa.array(n), *lists], schema=schema)
            yield part.filter(pa.array(n > 0))
        if held:
            yield frequencies()

    schema = pa.schema([("term", pa.binary()), ("df", pa.int64()), ("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("at", pa.list_(pa.int16())), ("tf", pa.list_(pa.int32()))])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col))
    both = rows.mapInArrow(run, "term binary, df long, id long, text_hash long, n long, at array<short>, tf array<int>")
    both = materialize(both.withColumn("row", F.monotonically_increasing_id()), "search-index")
    sketches = both.where("term IS NULL").select("row", "id", "text_hash", "n", "at", "tf")
    frequencies = both.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(sketches, materialize(frequencies, "search-terms"), coordinates)


class Items:
    """A block of items: their terms, how often each item has each, and the terms' weights."""

    def __init__(self, texts: list[str | None], keys: list[int]):
        self.keys = np.array(keys, dtype=np.int64)
        _, item, code, count, names = counted(pa.array([t or "" for t in texts], pa.large_string()))
        self.number = {t: i for i, t in enumerate(names)}
        self.count = np.zeros((len(names), len(texts)), dtype=np.int64)
        self.count[code, item] = count

    def weigh(self, docs: int, terms: int, df: dict[bytes, int]) -> None:
        self.docs, self.terms = docs, terms
        w = np.array([weight(docs, df[t]) if t in df else 0 for t in self.number], dtype=np.int64)
        self.weights = self.count * w[:, None]

    def folded(self, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
        """The coordinates that the block's terms have, and their weights for each item."""
        at, row = np.unique(folds(self.number, coordinates), return_inverse=True)
        out = np.zeros((len(at), len(self.keys)), dtype=np.float64)
        np.add.at(out, row, self.weights)
        return at, out.astype(np.float32)


def bounds(index: Index, q: Items, least: np.ndarray, below: np.ndarray, most: int | None = None) -> DataFrame:
    """(item, row, id, text_hash, bound) of the documents whose bound for an item is positive, at least ``least`` and under ``below``.

    With ``most`` each task may leave out documents of which it has seen so many with larger bounds for the item.
    """
    coordinates = index.coordinates
    at, weights = q.folded(index.coordinates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(coordinates, -1, dtype=np.int64)
        place[at] = np.arange(len(at))
        floor, held, size = least.copy(), [], 0

        def squeezed() -> list[pa.Table]:
            t = pa.concat_tables(held)
            item, bound = np.asarray(t.column("item")), np.asarray(t.column("bound"))
            order = np.lexsort((-bound, item))
            first = np.searchsorted(item[order], np.arange(len(floor)))
            last = first + most - 1
            full = np.flatnonzero(last < np.append(first[1:], len(order)))
            floor[full] = np.maximum(floor[full], bound[order[last[full]]])
            return [t.filter(pa.array(bound >= floor[item]))]

        for whole in batches:
            for k in range(0, whole.num_rows, DOCS_AT_ONCE):
                b = whole.slice(k, DOCS_AT_ONCE)
                lists = b.column(4)
                doc = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(lists)).astype(np.int64))
                column = place[np.asarray(lists.flatten()).astype(np.int64)]
                hit = column >= 0
                doc, tf = doc[hit], np.asarray(b.column(5).flatten()).astype(np.int64)[hit]
                dense = np.zeros((b.num_rows, len(at)), dtype=np.float32)
                dense[doc, column[hit]] = impact(tf, np.asarray(b.column(3))[doc], q.docs, q.terms)
                up = (dense @ weights).astype(np.float64) * (1 + SINGLE_SLACK)
                d, i = np.nonzero((up >= floor) & (up < below) & (up > 0))
                part = pa.table([pa.array(i.astype(np.int32)), *(b.column(j).take(pa.array(d)) for j in range(3)), pa.array(up[d, i])], names=["item", "row", "id", "text_hash", "bound"])
                if most is None:
                    yield from part.to_batches()
                    continue
                held.append(part)
                size += len(d)
                if size > 2 * most * len(floor):
                    held = squeezed()
                    size = held[0].num_rows
        if held:
            yield from squeezed()[0].combine_chunks().to_batches()

    columns = index.sketches.select("row", "id", "text_hash", "n", "at", "tf")
    return columns.mapInArrow(run, "item int, row long, id long, text_hash long, bound double")


def exact(docs: DataFrame, pairs: DataFrame, q: Items, id_col: str, text_col: str) -> DataFrame:
    """(item, row, score) of the pairs (item, row, id, text_hash), from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 3):
            n, doc, code, tf, names = counted(texts)
            number = np.array([q.number.get(t, -1) for t in names], dtype=np.int64)[code]
            hit = number >= 0
            doc, number, part = doc[hit], number[hit], impact(tf[hit], n[doc[hit]], q.docs, q.terms)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            items = batch.column(2)
            row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(items)).astype(np.int64))
            item = np.asarray(items.flatten()).astype(np.int64)
            score = np.array([part[ends[r] : ends[r + 1]] @ q.weights[number[ends[r] : ends[r + 1]], i] for r, i in zip(row.tolist(), item.tolist(), strict=True)], dtype=np.int64)
            cols = [batch.column(j).take(pa.array(row)) for j in (0, 1)]
            yield pa.record_batch([*cols, pa.array(item.astype(np.int32)), pa.array(score)], names=["id", "text_hash", "item", "score"])

    # Copies under one id have one score; each document is read once for all items that ask for it.
    wanted = pairs.groupBy("id", "text_hash").agg(F.collect_set("item").alias("items"))
    wanted = bounded_broadcast(materialize(wanted, "search-wanted"), BROADCAST_ROWS).withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("id", "text_hash", "items", "text")
    scores = rows.mapInArrow(run, "id long, text_hash long, item int, score long").dropDuplicates(["id", "text_hash", "item"])
    p, s = pairs.alias("p"), scores.alias("s")
    same = (F.col("p.item") == F.col("s.item")) & F.col("p.id").eqNullSafe(F.col("s.id")) & (F.col("p.text_hash") == F.col("s.text_hash"))
    return p.join(s, same).where("s.score > 0").select("p.item", "p.row", "p.id", "s.score")


def first_ones(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each item: ranked in slices first, so that no item's rows meet in one task."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("rank", rank("item", F.pmod("row", F.lit(64)))).where(F.col("rank") <= k)
    return rows.withColumn("rank", rank("item")).where(F.col("rank") <= k)


def search_block(docs: DataFrame, index: Index, q: Items, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, rank, id, score): the k best documents of each item of the block; ``item`` is the row's key."""
    spark = docs.sparkSession
    total = index.sketches.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    names = spark.createDataFrame([(t,) for t in q.number], "term binary")  # the block's terms, not the table's
    q.weigh(total["docs"], total["terms"], {bytes(r["term"]): r["df"] for r in index.frequencies.join(F.broadcast(names), "term").collect()})
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    least, below = np.ones(len(q.keys)), np.full(len(q.keys), np.inf)
    best: list[DataFrame] = []

    def rescore(pairs: DataFrame) -> None:
        """Exact scores of more pairs; ``least`` becomes the k-th best score so far."""
        new = exact(docs, pairs, q, id_col, text_col)
        best[:] = [materialize(first_ones(reduce(DataFrame.unionByName, [*best, new]), k, *order).select("item", "row", "id", "score", "rank"), "search-best")]
        best[:] = [best[0].drop("rank")]
        for r in best[0].groupBy("item").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).collect():  # a row an item
            if r["n"] == k:
                least[r["item"]] = r["s"]

    seeds = materialize(first_ones(bounds(index, q, least, below, SEEDS), SEEDS, F.desc("bound"), F.asc("row")).drop("rank"), "search-seeds")
    for r in seeds.groupBy("item").agg(F.min("bound").alias("b")).collect():
        below[r["item"]] = r["b"]
    rescore(seeds)
    # Documents equal to the last seed's bound come again: what is scored already drops out by its row.
    rest = bounds(index, q, least, np.nextafter(below, np.inf), None).join(seeds.select("item", "row"), ["item", "row"], "left_anti")
    rest = materialize(rest, "search-rest")
    left = rest.count()
    while left:
        limits = spark.createDataFrame([(i, float(v), float((v + b) / 2 if left > PAIRS_AT_ONCE and b - v > 1 else v)) for i, (v, b) in enumerate(zip(least, below, strict=True))], "item int, least double, cut double")
        known = rest.join(F.broadcast(limits), "item").where("bound >= least")
        cuts = {r["item"]: r["cut"] for r in limits.collect()}
        rescore(materialize(known.where("bound >= cut").drop("least", "cut"), "search-batch"))
        below = np.array([cuts[i] for i in range(len(below))])
        rest = known.where("bound < cut").drop("least", "cut")
        left = rest.join(F.broadcast(spark.createDataFrame([(i, float(v)) for i, v in enumerate(least)], "item int, least double")), "item").where("bound >= least").count()
    keys = spark.createDataFrame([(i, int(r)) for i, r in enumerate(q.keys)], "item int, key long")
    ranked = best[0].withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.join(F.broadcast(keys), "item").select(F.col("key").alias("item"), "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index: Index | None = None) -> DataFrame:
    """item id, rank (int, from 1), document id, score (long): each item's k documents with the highest positive score, equal ones by
    ascending id, then as the table gives them.

    ``index`` is what ``build`` has made of the same documents. Items without terms, and null ones, have no rows; rows that repeat an item's
    id are items of their own. An empty table gives an empty result. Items are taken in blocks of at most ITEMS_AT_ONCE, one after the other.
    """
    index = index or build(docs, id_col, text_col)
    spark = docs.sparkSession
    numbered = items.select(F.col(item_col).alias("__item"), F.col(item_text).alias("__text"), F.monotonically_increasing_id().alias("item"))
    numbered = materialize(numbered.withColumn("block", F.expr(f"item div {ITEMS_AT_ONCE}")), "search-items")
    out = spark.createDataFrame([], "item long, rank int, id long, score long")
    for b in numbered.select("block").distinct().orderBy("block").collect():  # a row for each block
        rows = numbered.where(F.col("block") == b["block"]).orderBy("item").collect()  # at most ITEMS_AT_ONCE
        q = Items([r["__text"] for r in rows], [r["item"] for r in rows])
        if q.number:
            out = out.unionByName(search_block(docs, index, q, k, id_col, text_col))
    named = out.join(numbered.select("item", "__item"), "item")
    return named.select(F.col("__item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")

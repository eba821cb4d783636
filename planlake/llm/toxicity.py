"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over words and word beginnings; each later
model also sees the earlier categories' log-odds. While training, those are out-of-fold predictions, so later models
learn from figures of the quality they will meet. The models are fitted on a bounded sample of labelled rows
(MAX_LABELLED); features are those whose counts differ between the classes beyond chance (LEAST_G), counted
by Spark over the sample, and of those the MAX_FEATURES with the largest statistic: the bound of the model, not of what
is read. Scoring reads every word of every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.llm.segments import give_back, slices
from planlake.session import materialize

MAX_LABELLED = 20_000
MAX_FEATURES = 2_000
LEAST_G = 16.0
FOLDS = 5
SAMPLE_SLICE = 1 << 19
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
LONG_WORD = 64
WORD = re.compile(r"[^\s.,!?;:\"'()|%#$&*<>\[\]]+")
#: The chain: earlier categories first; each is a column of labels with the value that counts as positive.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def words_of(text: str) -> set[str]:
    """The distinct words in lower case; a word beyond LONG_WORD characters stands as its digest and its beginnings."""
    return {w if len(w) <= LONG_WORD else f"{w[: PREFIXES[-1] + 1]}~{hashlib.sha256(w.encode('utf-8', 'surrogatepass')).hexdigest()}" for w in WORD.findall(text.lower())}


def features(text: str) -> set[str]:
    """The distinct words of a text and, marked by *, the beginnings of longer ones."""
    words = words_of(text)
    return words | {f"{w[:n]}*" for n in PREFIXES for w in words if len(w) > n}


@dataclass
class Link:
    """One model of the chain: bias, weights of text features, weights of the earlier categories' log-odds."""

    bias: float
    weights: dict[str, float]
    earlier: np.ndarray


def fit(rows: np.ndarray, cols: np.ndarray, n: int, m: int, dense: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.3, l2: float = 0.5) -> np.ndarray:
    """Weights (bias, dense, sparse) of an L2 logistic model by AdaGrad on all rows; rows, cols: where the 0/1 matrix has ones."""
    k = 1 + dense.shape[1]
    full = np.concatenate([np.ones((n, 1)), dense], axis=1)
    w, moved = np.zeros(k + m), np.full(k + m, 1e-8)
    share = np.clip(y.mean() if n else 0.0, 1e-6, 1 - 1e-6)
    w[0] = np.log(share / (1 - share))
    for _ in range(steps if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-(full @ w[:k] + np.bincount(rows, w[k + cols], n))))
        g = np.concatenate([full.T @ (p - y), np.bincount(cols, (p - y)[rows], m)])
        g[1:] += l2 * w[1:]
        moved += g * g
        w -= rate * g / np.sqrt(moved)
    return w


def g_score(pos: Column, n: Column, all_pos: Column, all_n: Column) -> Column:
    """Likelihood-ratio statistic of a feature's 2 x 2 table."""
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    a, b = n * all_pos / all_n, n * (all_n - all_pos) / all_n
    return 2 * (term(pos, a) + term(n - pos, b) + term(all_pos - pos, all_pos - a) + term((all_n - all_pos) - (n - pos), (all_n - all_pos) - b))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, chain: tuple) -> DataFrame:
    """(id, features, one 0/1 column per category) of at most MAX_LABELLED labelled rows with distinct texts, written once."""
    flags = [F.max((F.col(c) == v).cast("int")).alias(name) for name, c, v in chain]
    known = labels.dropna(subset=[id_col, *[c for _, c, _ in chain]]).groupBy(F.col(id_col).cast("long").alias("id")).agg(*flags)
    known = known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(known), "id").withColumn("text_key", F.xxhash64("text"))
    names = [name for name, _, _ in chain]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in slices(batches, 1, SAMPLE_SLICE):
            found = [list(features(t)) for t in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), *batch.columns[2:]], names=["id", "features", *names])

    sample = sample.groupBy("text_key").agg(F.min("id").alias("id"), F.first("text").alias("text"), *[F.max(n).alias(n) for n in names])
    return materialize(sample.select("id", "text", *names).mapInArrow(split, "id long, features array<string>" + "".join(f", {n} int" for n in names)), "toxic-sample")


def chosen_features(sample: DataFrame, names: list[str], most: int = MAX_FEATURES) -> list[str]:
    """The at most ``most`` features with the largest statistic over all categories, LEAST_G at least; ties by name."""
    totals = sample.select(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    counts = sample.select(F.explode("features").alias("feature"), *names).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in names])
    scores = [g_score(F.col(x).cast("double"), F.col("n").cast("double"), F.lit(float(totals[x] or 0)), F.lit(float(totals["n"]))) for x in names]
    best = counts.select("feature", F.greatest(*scores, F.lit(0.0)).alias("g")).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "feature").limit(most)
    return [x["feature"] for x in best.collect()]


def fit_chain(rows: np.ndarray, cols: np.ndarray, m: int, labels: list[np.ndarray]) -> list[np.ndarray]:
    """The weights of each category's model, (bias, earlier categories' log-odds, features), in the order of the chain.

    Row i is in fold i % FOLDS; the log-odds that a later model is fitted on come from models fitted without that fold.
    """
    n = len(labels[0])
    fold = np.arange(n) % FOLDS
    dense, out = np.zeros((n, 0)), []
    for y in labels:
        w = fit(rows, cols, n, m, dense, y)
        out.append(w)
        if len(out) == len(labels):
            break
        k = 1 + dense.shape[1]
        held_out = np.zeros(n)
        for f in range(FOLDS):
            use, at = fold != f, fold[rows] != f
            place = np.cumsum(use) - 1
            v = fit(place[rows[at]], cols[at], int(use.sum()), m, dense[use], y[use])
            z = v[0] + dense @ v[1:k] + np.bincount(rows, v[k + cols], n)
            held_out[~use] = z[~use]
        dense = np.column_stack([dense, held_out])
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: tuple = CHAIN) -> list[Link]:
    """Fit the chain. labels: id and one column per category; rows with a null id or label are left out, a
    repeated id counts once with its largest labels, and repeated texts count once."""
    names = [name for name, _, _ in chain]
    sample = labelled_sample(docs, labels, id_col, text_col, chain)
    chosen = chosen_features(sample, names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(chosen, pa.string())
        for batch in batches:
            lists = batch.column(1)
            got = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists)))[got >= 0]
            got = got[got >= 0]
            order = np.lexsort((got, row))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at.astype(np.int32), got[order].astype(np.int32)), *batch.columns[2:]], names=["id", "numbers", *names])
        give_back()

    # What reaches the driver: ids, labels and the numbers of chosen features of at most MAX_LABELLED rows.
    data = sample.mapInArrow(number, "id long, numbers array<int>" + "".join(f", {n} int" for n in names)).toArrow()
    data = data.take(pc.sort_indices(data.column("id"))).combine_chunks()
    lists = data.column("numbers")
    rows = np.repeat(np.arange(data.num_rows), np.asarray(pc.list_value_length(lists)))
    cols = np.asarray(pc.list_flatten(lists)).astype(np.int64)
    weights = fit_chain(rows, cols, len(chosen), [np.asarray(data.column(x), dtype=float) for x in names])
    del data, lists, rows, cols
    give_back()
    return [Link(w[0], {f: v for f, v in zip(chosen, w[1 + k :], strict=True) if v}, w[1 : 1 + k]) for k, w in enumerate(weights)]


def scorer(links: list[Link]):
    """A function from texts to the log-odds of each category, an array of texts by categories."""
    known = set().union(*(link.weights for link in links))
    longer = {f[:-1] for f in known if f[-1:] == "*"}

    def run(texts: list[str]) -> np.ndarray:
        logits = np.zeros((len(texts), len(links)))
        for i, text in enumerate(texts):
            words = words_of(text)
            found = words & known
            found |= {f"{p}*" for n in PREFIXES for w in words if len(w) > n and (p := w[:n]) in longer}
            for k, link in enumerate(links):
                logits[i, k] = link.bias + link.earlier @ logits[i, :k] + sum(link.weights.get(f, 0.0) for f in sorted(found))
        return np.clip(logits, -50, 50)

    return run


def score(docs: DataFrame, links: list[Link], id_col: str = "doc_id", text_col: str = "text", chain: tuple = CHAIN, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, p_<category> of the chain, toxic (the last probability reaches the threshold).

    Null text counts as empty and gets the probabilities of a text without known features. Whole texts are read;
    other columns are ignored; repeated rows repeat; null ids stay null.
    """
    names = [f"p_{name}" for name, _, _ in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = scorer(links)
        for batch, part in slices(batches, 1):
            p = 1 / (1 + np.exp(-odds(part.to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(len(links))], pa.array(p[:, -1] >= threshold)], names=[id_col, *names, "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"{id_col} long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text the chain does not reject, all columns unchanged; rows with null ids are judged like others."""
    links = train(docs, labels, id_col, text_col)

    @F.arrow_udf("boolean")
    def rejected(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        odds = scorer(links)
        for column in texts:
            found = [odds(part.to_pylist())[:, -1] for _, part in slices(iter([pa.record_batch([column], names=["text"])]), 0)]
            yield pa.array(1 / (1 + np.exp(-np.concatenate([np.zeros(0), *found]))) >= threshold)

    # Only the text goes to Python; the rows stay in the JVM.
    return docs.where(~rejected(F.col(text_col)))

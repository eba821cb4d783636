"""Exact and near dedup, line dedup and mixing against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlake.llm import embedding_dedup, exact_dedup, line_dedup, mixing, ngram_join


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact(make_docs):
    texts = ["A b", "a B", None, "", "é", "É", "x", "x", "ıİ"]
    docs = make_docs(*texts, ids=[3, 9, 1, 2, 4, 5, None, 7, 8])
    groups = defaultdict(list)
    for r in docs.collect():
        groups[lower(r["text"])].append(r["doc_id"])
    got = exact_dedup.classify(docs).collect()
    assert len(got) == len(texts)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        v = sha[r["text_sha256"]]
        assert r["group_size"] == len(v) and r["keep_id"] == max(x for x in v if x is not None) and r["kept"] == (r["doc_id"] == r["keep_id"])
    kept = exact_dedup.dedup(docs.unionByName(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 7, 8, 9] and kept.columns == docs.columns
    assert exact_dedup.classify(docs.where("false")).count() == 0
    assert {r["keep_id"] for r in exact_dedup.classify(docs, keep="min").collect()} == {3, 1, 4, 5, 7, 8}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_near(make_docs):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n", "one", "One", "a b c d", "a b c d e", "A b\tc d  e"]
    for family in range(6):
        base = list(rng.choice(words, int(rng.integers(30, 250))))
        for _ in range(25):
            t = list(base)
            for _ in range(int(rng.integers(0, 9))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            texts.append(" ".join(t[int(rng.integers(0, 4)):]))
    texts += texts[-3:] + ["word " * 3000, "nospace" * 5000]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) > 100
    want = components(len(texts), links)
    docs = make_docs(*texts)
    got = ngram_join.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    kept = ngram_join.one_per_group(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in range(len(texts)) if want[i] == i) and kept.columns == docs.columns
    assert ngram_join.near_duplicates(docs.where("false")).count() == 0
    nulls = ngram_join.near_duplicates(make_docs("a b c d e", "a b c d e", ids=[None, 4])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in nulls} == {(None, None), (4, 4)}


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(400):
        n = int(rng.integers(1, 3000))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
        if rng.random() < 0.5:  # shingles that fall on one bit
            pool = np.unique(pool & np.uint64(0xFF000000000000FF))
        a, b = (np.sort(rng.choice(pool, int(rng.integers(0, min(n, len(pool)) + 1)), replace=False)) for _ in range(2))
        if rng.random() < 0.5:
            b = np.unique(np.concatenate([a[int(rng.integers(0, 9)) :], rng.choice(pool, 3)]))
        apart = len(np.setxor1d(a, b))
        assert len(np.setxor1d(ngram_join.sketch_bits(a), ngram_join.sketch_bits(b))) <= apart
        assert ngram_join.hamming(*(np.frombuffer(ngram_join.folded(x), dtype=np.uint8) for x in (a, b))) <= apart
        if apart:
            assert len(ngram_join.sketch_bits(a)) <= len(a)


def test_sketch_keys_cover_every_link():
    """Any two sets at the threshold or above share at least as many keys as both need."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        drop = int(rng.integers(0, n // 5 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        (ka, na), (kb, nb) = ngram_join.document_keys(a, 80), ngram_join.document_keys(b, 80)
        assert len(np.intersect1d(ka, kb)) >= max(na, nb)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    v = np.concatenate([base[rng.integers(12, size=300)] + rng.normal(scale=s, size=(300, 8)) for s in (0.05, 0.25)] + [base[:1]] * 20)
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    bad = [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0] * 7 + [float("nan")], 0), (903, [1.0] * 7 + [None], 0), (904, [1.0, 2.0], 0), (905, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rep int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    want = components(len(v), list(zip(*np.nonzero(s), strict=True)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (int(s[i].sum()), want[i], want[i] == i) for i in range(len(v))} | {i: (0, i, True) for i, _, _ in bad}
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_vectors_of_other_lengths_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(3)
    rows = []
    for dim, n in ((2, 90), (3, 160), (1, 4)):
        centre = rng.normal(size=(9, dim))
        rows += [[float(np.float32(x)) for x in centre[rng.integers(9)] * rng.uniform(0.5, 2) + rng.normal(scale=0.1, size=dim)] for _ in range(n)]
    ids = [int(x) if x >= 0 else None for x in rng.integers(-3, 60, size=len(rows))]
    df = spark.createDataFrame([(i, v, "x") for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<float>, node string")
    u = [np.array(v) / np.linalg.norm(v) for v in rows]
    links = [(i, j) for i in range(len(u)) for j in range(i) if len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.9]
    root = components(len(u), links)
    n = defaultdict(int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    least = defaultdict(list)
    for i, r in enumerate(root):
        least[r].append(ids[i])
    least = {r: min((x for x in v if x is not None), default=None) for r, v in least.items()}
    want = sorted(((ids[i], n[i], least[root[i]]) for i in range(len(u))), key=repr)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert got == want


def test_lines(make_docs):
    same = "job 17 took 35 ms on host a9"
    texts = [f"{'xyz'[i]} own words here\njob {i} took {i * 7} ms on host a{i}\n\nlast {w}" for i, w in enumerate(("one", "two", "three"))] + [None, "", same, "a b c d\ne"]
    docs = make_docs(*texts)
    got = {r["doc_id"]: r for r in line_dedup.clean(docs).collect()}
    assert got[0]["text"] == "x own words here\n\nlast one" and (got[0]["n_lines"], got[0]["n_dropped"]) == (4, 1)
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "" and got[6]["text"] == texts[6]
    assert line_dedup.clean(docs.where("false")).count() == 0
    # Lines that differ in one word out of ten are one template.
    names = make_docs(*[f"this page was kindly written for you by {n} today" for n in ("ann", "bob", "cyd", "dan")])
    assert [r["n_dropped"] for r in line_dedup.clean(names).collect()] == [1] * 4


def test_word_count(make_docs):
    texts = [None, "", " ", "a", " a\tb\n\n c\x0bd\x0ce\rf ", "x y", "é ü z", "a b"]
    got = [r["n"] for r in make_docs(*texts).orderBy("doc_id").select(mixing.word_count(F.col("text")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(make_docs, seed):
    rng = np.random.default_rng(seed)
    n = 600
    texts = [None if i % 97 == 0 else "w " * int(rng.lognormal(3, 1)) for i in range(n)]
    sources = [None if x > 0.9 else f"s{int(x * x * 12)}" for x in rng.random(n)]
    docs = make_docs(*texts, sources=sources)
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total = {}, sum(size.values())
    while True:  # reshare the excess until no target is above its cap
        rest = [s for s in order if s not in target]
        level = (total - sum(target.values())) / sum(weight[s] for s in rest)
        over = {s: 3 * size[s] for s in rest if level * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= over
    target |= {s: level * weight[s] for s in rest}
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + max(r["size"] for r in got if r["source"] == s)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.repeat_rows(docs).count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.where("false")).count() == 0
    # The planned rates are those of the tilt: one tilt a source, under which the source's words come to its target.
    rate = defaultdict(dict)
    for r in got:
        if r["size"]:
            rate[r["source"]][r["size"]] = r["rate"]
    for s, rates in rate.items():
        mean = size[s] / sum(1 for r in got if r["source"] == s and r["size"])
        tilts = [np.log(x) * mean / k for k, x in rates.items() if x < 3 - 1e-9]
        assert max(tilts, default=0) - min(tilts, default=0) < 1e-5
        assert sum(r["size"] * r["rate"] for r in got if r["source"] == s) == pytest.approx(target[s], rel=1e-5)
        assert all(abs(r["copies"] - r["rate"]) <= 2 for r in got if r["source"] == s)


def test_repeat_rows_gives_what_is_planned(make_docs):
    rng = np.random.default_rng(5)
    texts = ["w " * int(rng.integers(1, 6)) for _ in range(60)] + ["same text here"] * 30 + [None, ""]
    ids = [int(x) if x else None for x in rng.integers(0, 12, size=len(texts))]
    sources = [None if x > 0.8 else f"s{int(x * 5)}" for x in rng.random(len(texts))]
    docs = make_docs(*texts, ids=ids, sources=sources)
    key = lambda r: (r["doc_id"], r["source"], len((r["text"] or "").split()))
    plan, rows = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    for r in mixing.repeat_rows(docs).collect():
        rows[key(r)] += 1
    assert {k: v for k, v in plan.items() if v} == dict(rows) and sum(rows.values()) > 40


def test_workers_of_the_ngram_join_need_no_pandas():
    import subprocess
    import sys

    code = "import sys, planlake.llm.ngram_join; print('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "False"

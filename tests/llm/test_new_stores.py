"""Whitening, token files and ranked search against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from planlake.llm import embedding_whitening as white
from planlake.llm import sketch_search as search
from planlake.llm import token_files
from planlake.session import new_folder, scratch

ODD = [None, "", " ", "a  b", "<|endoftext|> x", "日本 語", "don't  I'll", "\r\n a", "word " * 3000, "longword" * 3000]


# ---- whitening


def whitened(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 7, 1.0) for i, v in rows], "vec_id long, embedding array<double>, n long, whitened double")
    return white.whiten(df, **options).collect()


def check_whitening(rows, got, k):
    """Against the dense covariance in numpy."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(0)
    centred = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > len(e) * np.finfo(float).eps * e[0]).sum()))
    want = centred @ u[:, :k] / np.sqrt(e[:k])
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["n"] == n and r["identity_error"] <= 1e-9 and r["residual"] <= 1e-11
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
    signs = None
    for (i, _), row, w in zip(kept, n * x - s, want, strict=True):
        mine = by[i, int((row * row).sum())]
        mine = np.array([mine[c][0] for c in range(1, k + 1)])
        signs = np.sign(mine * w) if signs is None else signs
        np.testing.assert_allclose(mine * signs, w, atol=1e-8)


def test_whitening_against_dense(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.normal(size=12) * np.linspace(3, 0.5, 12)]) for i in range(300)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, []), (902, [None] + [0.0] * 11), (903, [float("nan")] * 12), (904, [float("inf")] + [1.0] * 11)]
    check_whitening(rows, whitened(spark, rows, components=5), 5)
    check_whitening(rows, whitened(spark, rows), 32)


def test_whitening_of_low_rank_equal_and_no_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) * c for v in (4, -8, 2)] + [float(r.integers(9))]) for i, c in enumerate(range(40))]
    check_whitening(rows, whitened(spark, rows), 32)  # rank 2
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == [] == whitened(spark, [(1, [3.0])]) == whitened(spark, [])


def test_whitening_of_each_length_and_exact_deviations(spark):
    rows = [(i, [float(i), 1e2 * (i % 3)]) for i in range(20)] + [(100 + i, [float(i % 7)]) for i in range(9)]
    got = whitened(spark, rows)
    check_whitening(rows[:20], [r for r in got if r["vec_id"] < 100], 2)
    check_whitening(rows[20:], [r for r in got if r["vec_id"] >= 100], 1)
    big = np.array([[0, 3], [10**9, 7]])
    assert white.Centre(2, [10**9, 10]).deviation(big) == [10**18 + 16, 10**18 + 16] and white.Centre(20, [10**9, 10]).deviation(big * 1000)[1] is None
    assert {r["deviation"] for r in whitened(spark, [(i, [1e11 * i]) for i in range(3)])} == {None, 0}


def test_jacobi_davidson_with_restarts_and_multiple_values():
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 250)) * np.linspace(3, 1, 250) ** 2
    v, u, _ = white.jacobi_davidson(lambda w: x.T @ (x @ w), 250, 6)
    np.testing.assert_allclose(v, np.linalg.eigvalsh(x.T @ x)[::-1][:6], rtol=1e-12)
    np.testing.assert_allclose(u.T @ u, np.eye(6), atol=1e-12)
    a = np.diag([5.0] * 4 + [1.0] * 30)
    assert white.jacobi_davidson(lambda w: a @ w, 34, 7)[0] == pytest.approx([5.0] * 4 + [1.0] * 3)


# ---- token files


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [7], [0, 1, 2, 3], [5, 5, 9, 10**12], list(range(0, 9000, 3)), [0] * 2000 + [1 << 40]])
def test_elias_fano(values):
    e, end = token_files.EliasFano.loads(b"xx" + token_files.EliasFano.of(np.array(values, dtype=np.int64)).dumps() + b"tail", 2)
    i = np.arange(len(values))
    assert e.values(i).tolist() == values and e.values(i[::-3]).tolist() == values[::-3]
    for v in values[:: max(1, len(values) // 20)]:
        assert e.rank(v) == sum(x <= v for x in values) and e.rank(v - 1) == sum(x < v for x in values)
    assert end == 2 + 32 + len(e.low) + len(e.high)


def test_elias_fano_is_small():
    r = np.random.default_rng(5)
    v = np.sort(r.integers(0, 1 << 30, 50_000))
    assert 8 * len(token_files.EliasFano.of(v).dumps()) < (2.6 + math.log2((1 << 30) / 50_000)) * 50_000


def test_token_files_round_trip(spark, make_docs, paths, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "READ_IDS", 100)
    lib = Tokenizer.from_file(paths["byte"])
    ids = [5, -3, 8, None, 2, 2, 900_000_000_000, 1, None, 4]
    with scratch(spark):
        folder = new_folder(spark, "token-files")
        docs = make_docs(*ODD, ids=ids).repartition(3)
        token_files.write(docs, folder, paths["byte"])
        got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
        manifest = spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()
        own = [lib.encode(t or "", add_special_tokens=False).ids + [0] for t in ODD]
        crc = [zlib.crc32(np.array(o, "<u4").tobytes()) for o in own]
        assert [r["doc_id"] for r in got] == [None, None, -3, 1, 2, 2, 4, 5, 8, 900_000_000_000]
        assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or 0, len(o), c) for i, o, c in zip(ids, own, crc, strict=True))
        assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
        # single documents by random access
        base = 0
        for m in manifest:
            shard = token_files.Shard(folder, m["name"])
            for i in range(shard.n):
                a, b = (int(x[0]) for x in shard.bounds(np.array([i])))
                assert zlib.crc32(shard.ids(a, b).astype("<u4").tobytes()) in crc
                assert shard.document_at(a) == i == shard.document_at(b - 1)
            base += m["n_ids"]
        assert base == sum(map(len, own))


def test_token_files_of_nothing(spark, make_docs, paths):
    with scratch(spark):
        folder = new_folder(spark, "token-files")
        token_files.write(make_docs("a").where("false"), folder, paths["byte"])
        assert token_files.read(spark, folder).collect() == []


# ---- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    """Every item's score with every document, by hand: (item, rank, doc, score)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, coordinates=None, **options):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, row long, score long").repartition(3)
    if coordinates:
        options["index"] = search.build(d, coordinates=coordinates)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.search(d, q, **options).collect()), key=repr)


@pytest.mark.parametrize(("coordinates", "seeds", "pairs"), [(4096, 64, 200_000), (16, 3, 5)])
def test_search_against_brute_force(spark, monkeypatch, coordinates, seeds, pairs):
    monkeypatch.setattr(search, "SEEDS", seeds)
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(search, "ITEMS_AT_ONCE", 4)
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["É", "日本語", "Straße", "K", "k", "\x80x"]
    docs = [(i, " ".join(r.choice(words[: r.randint(2, 66)]) for _ in range(r.randint(0, 80)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(15)] + [(7, docs[7][1]), (8, "w1 w2 other"), (None, docs[9][1]), (300, None), (301, ""), (302, "--- !"), (303, "w5 " * 3000 + "w6")]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 9)))) for i in range(6)] + [(50, "w5 w5 W5"), (50, docs[3][1]), (51, None), (52, " . "), (53, "nowhere"), (None, "w1")]
    assert searched(spark, docs, items, coordinates) == ranked(docs, items)


def test_search_in_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == searched(spark, [(1, "a")], []) == searched(spark, [(1, None), (2, "..")], [(1, "a")]) == []


def test_sketches_never_lie_below_the_score():
    import pyarrow as pa

    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 2) for _ in range(r.randint(1, 30))) for _ in range(40)]
    n, doc, code, tf, names = search.counted(pa.array(texts))
    for i, t in enumerate(texts):
        assert n[i] == len(terms(t))
        assert {names[c].decode(): int(f) for c, f in zip(code[doc == i], tf[doc == i], strict=True)} == dict(Counter(terms(t)))


def test_terms_of_the_slices_of_a_batch():
    import pyarrow as pa

    from planlake.llm.segments import slices

    texts = ["Éa Bb", "CC dd cc", "", "x Y", "zZ"]
    batch = pa.record_batch([pa.array(texts)], names=["text"])  # as Spark gives it: slices become large strings later
    got = [(names[c].decode(), int(d)) for _, part in slices(iter([batch]), 0, 4) for doc, code, names in [search.terms_of(part)] for d, c in zip(doc, code, strict=True)]
    assert [t for t, _ in got] == [t for text in texts for t in terms(text)]
    n = [k for _, part in slices(iter([batch]), 0, 4) for k in search.counted(part)[0].tolist()]
    assert n == [len(terms(t)) for t in texts]


def test_packing_without_the_cache_gives_the_same_pieces(spark, paths, monkeypatch):
    from planlake.llm import packing

    monkeypatch.setattr(packing, "SMALL_SLICE", 50)  # many slices a batch
    docs = spark.createDataFrame([(i, f"Some words {i} " * (i % 7 * 9)) for i in range(30)] + [(40, None)], "doc_id long, text string").coalesce(1)
    rows = [sorted(tuple(r) for r in packing.pack(docs, paths["byte"], longest=64, keep_cache=k).drop("sequence_id").collect()) for k in (True, False)]
    assert rows[0] == rows[1] and len(rows[0]) > 30

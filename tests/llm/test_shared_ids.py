"""Near dedup where different texts have one id: each text is linked by its own set."""

from planlake.llm import ngram_join


def text(name, change=None):
    return " ".join(f"{name}{i}" if i != change else "other" for i in range(80))


def test_texts_of_one_id_are_linked_each_by_its_text(make_docs):
    texts = [text("a"), text("b"), text("c"), text("a", 3), text("b", 5), text("c", 7), text("d")]
    docs = make_docs(*texts, ids=[5, 5, 5, 6, 7, 3, 6])
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (5, 5), (6, 5), (6, 6), (7, 5)]
    kept = ngram_join.one_per_group(docs)
    assert sorted((r["doc_id"], r["text"][0]) for r in kept.collect()) == [(3, "c"), (5, "a"), (5, "b"), (6, "d")]

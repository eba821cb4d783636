import public_tokenizers
import pytest

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def paths():
    return {"byte": BYTE, "piece": PIECE}


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(*texts, sources=None, ids=None):
        rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else "s", 0, f"x{i}") for i, t in enumerate(texts)]
        # extra columns with names that operators use inside
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string").withColumnRenamed("node", "keep_id")

    return make

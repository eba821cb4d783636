"""Token counts by prefix dynamic programming over a sentencepiece BPE model.

counts[i] is the exact number of tokens of the first i + 1 code points, so budgets and truncations at any character are
lookups and nothing is encoded again. A prefix that ends inside a word has the tokens of the words before it
and those of the word's head, so the row of a text is put together from the rows of its words, each distinct word
worked out once. Heads of words up to SHORT code points are counted by the library. For longer words the rows come from
dynamic programming over prefixes: the last token of a prefix is the one vocabulary piece t for which the
prefix without t ends in a token that stays apart from t; its count is one more than that prefix's. So a text without
spaces takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlake.llm.segments import Coder, join_words, slices

SHORT = 24
SLICE = 2 << 20
SPACE = "▁"
MAX_PAIRS = 200_000


class PieceHeads:
    """Rows of head counts by a sentencepiece BPE model, which marks spaces with U+2581 and puts one before the text."""

    odd = r"  |^ "
    cut = re.compile(r"(?<=[^ ])(?= )")
    apart = True  # after a space a row also counts the space

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        pieces = [lib.id_to_piece(i) for i in ids]
        if any(re.search("[^▁]▁", p) for p in pieces) or b"identity" not in lib.serialized_model_proto()[-4000:]:
            raise ValueError("this model joins words or rewrites characters; its texts can't be cut at spaces")
        self.score = {p: lib.get_score(i) for i, p in zip(ids, pieces, strict=True) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        self.longest = max(map(len, self.score))
        self.stays: dict[tuple[str, str], bool] = {}

    def prepare(self, texts: pa.Array) -> pa.Array:
        return pc.replace_substring(texts, SPACE, " ")

    def encode(self, words: list[str], later: bool) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all words one after the other, and each one's length; ``later`` words begin with a space of one token."""
        column = pa.array(words, pa.string())
        n = np.asarray(pc.utf8_length(column)).astype(np.int64)
        lens = n + later
        start = np.cumsum(lens) - lens + later
        rows = np.ones(int(lens.sum()), dtype=np.uint32)
        heads, places = [], []
        for k in range(1, SHORT + 1):
            at = np.flatnonzero((n >= k) & (n <= SHORT))
            heads.append(pc.utf8_slice_codeunits(column.take(pa.array(at)), 0, k))
            places.append(start[at] + k - 1)
        coded = pa.concat_arrays(heads).dictionary_encode()
        names = coded.dictionary.to_pylist() if pc.any(pc.match_substring(coded.dictionary, " ")).as_py() else join_words(coded.dictionary)
        got = self.lib.encode(names, num_threads=1, add_bos=False, add_eos=False)
        rows[np.concatenate(places)] = np.fromiter(map(len, got), dtype=np.uint32, count=len(got))[np.asarray(coded.indices)]
        for i in np.flatnonzero(n > SHORT).tolist():
            rows[start[i] : start[i] + n[i]] = self.long_row(words[i])
        return rows, lens

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text without the leading mark: the best-scored neighbours are merged first, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True))))
            if best[0] == -np.inf:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart_from(self, left: str, right: str) -> bool:
        """Do two tokens stay as they are when they stand side by side?"""
        key = (left, right)
        if key not in self.stays:
            if len(self.stays) > MAX_PAIRS:
                self.stays.clear()
            self.stays[key] = self.merged(left + right) == [left, right]
        return self.stays[key]

    def long_row(self, word: str) -> list[int]:
        text = SPACE + word.replace(" ", SPACE)
        last, count = [""], [0]
        for i in range(1, len(text) + 1):
            for n in range(min(self.longest, i), 0, -1):
                t = text[i - n : i]
                if (n == 1 or t in self.score) and (i == n or self.apart_from(last[i - n], t)):
                    last.append(t)
                    # A character the model doesn't have counts as its bytes.
                    count.append(count[i - n] + (1 if t in self.score else len(t.encode())))
                    break
        return count[2:]


@lru_cache(maxsize=1)
def heads_coder(path: str) -> Coder:
    """The coder of this worker process, loaded once."""
    return Coder(PieceHeads(path))


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = ()) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), counts array<int>, and fitting_<budget> for each budget.

    counts[i] is the exact token count of the first i + 1 code points; fitting_<budget> is the number of code points of the
    longest prefix of at most so many tokens. Null text counts as empty: no tokens, 0 bytes, an empty row.
    Whole texts are read, whatever their length; other columns are ignored; repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = heads_coder(path)
        for batch, texts in slices(batches, 1, SLICE):
            at, codes = c.slice_codes(texts)
            size = c.size[codes]
            # A word's whole count is the last number of its row; an empty first word has none.
            whole = np.where(size > 0, c.pool[np.maximum(c.start[codes] + size - 1, 0)], 0).astype(np.int64)
            before = np.cumsum(whole) - whole
            before -= np.repeat(np.append(before, 0)[at[:-1]], np.diff(at))
            counts = (c.rows(codes) + np.repeat(before, size)).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(size)])[at]
            cols = [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.ListArray.from_arrays(ends.astype(np.int32), counts)]
            for b in budgets:
                fits = np.flatnonzero(counts <= b)
                last = np.searchsorted(fits, ends[1:]) - 1
                place = np.where(last >= 0, fits[last] + 1, 0) if len(fits) else np.zeros(len(last), dtype=np.int64)
                cols.append(pa.array(np.maximum(place - ends[:-1], 0)))
            yield pa.record_batch(cols, names=names)

    names = [id_col, "n_bytes", "counts", *[f"fitting_{b}" for b in budgets]]
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"{id_col} long, n_bytes long, counts array<int>" + "".join(f", fitting_{b} long" for b in budgets))


def n_tokens() -> Column:
    """All tokens of the text."""
    return F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0)).cast("long")


def count_at(length: Column | int) -> Column:
    """Tokens of the first ``length`` code points; null beyond the text's end."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.when(n == 0, F.lit(0)).otherwise(F.get("counts", n.cast("int") - 1)).cast("long")

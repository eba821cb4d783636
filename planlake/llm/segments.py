"""Tokenizing through segments: a text is cut where no token can lie across, and each distinct segment is encoded once.

Both tokenizer kinds used here never join a non-space character and a following space in one token, so
a text may be cut before every space that follows a non-space character, and the encodings of the pieces
concatenate to the encoding of the text. Words repeat, so a task encodes far less text than it reads.
The ids come from the tokenizer library; only the cutting and the lookups are done here.
"""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 3 << 20
MAX_CACHED = 300_000
JOINED = 256
AT_ONCE = 16


def join_words(words: pa.Array) -> list[str]:
    """Words without spaces as Python strings; one decoding of all is much cheaper than one of each."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), " ")[0].as_py().split(" ")


class ByteBpe:
    """Rows of token ids by a byte-level BPE file of the tokenizers library."""

    #: a space after any kind of white space is not a cut
    odd = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}] "
    cut = re.compile(r"(?<=\S)(?= )")
    blank_end = r"^$|[\s\x{1c}-\x{1f}\x{85}\p{Z}]$"
    apart = True  # a word is encoded differently after a space

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        n = self.lib.get_vocab_size()
        # In the byte-level alphabet each character of a token is one byte; added tokens are plain text.
        added = {i: t.content for i, t in self.lib.get_added_tokens_decoder().items()}
        self.bytes_of = np.array([len(added[i].encode()) if i in added else len(self.lib.id_to_token(i) or "") for i in range(n)], dtype=np.int64)

    def prepare(self, texts: pa.Array) -> pa.Array:
        return texts

    def encode(self, words: list[str], later: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has; ``later`` words have a space before them, and many are encoded together."""
        if not later:
            rows = [np.array(e.ids, dtype=np.uint32) for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]
            return np.concatenate(rows), np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        column = pa.array(words, pa.large_string())
        size = np.asarray(pc.binary_length(column), dtype=np.int64) + 1
        # Two words may be joined where the left one ends in a character that is not white space.
        stops = np.flatnonzero(np.asarray(pc.match_substring_regex(column, self.blank_end))) + 1
        at = np.union1d(np.arange(0, len(words), JOINED), stops[stops < len(words)]).tolist()
        joined = [" " + " ".join(words[i:j]) for i, j in zip(at, [*at[1:], len(words)], strict=True)]
        # The library's results are much larger than their ids: a few at a time.
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for i in range(0, len(joined), AT_ONCE) for e in self.lib.encode_batch_fast(joined[i : i + AT_ONCE], add_special_tokens=False)])
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size), side="right")
        return ids, np.diff(ends, prepend=0)


class Coder:
    """Rows of numbers (token ids, or what else ``kind`` makes) of the segments of texts.

    Distinct segments are kept; beyond MAX_CACHED of them, those that only one slice has met are forgotten.
    """

    def __init__(self, kind: object):
        self.kind = kind
        self.forget()

    def forget(self) -> None:
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {} if self.kind.apart else self.first
        self.pool, self.used, self.n = np.zeros(1 << 20, dtype=np.uint32), 0, 0
        self.start, self.size, self.met = (np.zeros(1 << 17, dtype=t) for t in (np.int64, np.int64, np.int32))

    def make_room(self) -> None:
        """Keep the segments that several slices have met, if they are few enough."""
        keep = np.flatnonzero(self.met[: self.n] > 1)
        if len(keep) > MAX_CACHED // 2:
            return self.forget()
        place = np.full(self.n, -1, dtype=np.int64)
        place[keep] = np.arange(len(keep))
        pool, size = self.rows(keep), self.size[keep]
        kept = [{w: k for w, i in d.items() if (k := int(place[i])) >= 0} for d in (self.first, self.later)]
        self.forget()
        self.first, self.later = kept if self.kind.apart else (kept[0], kept[0])
        self.add(pool, size)

    def add(self, rows: np.ndarray, lens: np.ndarray) -> None:
        n, m = self.n, len(lens)
        while self.used + len(rows) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + m > len(self.start):
            self.start, self.size, self.met = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size, self.met))
        self.pool[self.used : self.used + len(rows)] = rows
        self.start[n : n + m] = self.used + np.cumsum(lens) - lens
        self.size[n : n + m] = lens
        self.used, self.n = self.used + len(rows), n + m

    def numbers(self, words: list[str], later: bool) -> np.ndarray:
        """The numbers of the words in start and size."""
        known = self.later if later else self.first
        got = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        lacking = np.flatnonzero(got < 0).tolist()
        if lacking:
            new = list(dict.fromkeys(words[i] for i in lacking))
            known.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.add(*self.kind.encode(new, later))
            got[lacking] = [known[words[i]] for i in lacking]
        return got

    def slice_codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(where each text's segments start, with the end; the number of each segment)."""
        if self.n > MAX_CACHED:
            self.make_room()
        texts = self.kind.prepare(texts)
        odd = np.asarray(pc.match_substring_regex(texts, self.kind.odd))
        words = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, " ")
        ends = words.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        names = join_words(coded.dictionary)
        lead = ends[:-1][np.diff(ends) > 0]
        rest = np.ones(len(at), dtype=bool)
        rest[lead] = False
        codes = np.zeros(len(at), dtype=np.int64)
        for later, own in ((False, at[lead]), (True, at[rest])):
            used = np.unique(own)
            table = np.zeros(len(names), dtype=np.int64)
            table[used] = self.numbers([names[i] for i in used.tolist()] if len(used) < len(names) else names, later)
            codes[rest if later else lead] = table[own]
        if odd.any():
            rows = np.split(codes, ends[1:-1])
            for i in np.flatnonzero(odd).tolist():
                head, *others = self.kind.cut.split(texts[i].as_py())
                rows[i] = np.concatenate([self.numbers([head], False), self.numbers([s[1:] for s in others], True)])
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            codes = np.concatenate(rows)
        self.met[np.unique(codes)] += 1
        return ends, codes

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The rows of segments one after the other."""
        lens = self.size[codes]
        total = int(lens.sum())
        shift = self.start[codes] - (np.cumsum(lens) - lens)
        if total + self.used < 1 << 31:  # half the memory
            return self.pool[np.repeat(shift.astype(np.int32), lens) + np.arange(total, dtype=np.int32)]
        return self.pool[np.repeat(shift, lens) + np.arange(total)]


@lru_cache(maxsize=1)
def byte_coder(path: str) -> Coder:
    """The coder of this worker process, loaded once."""
    return Coder(ByteBpe(path))


@lru_cache(maxsize=1)
def _c_library() -> ctypes.CDLL | None:
    lib = ctypes.CDLL(None)
    return lib if hasattr(lib, "malloc_trim") else None


def give_back() -> None:
    """At a task's end: the worker serves other operators next, so memory that is kept for reuse goes back to the system."""
    pa.default_memory_pool().release_unused()
    if lib := _c_library():
        lib.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut to about ``most`` bytes of text (a single text may be longer), with the text column, null as empty."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right")))
            part = batch.slice(i, j - i)
            yield part, pc.fill_null(part.column(text), "").cast(pa.large_string())
            i = j
        batch = part = None
    give_back()

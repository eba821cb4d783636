"""64-bit word and shingle hashes of whole texts in numpy, a few megabytes of bytes at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            p = np.full(max(n, CHUNK + 1), b, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def _hash_bytes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words in bytes that begin and end at word boundaries."""
    low = LOWER[raw]
    gap = SPACE[raw]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in lower-case A-Z, where each text's words start, with the end)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    found, counts = [], np.zeros(len(texts), dtype=np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        part = raw[offsets[i] : offsets[j]]
        if j == i + 1:  # one text, perhaps a long one: cut it at white space
            at = 0
            while at < len(part):
                to = min(len(part), at + CHUNK)
                while to < len(part) and not SPACE[part[to]]:
                    to += 1
                h = _hash_bytes(part[at:to])
                found.append(h)
                counts[i] += len(h)
                at = to
        else:
            # a space between texts keeps their words apart
            sep = np.insert(part, offsets[i + 1 : j] - offsets[i], 32)
            h = _hash_bytes(sep)
            starts = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[sep]]).astype(np.int8)) == -1)
            ends = offsets[i + 1 : j + 1] - offsets[i] + np.arange(j - i)
            counts[i:j] = np.diff(np.searchsorted(starts, ends), prepend=0)
            found.append(h)
        i = j
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(texts: pa.LargeStringArray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, where each text's start, with the end).

    A text with fewer words than a shingle has one shingle, its whole sequence; a text without words has none.
    """
    h, at = word_hashes(texts)
    n = np.diff(at)
    roll = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
    for k in range(words):
        roll = roll * STEP + h[k : k + len(roll)]
    roll = mix(roll)
    sets = []
    for a, m in zip(at[:-1].tolist(), n.tolist(), strict=True):
        if m >= words:
            sets.append(np.unique(roll[a : a + m - words + 1]))
        elif m:
            short = np.full(1, m, dtype=np.uint64)
            for k in range(a, a + m):
                short = short * STEP + h[k]
            sets.append(mix(short))
        else:
            sets.append(roll[:0])
    return np.concatenate(sets) if sets else roll[:0], np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)

"""Personal data: fixed rules, and a linear-chain CRF over word shapes that adds spans the rules miss.

Tokens are runs of characters other than white space and the marks , ; | = { } " : / <>. A token's features are its shape (digits
kept by number, letters folded, other ASCII characters kept), and the shapes of its neighbours. Only a token that has a
digit or an at sign can be part of a span; this structural rule holds in training and decoding. It makes every other
token O, so the best path of a whole text is found exactly by decoding the runs of such tokens one by one: they
are decoded by Viterbi in padded numpy batches, whatever the length of the text.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.llm.segments import slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number's match can only begin where its digits begin: the look-behind saves trying every later digit.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
MARK = re.compile(r"[0-9@]")
GAP = re.compile(r"[ \t-\r,;|={}\":/<>]")
SPACES = re.compile(r"[ \t-\r]*")
# No kind has more digits than this, and a token of a span has a digit at least.
MOST_TOKENS = 19
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed rules by kind, then start: leftmost, non-overlapping within a kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def shape(token: str) -> str:
    """The word shape of the whole token: W without digit and at sign; else digit runs as their length (20 at most), letter runs as a, the rest as is."""
    if not MARK.search(token):
        return "W"
    s = re.sub(r"[^\W\d_]+", "a", token)
    s = re.sub(r"[0-9]+", lambda m: str(min(20, len(m[0]))), s)
    return re.sub(r"[^\x21-\x7e]", "u", s).rstrip(".!?'*#%&$")


def labelled_rows(n: int = 600, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The small labelled table: rows of (token, label) made from patterns of personal data and of look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    a = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    h = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    makers = [
        ("email", lambda: f"{a(4)}.{d(2)}@{a(4)}{d(1)}.{a(7)}.com"),
        ("email", lambda: f"{a(5)}@{a(6)}.org"),
        ("email", lambda: f"{a(5)}_{a(3)}@{a(6)}.org"),
        ("email", lambda: f"{a(5)}@[{d(2)}.{d(1)}.{d(3)}.{d(2)}]"),
        ("ip", lambda: f"{d(2)}.{d(3)}.{d(2)}.{d(3)}"),
        ("ip", lambda: f"{d(3)}.{d(2)}.{d(1)}.{d(2)}"),
        ("card", lambda: d(16)),
        ("card", lambda: d(15)),
        ("card", lambda: " ".join(d(4) for _ in range(4))),
        ("card", lambda: "-".join(d(4) for _ in range(4))),
        ("phone", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}"),
        ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}"),
        ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}"),
        ("phone", lambda: f"+{d(2)} {d(3)} {d(4)} {d(3)}"),
        ("phone", lambda: f"({d(3)}){d(3)}-{d(4)}"),
        ("phone", lambda: f"{d(1)}-{d(3)}-{d(3)}-{d(4)}"),
        ("phone", lambda: f"{d(3)}.{d(3)}.{d(4)}"),
        ("phone", lambda: f"{d(4)}-{d(7)}"),
        ("phone", lambda: f"{d(3)} {d(3)}-{d(4)}"),
        ("phone", lambda: f"{d(3)} {d(3)} {d(4)}"),
        ("card", lambda: f"{d(4)} {d(6)} {d(5)}"),
        ("card", lambda: f"{d(4)}-{d(6)}-{d(5)}"),
        ("O", lambda: h(40)),
        ("O", lambda: h(18)),
        ("O", lambda: "AKIA" + h(16).upper()),
        ("O", lambda: f"{d(1)}.{d(1)}."),
        ("O", lambda: f"{d(1)}."),
        ("O", lambda: d(4)),
        ("O", lambda: f"{d(2)}%"),
        ("O", lambda: f"{d(4)}-{d(2)}-{d(2)}"),
        ("O", lambda: d(2)),
        ("O", lambda: d(3)),
        ("O", lambda: f"{d(4)} {d(4)}"),
        ("O", lambda: f"{d(2)} {d(2)} {d(4)}"),
        ("O", lambda: f"${d(2)}.{d(2)}"),
        ("O", lambda: f"v{d(1)}.{d(1)}.{d(1)}"),
        ("O", lambda: f"@{a(6)}"),
        ("O", lambda: f"{a(3)}{d(1)}"),
        ("O", lambda: f"{d(5)} {d(5)} {d(3)}"),
        ("O", lambda: d(9)),
        ("O", lambda: f"{d(3)}-{d(2)}"),
    ]
    rows = []
    for i in range(n):
        kind, make = makers[i % len(makers)]
        words = [(a(r.randint(2, 8)), "O") for _ in range(r.randint(0, 3))]
        rows.append(words + [(t, kind) for t in make().split(" ")] + [(a(r.randint(2, 8)), "O") for _ in range(r.randint(0, 2))])
    return rows


class Crf:
    """A linear-chain CRF: score = sum of cur[shape_t, y_t] + prev[shape_t-1, y_t] + next[shape_t+1, y_t] + trans[y_t-1, y_t]."""

    states = ("O", *KINDS)

    def __init__(self, shapes: dict[str, int], weights: dict[str, np.ndarray]):
        self.shapes, self.w = shapes, weights

    def number(self, s: str) -> int:
        return self.shapes.get(s, 1)  # 0: W, 1: any other unknown shape, 2: the text's edge

    def emissions(self, ids: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        e = self.w["cur"][ids] + self.w["prev"][before] + self.w["next"][after]
        e[ids == 0, 1:] = -np.inf
        return e

    def viterbi(self, e: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Best states for a padded batch e[n, t, state] between O on both sides."""
        n, most, _ = e.shape
        trans = self.w["trans"]
        score, back = e[:, 0] + trans[0], np.zeros((n, most, len(self.states)), dtype=np.int8)
        ends = np.where((lens == 1)[:, None], score + trans[:, 0], -np.inf)
        for t in range(1, most):
            step = score[:, :, None] + trans[None]
            back[:, t] = step.argmax(1)
            score = step.max(1) + e[:, t]
            ends = np.where((lens == t + 1)[:, None], score + trans[:, 0], ends)
        path = np.zeros((n, most), dtype=np.int8)
        state = ends.argmax(1).astype(np.int8)
        for t in range(most - 1, -1, -1):
            live = lens > t
            path[live, t] = state[live]
            state = np.where(live, back[np.arange(n), t, state], state).astype(np.int8)
        return path


def train(rows: list[list[tuple[str, str]]], steps: int = 250, rate: float = 0.5, l2: float = 1e-3) -> Crf:
    """Fit by full-batch gradient ascent on the penalised log-likelihood (forward-backward in numpy)."""
    shapes = {"W": 0, "?": 1, "^": 2}
    for row in rows:
        for token, _ in row:
            shapes.setdefault(shape(token), len(shapes))
    n, most, k = len(rows), max(map(len, rows)), len(Crf.states)
    ids = np.full((n, most), 2)
    y = np.zeros((n, most), dtype=int)
    lens = np.array([len(r) for r in rows])
    for i, row in enumerate(rows):
        ids[i, : len(row)] = [shapes[shape(t)] for t, _ in row]
        y[i, : len(row)] = [Crf.states.index(label) for _, label in row]
    live = np.arange(most) < lens[:, None]
    before, after = np.pad(ids, ((0, 0), (1, 0)), constant_values=2)[:, :-1], np.pad(ids, ((0, 0), (0, 1)), constant_values=2)[:, 1:]
    w = {"cur": np.zeros((len(shapes), k)), "prev": np.zeros((len(shapes), k)), "next": np.zeros((len(shapes), k)), "trans": np.zeros((k, k))}
    model, moved = Crf(shapes, w), {f: np.full_like(v, 1e-8) for f, v in w.items()}
    gold = np.eye(k)[y] * live[:, :, None]
    log_sum = lambda x, axis: np.log(np.exp(x - (m := x.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
    for _ in range(steps):
        e = model.emissions(ids.ravel(), before.ravel(), after.ravel()).reshape(n, most, k)
        e = np.where(np.isneginf(e), -1e9, e)
        e[~live] = np.where(np.arange(k) == 0, 0.0, -1e9)
        tr = w["trans"]
        fwd, bwd = [e[:, 0] + tr[0]], [np.zeros((n, k)) + tr[:, 0]]
        for t in range(1, most):
            fwd.append(log_sum(fwd[-1][:, :, None] + tr, 1) + e[:, t])
        for t in range(most - 2, -1, -1):
            bwd.append(log_sum(tr[None] + (e[:, t + 1] + bwd[-1])[:, None, :], 2))
        f, b = np.stack(fwd, 1), np.stack(bwd[::-1], 1)
        z = log_sum(f[:, -1] + b[:, -1], 1)
        node = np.exp(f + b - z[:, None, None]) * live[:, :, None]
        pair = np.exp(f[:, :-1, :, None] + tr + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        off = gold - node
        g = {name: np.zeros_like(w[name]) for name in w}
        for name, at in (("cur", ids), ("prev", before), ("next", after)):
            np.add.at(g[name], at.ravel(), off.reshape(-1, k))
        g["trans"] = np.einsum("ntj,ntk->jk", gold[:, :-1] * live[:, 1:, None], gold[:, 1:]) - pair.sum((0, 1))
        for name in w:
            g[name] = g[name] / n - l2 * w[name]
            moved[name] += g[name] ** 2
            w[name] += rate * g[name] / np.sqrt(moved[name])
    return model


def crf_spans(texts: list[str], model: Crf) -> list[list[tuple[str, list[tuple[int, int]]]]]:
    """What the model marks in each text: a kind and the neighbouring tokens (start, end) that have it."""
    runs: list[tuple[int, list[tuple[int, int]], list[int]]] = []
    known: dict[str, int] = {}
    for doc, text in enumerate(texts):
        m, last, run = MARK.search(text), -2, []
        tokens: list[tuple[int, int]] = []
        while m:
            start = m.start()
            while start and not GAP.match(text, start - 1):
                start -= 1
            stop = GAP.search(text, m.end())
            end = stop.start() if stop else len(text)
            tokens.append((start, end))
            m = MARK.search(text, end)
        for start, end in tokens:
            token = text[start:end]
            if (number := known.get(token)) is None:
                number = model.number(shape(token))
                if end - start <= 64:  # longer ones hardly repeat
                    if len(known) > 100_000:
                        known.clear()
                    known[token] = number
            if run and SPACES.match(text, last).end() == start:
                run.append((start, end))
                runs[-1][2].append(number)
            else:
                run = [(start, end)]
                runs.append((doc, run, [number]))
            last = end
    out: list[list[tuple[str, list[tuple[int, int]]]]] = [[] for _ in texts]
    by_length: dict[int, list[int]] = {}
    for i, (_, run, _) in enumerate(runs):
        by_length.setdefault(len(run).bit_length(), []).append(i)
    for members in by_length.values():
        step = max(1, 2_000_000 // (25 << len(runs[members[0]][1]).bit_length()))
        for lo in range(0, len(members), step):
            part = [runs[i] for i in members[lo : lo + step]]
            lens = np.array([len(ids) for _, _, ids in part])
            ids = np.zeros((len(part), lens.max()), dtype=int)
            for row, (_, _, got) in zip(ids, part, strict=True):
                row[: len(got)] = got
            # Beyond a run there is a W token or the text's edge.
            edge = np.array([0 if GAP.search(texts[d], run[-1][1]) else 2 for d, run, _ in part])
            begin = np.array([2 if run[0][0] == 0 else 0 for _, run, _ in part])
            before = np.concatenate([begin[:, None], ids[:, :-1]], axis=1)
            after = np.concatenate([ids[:, 1:], np.zeros((len(part), 1), dtype=int)], axis=1)
            after[np.arange(len(part)), lens - 1] = edge
            e = model.emissions(ids.ravel(), before.ravel(), after.ravel()).reshape(*ids.shape, -1)
            path = model.viterbi(e, lens)
            for (doc, run, _), states in zip(part, path.tolist(), strict=True):
                t = 0
                while t < len(run):
                    s = states[t]
                    u = t
                    while u + 1 < len(run) and s and states[u + 1] == s:
                        u += 1
                    if s:
                        out[doc].append((Crf.states[s], run[t : u + 1]))
                    t = u + 1
    return out


def plausible(kind: str, found: str) -> bool:
    """What a span of the model must still satisfy: check digits, ranges and lengths that a shape can't show."""
    digits = NOT_DIGIT.sub("", found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return bool(m := IP.search(found)) and all(int(p) <= 255 for p in m[0].split(".") if len(p) < 10)
    return 7 <= len(digits) <= 15 if kind == "phone" else "@" in found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def cut(kind: str, tokens: list[tuple[int, int]], text: str) -> list[Span]:
    """Plausible spans among neighbouring tokens of one kind, the leftmost first and as long as they can be; "+" begins a new one, and so does "(" but after a token with "+"."""
    out, i = [], 0
    while i < len(tokens):
        most = next((j for j in range(i + 1, min(len(tokens), i + MOST_TOKENS)) if text[tokens[j][0]] == "+" or (text[tokens[j][0]] == "(" and text[tokens[j - 1][0]] != "+")), min(len(tokens), i + MOST_TOKENS))
        for j in range(most, i, -1):
            start, end = tokens[i][0], tokens[j - 1][1]
            if plausible(kind, text[start:end]):
                out.append((kind, start, end))
                i = j
                break
        else:
            i += 1
    return out


def all_spans(texts: list[str], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, base and added spans) of each text; added spans are plausible and made of tokens that touch no base span."""
    out = []
    for text, more in zip(texts, crf_spans(texts, model), strict=True):
        base = base_spans(text)
        starts, ends = [], []  # disjoint stretches that base spans cover
        for s, e in sorted((s, e) for _, s, e in base):
            if ends and s <= ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        added: list[Span] = []
        for kind, tokens in more:
            free: list[tuple[int, int]] = []
            for s, e in [*tokens, (-1, -1)]:
                if s >= 0 and ((i := bisect_right(ends, s)) == len(starts) or starts[i] >= e):
                    free.append((s, e))
                elif free:
                    added += cut(kind, free, text)
                    free = []
        out.append((base, base + added))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by [KIND]; overlapping spans are replaced as one, named by the first."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row: id, base (spans of the rules), spans (all), and the redacted text if asked for.

    Spans are "kind:start:end" in code points, comma-joined by kind, then start; "" where there are none. Null text counts as
    empty and comes back empty. Whole texts are read; other columns are ignored; repeated rows repeat.
    """
    model = train(labelled_rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            texts = texts.to_pylist()
            found = all_spans(texts, model)
            cols = [batch.column(0), pa.array([joined(b) for b, _ in found]), pa.array([joined(a) for _, a in found])]
            if with_text:
                cols.append(pa.array([redacted(t, a) for t, (_, a) in zip(texts, found, strict=True)]))
            yield pa.record_batch(cols, names=[id_col, "base", "spans", *["redacted"] * with_text])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"{id_col} long, base string, spans string" + ", redacted string" * with_text)

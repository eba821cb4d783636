"""Chat formatting by prefix tree.

Conversations that share their first turns share those nodes of a tree: a node is a turn together with all
turns before it, named by a running digest. Each node is formatted and tokenized once. The nodes of a tree are laid
out depth-first; a node carries its first token's place in that layout, the position id of that token (tokens on
the path before it) and the interval of places that may attend to it, which is its subtree: a token sees its own
node's earlier tokens and every node whose interval holds its place, its ancestors.

Layout and positions are sums over subtrees and root paths. They are computed by pointer doubling, a logarithmic
number of joins in the depth of the tree, so a common first turn doesn't meet one task. The naming, and reading a conversation
back, go through its turns in order: one conversation (all rows without an id are one) is a sorted stream in one task, never held whole.

Template: <|im_start|>role\\ntext<|im_end|>\\n. In roles and texts a backslash becomes two and "<|" becomes "<\\|";
in roles a newline becomes "\\n". So control strings only occur as marks, and unescaping is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake.session import materialize

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
TURN = re.compile(r"<\|im_start\|>((?:[^\n\\]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    return lib


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, seq, node, parent, tree, role, text): a conversation's rows in order, each named with its prefix.

    Rows are ordered by turn, then role, then text; nulls come first and null texts and roles count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, chain, parent, tree = object(), 0, None, None, b""
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["conv_id"] != conv or seq == 0:
                    conv, seq, chain, parent = x["conv_id"], 0, hashlib.sha256(), None
                role, text = x["role"].encode(), x["text"].encode()
                chain.update(b"%d:%d:" % (len(role), len(text)) + role + text)
                node = chain.digest()[:16]
                tree = node if seq == 0 else tree
                out.append((conv, seq, node, parent, tree, x["role"], x["text"]))
                parent, seq = node, seq + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    arrow = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("tree", pa.binary()), ("role", pa.string()), ("text", pa.string())])
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, seq long, node binary, parent binary, tree binary, role string, text string")


def tokenize(nodes: DataFrame, path: str) -> DataFrame:
    """+ ids array<int>, loss_from, loss_to (which ids are learned: an assistant's text, nothing of the template)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = tokenizer(path)
        tail = lib.encode(END, add_special_tokens=False).ids
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
                heads = {r: lib.encode(f"{START}{escape_role(r)}\n", add_special_tokens=False).ids for r in set(roles)}
                bodies = [e.ids for e in lib.encode_batch([escape(t) for t in texts], add_special_tokens=False)]
                ids = [heads[r] + b + tail for r, b in zip(roles, bodies, strict=True)]
                learned = [r == LEARNED_ROLE for r in roles]
                lo = [len(heads[r]) if k else 0 for r, k in zip(roles, learned, strict=True)]
                hi = [a + len(b) if k else 0 for a, b, k in zip(lo, bodies, learned, strict=True)]
                cols = [*(part.column(c) for c in ("node", "parent", "tree", "depth")), pa.array(ids, pa.list_(pa.int32())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "parent", "tree", "depth", "ids", "loss_from", "loss_to"])

    return nodes.mapInArrow(run, "node binary, parent binary, tree binary, depth long, ids array<int>, loss_from int, loss_to int")


def layout(nodes: DataFrame) -> DataFrame:
    """(node, start, position, end) of the nodes (node, parent, n): places in the depth-first layout of their tree."""
    jumps = [materialize(nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("up")), "chat-jump")]
    # Only nodes that still have an ancestor 2^k above stay in the loop; what they add to it is kept apart.
    active, parts = nodes.select("node", F.col("n").alias("total")), [nodes.select("node", F.col("n").alias("total"))]
    while not jumps[-1].isEmpty():
        j = jumps[-1]
        own = j.join(active, "node")
        below = materialize(own.groupBy(F.col("up").alias("node")).agg(F.sum("total").alias("total")), "chat-below")
        parts.append(below)
        jumps.append(materialize(j.join(j.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up").select("node", F.col("upper").alias("up")), "chat-jump"))
        more = below.withColumnRenamed("total", "more")
        active = own.join(jumps[-1], "node", "left_semi").join(more, "node", "left").select("node", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
        active = materialize(active, "chat-active")
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    total = materialize(total.groupBy("node").agg(F.sum("total").alias("total")), "chat-total")
    # Before a node come its parent and its earlier siblings. Siblings are summed by the first byte of their
    # name, then within it, so that a node with very many children is not one window.
    kids = nodes.where("parent IS NOT NULL").select("node", "parent").join(total, "node").withColumn("part", F.substring("node", 1, 1))
    parts = kids.groupBy("parent", "part").agg(F.sum("total").alias("sum"))

    def earlier(column: str, keys: list[str], order: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    parts = materialize(parts.select("parent", "part", earlier("sum", ["parent"], "part").alias("ahead")), "chat-parts")
    own = kids.withColumn("here", earlier("total", ["parent", "part"], "node")).select("node", "parent", "part", "here").join(parts, ["parent", "part"])
    own = own.join(nodes.select(F.col("node").alias("parent"), F.col("n").alias("up_n")), "parent").select("node", (F.col("ahead") + F.col("here") + F.col("up_n")).alias("start"), F.col("up_n").alias("position"))
    place = nodes.select("node").join(own, "node", "left").select("node", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("position", F.lit(0)).alias("position"))
    active, done = materialize(place, "chat-place"), None
    for j in jumps[:-1]:
        ready = materialize(active.join(j, "node", "left_anti"), "chat-ready")  # nodes less deep than 2^k: their path is summed
        done = ready if done is None else done.unionByName(ready)
        upper = done.unionByName(active.join(j, "node", "left_semi")).select(F.col("node").alias("up"), F.col("start").alias("s"), F.col("position").alias("p"))
        active = active.join(j, "node").join(upper, "up").select("node", (F.col("start") + F.col("s")).alias("start"), (F.col("position") + F.col("p")).alias("position"))
        active = materialize(active, "chat-place")
    place = active if done is None else done.unionByName(active)
    return place.join(total, "node").select("node", "start", "position", (F.col("start") + F.col("total")).alias("end"))


def build(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of the prefix trees of ``rows`` (conv_id, turn, role, text; other columns are ignored).

    nodes: tree, node, parent, depth, ids, loss_from, loss_to, start, position, end. Sorted by tree and start, the ids of a tree
    are its sequence; the ids of a node have position ids position, position + 1, ...; a token at place p attends to the
    whole nodes with start <= p < end other than its own, and to its own node's tokens up to itself.
    members: conv_id, seq, node. Rows with a null conv_id are one conversation. Repeated rows are turns like others.
    An empty table gives empty results.
    """
    all_turns = materialize(turns(rows), "chat-turns")
    nodes = all_turns.groupBy("node").agg(F.first("parent").alias("parent"), F.first("tree").alias("tree"), F.first("seq").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"))
    nodes = materialize(tokenize(nodes, path), "chat-nodes")
    placed = materialize(layout(nodes.select("node", "parent", F.size("ids").cast("long").alias("n"))), "chat-layout")
    return nodes.join(placed, "node"), all_turns.select("conv_id", "seq", "node")


def read_back(nodes: DataFrame, members: DataFrame, path: str) -> DataFrame:
    """One row per conversation, decoded from the ids of its nodes: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens.

    Fails if a node's position id is not the number of tokens before it, or its ids don't parse as one turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = tokenizer(path)
        state: list = []

        def result() -> pa.RecordBatch:
            conv, n, all_, chars, loss, formatted, tokens = state
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, n, all_.hexdigest(), chars, loss.hexdigest(), formatted, tokens), arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500).to_pylist()
                whole = lib.decode_batch([x["ids"] for x in part], skip_special_tokens=False)
                learned = lib.decode_batch([x["ids"][x["loss_from"] : x["loss_to"]] for x in part], skip_special_tokens=False)
                for x, text, loss in zip(part, whole, learned, strict=True):
                    if not state or x["conv_id"] != state[0]:
                        if state:
                            yield result()
                        state = [x["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    m = TURN.fullmatch(text)
                    if not m or x["position"] != state[6]:
                        raise ValueError(f"conversation {x['conv_id']}, turn {x['seq']}: the tree does not read back")
                    state[1] += 1
                    state[2].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                    loss = unescape(loss)
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                    state[5] += len(text)
                    state[6] += len(x["ids"])
        if state:
            yield result()

    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])
    rows = members.join(nodes.select("node", "ids", "loss_from", "loss_to", "position"), "node")
    rows = rows.select("conv_id", "seq", "ids", "loss_from", "loss_to", "position").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")

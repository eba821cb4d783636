"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles, hashed to 64 bits. Its parity sketch has 2^32 bits: each shingle flips the bit
that its hash's upper half names, so a bit tells whether an odd number of shingles fell on it; it is kept as the sorted places of
the bits that are set. A shingle that only one of two sets has flips one bit of one sketch, so the Hamming distance of the
sketches is never above the size of the symmetric difference. At similarity t a pair of sizes a <= b <= a/t differs in at most
d = (1-t)/(1+t) * (a+b) shingles. The sketch is cut into K segments; with more than d non-empty ones some non-empty segment is
equal in both (pigeonhole), and so is its key, a hash of the set bits in it. Candidates are held by their whole sketches, folded to
dense bits, before any set is read: whose Hamming distance is above d can't be a link.

K follows the size of the smaller set: every size is a band. Segments (blocks below) of neighbouring bands are nested
(growing K by one splits one block), so a document writes the blocks of its own band and the few
merged ones of the bands down to t times its size, and each pair meets in the smaller one's band. A
document left with too few non-empty blocks also writes its single shingles, which covers pairs of two such.

Documents with one set are one class, known by two fingerprints of the set and numbered; ids only label the result. Within a map task, then within a hash shard, a key's classes
beyond the first are recorded as members; keys met once vanish there. Classes that share fewer keys than any
link implies are dropped. The rest are compared with the smallest class of each of their keys, its
centre; the links found merge most copies. Only the stars of centres that still hold separate components
are compared in full, in blocks within tasks. So no link between different texts is lost, and no group of
copies is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession 
from pyspark.sql import functions as F

from planlake.llm.forest import join_roots
from planlake.llm.segments import slices
from planlake.llm.shingles import mix, shingle_sets
from planlake.operators.graph import components
from planlake.session import bounded_broadcast, materialize

WORDS = 5
PERCENT = 80
BLOCK_SHINGLES = 150_000
BLOCK_SETS = 1_000
COLUMNS = 4096
PRUNINGS = 2
BROADCAST_ROWS = 500_000
SHARD_BYTES = 24 << 20
HELD_KEYS = 250_000
NEED = 1 << 40
#: Bits of a folded sketch for each shingle, and the power of two that no folded sketch exceeds.
FOLDS, MAX_FOLD = 4, 16


def most_apart(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of sets of sizes a, b with 100 * intersection >= percent * union."""
    return (100 - percent) * (a + b) // (100 + percent)


def band(a: int, percent: int) -> int:
    """Blocks for pairs whose smaller set has ``a`` shingles: above the largest difference, with room for empty ones."""
    d = most_apart(a, 100 * a // percent, percent)
    return 1 if d == 0 else d + 1 + -(-(d + 1) // 4) + 4


def sketch_bits(u: np.ndarray) -> np.ndarray:
    """The set bits of the parity sketch of the sorted set u: their places, sorted, in the upper halves of 64 bits."""
    place = u >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(u)])
    odd = np.diff(np.append(at, len(u))) % 2 == 1
    return place[at[odd]] << np.uint64(32)


def folded(u: np.ndarray) -> bytes:
    """The sketch of the set u in FOLDS bits for each shingle or more, a power of two: bits of one place modulo that length are XORed."""
    length = 1 << min(MAX_FOLD, max(8, (FOLDS * len(u) - 1).bit_length()))
    seen = np.bincount((u >> np.uint64(32)).astype(np.int64) & (length - 1), minlength=length)
    return np.packbits(seen & 1, bitorder="little").tobytes()


def hamming(x: np.ndarray, y: np.ndarray) -> int:
    """Distance of two folded sketches; the longer one is folded to the length of the other, which only brings them nearer."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def block_ids(u: np.ndarray, k: int) -> np.ndarray:
    """The block of each sorted hash when hash space is cut into k nested blocks: (level << 40) + number, sorted within a level."""
    level = k.bit_length() - 1
    coarse = (u >> np.uint64(63 - level)) >> np.uint64(1) if level else np.zeros(len(u), dtype=np.uint64)
    fine = u >> np.uint64(63 - level)
    split = coarse < np.uint64(k - (1 << level))
    return np.where(split, (np.uint64(level + 1) << np.uint64(40)) + fine, (np.uint64(level) << np.uint64(40)) + coarse)


def block_keys(u: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(block ids, join keys) of the non-empty blocks of a sketch's bits u, without the blocks in ``skip``."""
    ids = block_ids(u, k)
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)])
    own = ids[at]
    keys = mix(np.bitwise_xor.reduceat(mix(u + np.uint64(1)), at) ^ mix(own)) if len(at) else own
    if skip is not None:
        new = ~np.isin(own, skip, assume_unique=True)
        own, keys = own[new], keys[new]
    return own, keys


def document_keys(u: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """All join keys of a document with the sorted shingle set u, and how many of them it shares with any partner at least.

    A partner differs in at most d blocks, so of m non-empty blocks m - d are shared. This is taken over every
    band the document takes part in; between two bands checked, m is that of the lower and d that of the upper.
    """
    b, bits = len(u), sketch_bits(u)
    top = band(b, percent)
    own, keys = block_keys(bits, top)
    out = [keys]
    need = len(own) - most_apart(b, 100 * b // percent, percent)
    steps = sorted({-(-percent * b // 100), -(-(percent + 100) * b // 200), b})
    for low, upto in zip(steps, [*steps[1:], b], strict=True):
        ids = block_ids(bits, band(low, percent))
        need = min(need, min(1, len(ids)) + int((ids[1:] != ids[:-1]).sum()) - most_apart(upto, b, percent))
    if (k := band(steps[0], percent)) != top:
        out.append(block_keys(bits, k, own)[1])
    if need < 1:
        out.append(mix(u ^ np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(out), max(1, need)


def _pairs(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sort by key and node, drop repeats: (keys, nodes, is the key's first, does the key have several nodes)."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])[: len(keys)]
    keys, nodes = keys[new], nodes[new]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    at = np.flatnonzero(first)
    several = np.repeat(np.diff(np.append(at, len(keys))) > 1, np.diff(np.append(at, len(keys))))
    return keys, nodes, first, several


def fingerprints(u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each set u[at[i] : at[i + 1]], 63 and 64 bits; together they name a class."""
    m, n = mix(u), np.diff(at)
    total = np.concatenate([[np.uint64(0)], np.cumsum(m, dtype=np.uint64)])
    again = np.concatenate([[np.uint64(0)], np.cumsum(mix(m), dtype=np.uint64)])
    return mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)) >> np.uint64(1), again[at[1:]] - again[at[:-1]]


def _docs_and_members(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, shards: int) -> DataFrame:
    """Rows (kind, a, b, c, n, t): kind 0 a document (id, fingerprint, second fingerprint, size + need * NEED, text's hash), kind 1 a member (key, fingerprint)."""
    packed = "shard int, kind int, a binary, b binary, c binary, n binary, t binary"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, size = 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            keys, nodes, first, several = _pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cut = np.searchsorted(keys[first], (np.arange(shards + 1, dtype=object) * (1 << 64) // shards).astype(object)[:-1].astype(np.uint64))
            k1, n1 = keys[first], nodes[first]
            rows = [(s, 2, k1[i:j].tobytes(), n1[i:j].tobytes(), b"", b"", b"") for s, (i, j) in enumerate(zip(cut, [*cut[1:], len(k1)], strict=True)) if j > i]
            if several.any():  # members found here only pass through; any shard will do
                rows.append((turn % shards, 1, keys[several].tobytes(), nodes[several].tobytes(), b"", b"", b""))
            turn += 7
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)

        for batch, texts in slices(batches, 1):
            u, at = shingle_sets(texts, words)
            n, (fp, fp2) = np.diff(at), fingerprints(u, at)
            ids, hashes = batch.column(0), np.asarray(batch.column(2)).astype(np.int64)
            known = np.asarray(ids.is_valid())
            for i in np.flatnonzero(known & (n > 0)):
                keys, need = document_keys(u[at[i] : at[i + 1]], percent)
                held.append((keys, np.full(len(keys), fp[i])))
                size += len(keys)
                n[i] += need * NEED
            # Rows without an id are given back without links: kind 3.
            for kind, rows in ((0, known), (3, ~known)):
                if rows.any():
                    row = (turn % shards, kind, np.asarray(ids.fill_null(0))[rows].astype(np.int64).tobytes(), fp[rows].tobytes(), fp2[rows].tobytes(), n[rows].tobytes(), hashes[rows].tobytes())
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row, strict=True))], schema=arrow)
            turn += 7
            if size > HELD_KEYS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        shard: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def rows(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray = empty, n: np.ndarray = empty, t: np.ndarray = empty) -> Iterator[pa.RecordBatch]:
            c, n, t = (x if len(x) else np.zeros(len(a), np.int64) for x in (c, n, t))
            for i in range(0, len(a), 100_000):
                cols = [pa.array(np.full(len(a[i : i + 100_000]), kind, np.int32)), *(pa.array(x[i : i + 100_000].view(np.int64)) for x in (a, b, c, n, t))]
                yield pa.record_batch(cols, names=["kind", "a", "b", "c", "n", "t"])

        for batch in batches:
            for x in batch.to_pylist():
                a, b, c, n, t = (np.frombuffer(x[k], dtype=np.int64) for k in "abcnt")
                if x["kind"] == 2:
                    shard.setdefault(x["shard"], []).append((a.view(np.uint64), b.view(np.uint64)))
                else:
                    yield from rows(x["kind"], a, b, c, n, t)
        for held in shard.values():
            keys, nodes, _, several = _pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield from rows(1, keys[several], nodes[several])

    arrow = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("n", pa.binary()), ("t", pa.binary())])
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col), F.xxhash64(text_col)).mapInArrow(write, packed)
    return rows.repartition(shards, "shard").mapInArrow(read, "kind int, a long, b long, c long, n long, t long")


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """(node, set, sketch): the sorted shingle hashes of the classes in ``wanted`` (node, fp, fp2, rep), read from rows with the id rep, each known by its text's fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, 1):
            u, at = shingle_sets(texts, words)
            fps = [pa.array(x.view(np.int64)) for x in fingerprints(u, at)]
            sets = [u[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([*fps, pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([folded(x) for x in sets], pa.binary())], names=["fp", "fp2", "set", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col)).join(bounded_broadcast(wanted.select("rep").distinct(), BROADCAST_ROWS), "rep", "left_semi")
    sets = rows.mapInArrow(run, "fp long, fp2 long, set binary, sketch binary")
    return sets.join(bounded_broadcast(wanted.select("fp", "fp2", "node"), BROADCAST_ROWS), ["fp", "fp2"]).dropDuplicates(["fp", "fp2"]).select("node", "set", "sketch")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, n, y, m) of classes with n and m shingles whose sketches aren't too far apart for a link: x, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (np.asarray(b.column(c)) for c in ("n", "m"))
            far = np.array([hamming(*(np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in p)) for p in zip(b.column("bx"), b.column("by"), strict=True)], dtype=np.int64)
            keep = far <= (100 - percent) * (n + m) // (100 + percent)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(keep))

    bx, by = (sets.select(F.col("node").alias(c), F.col("sketch").alias(f"b{c}")) for c in "xy")
    return pairs.join(bx, "x").join(by, "y").select("x", "y", "n", "m", "bx", "by").mapInArrow(run, "x long, y long")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets pass the test exactly."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep))

    sx, sy = sets.select(F.col("node").alias("x"), F.col("set").alias("sx")), sets.select(F.col("node").alias("y"), F.col("set").alias("sy"))
    return pairs.join(sx, "x").join(sy, "y").select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long")


def _in_blocks(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between different components of each star (c, node, n, component), as a spanning forest per task.

    A star's members are cut into blocks of about BLOCK_SHINGLES shingles and BLOCK_SETS sets; each pair of blocks is compared by
    counting common shingles in a matrix product, so no pair becomes a row.
    """

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        node, comp, block = (np.asarray(table.column(c)) for c in ("node", "component", "block"))
        none = pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})
        if (comp == comp[0]).all():
            return none
        u = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table.column("set")]
        size = np.array([len(v) for v in u])
        _, col, seen = np.unique(np.concatenate(u), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(u)), size)
        both = seen[col] > 1  # what one set has alone is in no intersection
        number = np.cumsum(seen > 1) - 1
        row, col = row[both], number[col[both]]
        a, b = (np.flatnonzero(block == k) for k in (i, j))
        common = np.zeros((len(a), len(b)), dtype=np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for lo in range(0, int(number[-1]) + 1, COLUMNS):
            part = slice(*np.searchsorted(col, [lo, lo + COLUMNS]))
            have = np.zeros((len(u), COLUMNS), dtype=np.float32)
            have[row[part], col[part] - lo] = 1
            common += have[a] @ have[b].T
        common = common.astype(np.int64)
        x, y = np.nonzero((100 * common >= percent * (size[a][:, None] + size[b][None, :] - common)) & (comp[a][:, None] != comp[b][None, :]))
        root = join_roots(np.arange(len(u)), a[x], b[y])
        hit = np.flatnonzero(root != np.arange(len(u)))
        return pa.table({"x": pa.array(node[hit]), "y": pa.array(node[root[hit]])})

    cuts = stars.groupBy("c").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).alias("cuts"), F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("c", "cuts")
    rows = stars.join(cuts, "c").withColumn("block", F.pmod(F.xxhash64("node"), F.col("cuts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = rows.select("c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")
    rows = rows.join(sets, "node").groupBy("c", "i", "j")
    return rows.applyInArrow(compare, "x long, y long")


def shards_for(spark: SparkSession, docs: DataFrame, text_col: str) -> int:
    """Shards of about SHARD_BYTES of keys each, from the length of all texts; at least the session's shuffle partitions."""
    chars = docs.select(F.sum(F.length(text_col))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // SHARD_BYTES)


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, n, component_id, t) of each row; t is the text's hash, which tells rows of one id apart."""
    spark = docs.sparkSession
    found = materialize(_docs_and_members(docs, id_col, text_col, words, percent, shards_for(spark, docs, text_col)), "ngram-keys")
    info = found.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("fp"), F.col("c").alias("fp2"), (F.col("n") % NEED).alias("n"), F.shiftright("n", 40).alias("need"), "t")
    classes = info.where("n > 0").groupBy("fp", "fp2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("need").alias("need"))
    # A class has a number of its own: several classes can have one smallest id. The numbers are fixed once written.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    keyed = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp")).distinct()
    members = keyed.join(classes.select("fp", "node", "n", "need"), "fp").select("key", "node", "n", "need")
    for _ in range(PRUNINGS):
        # Who shares fewer keys than any partner would is out; then keys may be left with one class.
        few = members.groupBy("node").agg(F.count(F.lit(1)).alias("keys"), F.first("need").alias("least")).where("keys >= least").select("node")
        members = members.join(few, "node", "left_semi")
        met = members.groupBy("key").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p < q").select("key")
        members = materialize(members.join(met, "key", "left_semi"), "ngram-members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "fp", "fp2", "rep")
    sets = materialize(_sets(docs, id_col, text_col, words, wanted), "ngram-sets")
    # Every key has a centre, its smallest set; two linked classes are in the star of each centre whose key they share.
    nodes = members.select("node", "n").distinct()
    centre = members.groupBy("key").agg(F.min(F.struct("n", "node")).alias("c")).select("key", F.col("c.node").alias("c"))
    stars = materialize(members.join(centre, "key").select("c", "node", "n").distinct(), "ngram-stars")
    size_c = nodes.select(F.col("node").alias("c"), F.col("n").alias("m"))
    pairs = stars.where("c <> node").join(size_c, "c").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    pairs = pairs.select(F.least("c", "node").alias("x"), F.greatest("c", "node").alias("y"), "n", "m").dropDuplicates(["x", "y"])
    near = materialize(_near(pairs, sets, percent), "ngram-near")
    links = materialize(_similar(near, sets, percent), "ngram-links")
    label = components(links, "x", "y")
    placed = stars.join(label, "node", "left").select("c", "node", "n", F.coalesce("component", "node").alias("component"))
    more = materialize(_in_blocks(placed, sets, percent), "ngram-links")
    if not more.isEmpty():
        label = components(links.unionByName(more), "x", "y")
    smallest = label.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = label.join(smallest, "component").select("node", "component_id")
    of_class = materialize(classes.join(named, "node", "left").select("fp", "fp2", F.coalesce("component_id", "rep").alias("component_id")), "ngram-components")
    rows = info.join(of_class, ["fp", "fp2"], "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"), "t")
    unknown = found.where("kind = 3").select(F.lit(None).cast("long").alias("id"), "n", F.lit(None).cast("long").alias("component_id"), "t")
    return rows.unionByName(unknown)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets. Null and empty
    texts and texts without words have no shingles and link with nothing. Rows with a null id come back with a null
    component_id and link with nothing. Repeated rows each come back; rows that share an id but not a text are
    linked each by its text. Other columns are ignored. Empty tables give empty results.
    """
    return _labelled(docs, id_col, text_col, words, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of each group of linked rows the one with the smallest id.

    Rows without shingles and rows without an id link with nothing and stay; rows that repeat the smallest id all stay. Of rows that
    share an id but not a text, each stays or goes by its text.
    """
    gone = _labelled(docs, id_col, text_col, words, percent).where("id <> component_id").select(F.col("id").alias("__id"), F.col("t").alias("__t")).distinct()
    gone = bounded_broadcast(materialize(gone, "ngram-gone"), BROADCAST_ROWS)
    return docs.join(gone, (docs[id_col] == gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__t"]), "left_anti")

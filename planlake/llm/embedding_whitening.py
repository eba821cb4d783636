"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson method.

The covariance V is never formed. Vectors lie in blocks in a written table; a product V W, for a few columns W, is one
job over it: each task sums X'(X W) over its blocks of centred vectors X, and Spark adds up the tasks' sums row by row, so what comes
back has one row per dimension. All else is done on the driver with matrices of (dimensions x some dozens of columns).

A search space W is kept with V W. Each round: Rayleigh-Ritz in W; leading Ritz pairs with residuals at double precision
are locked and taken out of the space; for the others the correction equation
(I - PP')(V - t)(I - PP') z = -r, with P the locked vectors and the pair's own, is solved roughly by MINRES, all pairs in step, so that a
step is one product for all of them; the corrections, made orthogonal, join the space. A space that has grown too large is cut to its leading Ritz
vectors. Once the space and the locked vectors span everything, Rayleigh-Ritz is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.session import materialize

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
#: Larger entries have no place among exact whole numbers; vectors that hold one are dropped like those with non-finite entries.
LARGEST = 2.0**40
BLOCK_ENTRIES = 1 << 18
EXTRA = 8
MAX_SPACE = 4
INNER = 6
MAX_ROUNDS = 200
EPS = float(np.finfo(np.float64).eps)
#: Residuals, as parts of the largest eigenvalue, that count as double precision; a pair that no longer improves may stop at the second.
PRECISE, STALLED = 64 * EPS, 1e-11


def blocks_of(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(dim, n, ids, x): the vectors that take part as whole numbers floor(64 c) + 1000000, little-endian, in blocks of one length each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = lists.flatten()
            value = np.asarray(pc.fill_null(flat, np.nan), dtype=np.float64)
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~(np.abs(value) < LARGEST))])
            ok = (size > 0) & (bad[ends] == bad[ends - size])
            for dim in np.unique(size[ok]).tolist():
                rows = np.flatnonzero(ok & (size == dim))
                most = max(1, BLOCK_ENTRIES // dim)
                for i in range(0, len(rows), most):
                    own = rows[i : i + most]
                    x = np.floor(SCALE * value[(ends[own] - dim)[:, None] + np.arange(dim)]).astype(np.int64) + SHIFT
                    kind = "<i4" if np.abs(x).max() < 1 << 31 else "<i8"
                    ids = batch.column(0).take(pa.array(own))
                    yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([len(own)], pa.int32()), pa.ListArray.from_arrays([0, len(own)], ids), pa.array([x.astype(kind).tobytes()], pa.binary())], names=["dim", "n", "ids", "x"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return materialize(rows.mapInArrow(run, "dim int, n int, ids array<long>, x binary"), "whiten-blocks")


def whole(n: int, dim: int, data: pa.Scalar) -> np.ndarray:
    raw = data.as_buffer()
    return np.frombuffer(raw, dtype="<i4" if len(raw) == 4 * n * dim else "<i8").reshape(n, dim).astype(np.int64)


class Centre:
    """Sums S of n vectors, for n x - S without loss: the means' whole parts ``base`` and what is left over, S = n base + ``rest``."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.dim = n, len(sums)
        self.base = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in 64 bits where they do."""
        y = x - self.base
        if self.n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62:
            return self.n * y - self.rest
        return self.n * y.astype(object) - self.rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Each row's sum of (n x - S)^2; None where it needs more than 64 bits."""
        a = self.apart(x)
        if a.dtype == object or float(np.abs(a).max(initial=0)) ** 2 * self.dim > 2**62:
            a = a.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (a * a).sum(1)]


def summed(blocks: DataFrame, centre: Centre, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``part`` (a matrix of ``shape``) over all blocks of centred vectors."""
    rows, cols = shape
    names = [f"c{j}" for j in range(cols)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for n, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total += part(centre.centred(whole(n, centre.dim, x)))
        yield pa.record_batch([pa.array(np.arange(rows, dtype=np.int32)), *(pa.array(total[:, j].copy()) for j in range(cols))], names=["i", *names])

    parts = blocks.select("n", "x").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros(shape)
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():  # a row per row of the matrix
        out[r["i"]] = [r[c] for c in names]
    return out


def orthogonal(new: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``new`` add to the others, which are orthonormal."""
    basis = np.concatenate(others, axis=1) if others else new[:, :0]
    out = np.zeros((len(new), 0))
    for v in new.T:
        v = v / (np.linalg.norm(v) or 1)
        for _ in range(3):
            v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
            norm = np.linalg.norm(v)
            if norm < 1e-8:
                break
            v = v / norm
        else:
            out = np.column_stack([out, v])
    return out[:, : len(new) - basis.shape[1]]


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, least: float) -> np.ndarray:
    """Columns x with apply(x) near b, each column by MINRES, all in step, until every residual has fallen to ``least`` of its start."""
    x, w, w_old, v_old = (np.zeros_like(b) for _ in range(4))
    beta = np.linalg.norm(b, axis=0)
    start = np.where(beta > 0, beta, 1)
    v, eta = b / start, beta.copy()
    cos, cos_old, sin, sin_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        z = apply(v)
        alpha = (v * z).sum(0)
        z = z - alpha * v - beta * v_old
        beta_new = np.linalg.norm(z, axis=0)
        delta = cos * alpha - cos_old * sin * beta
        r1 = np.hypot(delta, beta_new)
        r2, r3 = sin * alpha + cos_old * cos * beta, sin_old * beta
        going = r1 > 0
        r1 = np.where(going, r1, 1)
        w, w_old = (v - r3 * w_old - r2 * w) / r1, w
        cos_old, sin_old, cos, sin = cos, sin, np.where(going, delta / r1, 1), np.where(going, beta_new / r1, 0)
        x = x + np.where(going, cos * eta, 0) * w
        eta = -sin * eta
        v_old, v, beta = v, z / np.where(beta_new > 0, beta_new, 1), beta_new
        if (np.abs(eta) <= least * start).all():
            break
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, relative residuals) of the ``want`` largest eigenvalues, falling, of a symmetric positive operator."""
    want = min(want, dim)
    space = orthogonal(np.random.default_rng(0).normal(size=(dim, min(dim, want + EXTRA))))
    image = product(space)
    locked, values, residuals = space[:, :0], np.zeros(0), np.zeros(0)
    best: dict[int, float] = {}
    stalled = 0
    for round_ in range(MAX_ROUNDS):
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        space, image = space @ s, image @ s
        r = image - space * theta
        r -= locked @ (locked.T @ r)
        norm = max(float(values.max(initial=0)), float(theta.max(initial=0)))
        if norm <= 0:
            return np.zeros(0), space[:, :0], np.zeros(0)
        res = np.linalg.norm(r, axis=0) / norm
        spanned = locked.shape[1] + space.shape[1] == dim
        lead = float(res[0]) if len(res) else 0.0
        stalled = stalled + 1 if lead > best.get(locked.shape[1], np.inf) / 2 else 0
        best[locked.shape[1]] = min(lead, best.get(locked.shape[1], np.inf))
        limit = STALLED if stalled >= 3 else PRECISE
        done = 0
        while done < len(res) and res[done] <= limit and (len(values) < want or theta[done] > np.sort(values)[-want]):
            locked, values, residuals = np.column_stack([locked, space[:, done]]), np.append(values, theta[done]), np.append(residuals, res[done])
            done += 1
        space, image, theta, r = space[:, done:], image[:, done:], theta[done:], r[:, done:]
        if len(values) >= want and (not len(theta) or theta[0] <= np.sort(values)[-want] + PRECISE * norm):
            order = np.argsort(-values, kind="stable")[:want]
            return values[order], locked[:, order], residuals[order]
        if spanned and not done:
            # The space is whole: only rounding is left, in the basis or in its image.
            space = orthogonal(space, locked)
            image = product(space)
            continue
        active = max(1, min(want - len(values), len(theta)))
        u, t, rhs = space[:, :active], theta[:active], -r[:, :active]
        if space.shape[1] > MAX_SPACE * (want + EXTRA):
            space, image = space[:, : active + EXTRA], image[:, : active + EXTRA]

        def projected(x: np.ndarray) -> np.ndarray:
            x = x - locked @ (locked.T @ x)
            return x - u * (u * x).sum(0)

        new = minres(lambda x: projected(product(projected(x)) - projected(x) * t), projected(rhs), INNER, 0.5 ** (round_ + 1))
        new = orthogonal(np.column_stack([new, rhs]) if len(values) + space.shape[1] + active > dim else new, locked, space)
        if new.shape[1]:
            space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    raise RuntimeError(f"{len(values)} of {want} eigenvectors found in {MAX_ROUNDS} rounds")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component (1 to ``components``, by falling eigenvalue): id, component, n, deviation, whitened, explained,
    identity_error, residual.

    Vectors that are null or empty, or hold null, non-finite or very large entries (2^40 or more), are dropped. Vectors of different lengths have
    no common covariance: each length is fitted for itself, one after the other. Components whose eigenvalue is zero to double precision have no
    whitened value and are left out, so equal vectors alone give no rows. A deviation that needs more than 64 bits is null. Rows with null ids and repeated rows are vectors like others. Other
    columns are ignored. An empty table gives an empty result.
    """
    blocks = blocks_of(vectors, id_col, vec_col)
    position = F.posexplode("s").alias("i", "s")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([whole(n, dim, x).sum(0).tolist()], pa.list_(pa.int64()))], names=["dim", "n", "s"])

    per_block = blocks.select("dim", "n", "x").mapInArrow(sums, "dim int, n long, s array<long>").select("dim", "n", position)
    totals: dict[int, list[tuple[int, int, int]]] = {}
    for r in per_block.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # a row per dimension
        totals.setdefault(r["dim"], []).append((r["i"], r["n"], int(r["s"])))
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    out = vectors.sparkSession.createDataFrame([], schema)
    for dim, found in sorted(totals.items()):
        centre = Centre(found[0][1], [s for _, _, s in sorted(found)])
        out = out.unionByName(_whitened(blocks.where(F.col("dim") == dim), centre, id_col, components, schema))
    return out


def _whitened(blocks: DataFrame, centre: Centre, id_col: str, components: int, schema: str) -> DataFrame:
    """The rows of the vectors of one length."""
    n, dim = centre.n, centre.dim
    values, axes, residuals = jacobi_davidson(lambda w: summed(blocks, centre, lambda x: x.T @ (x @ w), w.shape) / n, dim, components)
    keep = values > dim * EPS * values.max(initial=0)
    values, axes, residuals = values[keep], axes[:, keep], residuals[keep]
    k = len(values)
    if not k:
        return blocks.sparkSession.createDataFrame([], schema)
    trace = float(summed(blocks, centre, lambda x: np.array([[(x * x).sum()]]), (1, 1))[0, 0]) / n
    scaled = axes / np.sqrt(values)
    mean = summed(blocks, centre, lambda x: (x @ scaled).sum(0)[None, :], (1, k)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = x @ scaled - mean
        return w.T @ w

    error = float(np.abs(summed(blocks, centre, spread, (k, k)) / n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, ids, x in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                x = whole(m, dim, x)
                row = np.repeat(np.arange(m), k)
                deviation = pa.array(centre.deviation(x), pa.int64())
                fixed = [pa.array(v) for v in (np.tile(values / trace, m), np.full(m * k, error), np.tile(residuals, m))]
                cols = [ids.values.take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(pa.array(row)), pa.array((centre.centred(x) @ scaled).ravel())]
                yield pa.record_batch([*cols, *fixed], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return blocks.select("n", "ids", "x").mapInArrow(run, schema)

"""Whitening of embeddings by a one-sided Jacobi SVD of blockwise TSQR.

1. Vectors become whole numbers, ``x = floor(scale * c) + shift``, so that sums are exact. The fit list is each distinct x once; its size n and its sums S come
   from partial sums of whole numbers, a row a dimension.
2. TSQR: each block of ``BLOCK`` rows of the fit list is centred exactly, as (n * x - S) / n, and replaced by the R of its QR decomposition; blocks of a task
   are folded as they come, and the tasks' Rs are stacked ``FAN`` at a time until one d x d R is left. Its Gram matrix is that of all centred rows, but that
   matrix is never formed, so small deviations keep their digits.
3. One-sided Jacobi: plane rotations make R's columns orthogonal, disjoint pairs at a time; the rotations, accumulated, are the components and the columns' lengths
   the singular values s. Variances are e = s * s / n. A component whose deviation is below rounding (rank) is not one.
4. Rows are projected in blocks, and two passes over the fit list (means, then centred products) measure how far the whitened covariance is from the identity.

Only d sums, one R and the components pass through the driver: d * d numbers.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries, or one whose x doesn't fit in 53 bits, are left out; so are vectors of
another length than the most frequent one (of several, the longest). Repeated vectors count once in the fit and each row gets its result; null vec_ids are
ids like others. With no spread at all, or an empty table, there are no components and no rows. Of two components of equal variance either may come first; a
component's largest entry is positive, the first of equals. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash

#: Rows of a block of TSQR, and Rs that one task stacks.
BLOCK, FAN = 4_096, 32
SWEEPS = 60


@dataclass(frozen=True)
class Model:
    """n and sums S of the fit list, components as rows, their deviations, and each one's share of the variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.components.T / self.deviations


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, from whole numbers as far as 64 bits reach: quotients of S are taken out of x first."""
    return (x - (sums // n).astype(np.int64)) - (sums % n).astype(np.float64) / n


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s, v) of a matrix: singular values, falling, and right singular vectors as columns, by one-sided Jacobi rotations of disjoint pairs of columns."""
    d = r.shape[1]
    even, least = d + d % 2, np.finfo(float).eps * np.sqrt(d)
    u = np.zeros((max(len(r), 1), even))
    u[: len(r), :d] = r
    v = np.eye(even)
    ring = np.arange(even)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(1, even - 1)):
            i, j = np.minimum(ring[: even // 2], ring[::-1][: even // 2]), np.maximum(ring[: even // 2], ring[::-1][: even // 2])
            a, b = (u[:, i] ** 2).sum(axis=0), (u[:, j] ** 2).sum(axis=0)
            c = (u[:, i] * u[:, j]).sum(axis=0)
            size = np.sqrt(a * b)
            turn = np.abs(c) > least * size
            turned |= bool(turn.any())
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                z = np.where(turn, (b - a) / (2 * c), 0.0)
                t = np.where(turn, np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            for m in (u, v):
                p, q = m[:, i], m[:, j]
                m[:, i], m[:, j] = cos * p - sin * q, sin * p + cos * q
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])  # all but the first move on
        if not turned:
            break
    s = np.sqrt((u**2).sum(axis=0))
    # the column that made the number even stays zero and apart
    order = np.argsort(-s[:d], kind="stable")
    return s[:d][order], v[:d, :d][:, order]


def _whole(scale: float, shift: int, column: str):
    v = F.col(column)
    each = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift))
    most = float(1 << 52) / scale
    sound = (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= F.lit(most)))
    return sound, each


def numbers(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", scale: float = 64, shift: int = 1_000_000) -> DataFrame:
    """(key, x) of the rows that count, written."""
    sound, each = _whole(scale, shift, column)
    rows = stash(vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(key).alias("id"), each.cast("array<long>").alias("x")), "vectors")
    # one row for each length there is
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if len(lengths) > 1:
        kept = rows.where(F.size("x") == lengths[0]["d"])
        kept._quillon_path = rows._quillon_path
        return kept
    return rows


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(batches, at: int):
    """Matrices of about BLOCK rows."""
    held, have = [], 0
    for b in batches:
        if b.num_rows:
            held.append(_matrix(b.column(at)))
            have += b.num_rows
        if have >= BLOCK:
            yield np.concatenate(held)
            held, have = [], 0
    if held:
        yield np.concatenate(held)


def _sums(batches):
    total, n = None, 0
    for x in _blocks(batches, 0):
        # 2**53 times 4,096 rows doesn't pass 64 bits by halves
        low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
        total = (low, high) if total is None else (total[0] + low, total[1] + high)
        n += len(x)
    if n:
        d = len(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(total[0]), pa.array(total[1]), pa.array(np.full(d, n))], names=["dim", "low", "high", "n"])


def _factor(n: int, sums: np.ndarray):
    """Centred blocks -> one R a task."""

    def run(batches):
        r = None
        for x in _blocks(batches, 0):
            y = centred(x, n, sums)
            r = np.linalg.qr(y if r is None else np.concatenate([r, y]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    return run


def _stack(d: int):
    def run(batches):
        r = None
        for b in batches:
            for raw in b.column(0).to_pylist():
                y = np.frombuffer(raw).reshape(-1, d)
                r = y if r is None else np.linalg.qr(np.concatenate([r, y]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    return run


def fit(once: DataFrame, most: int) -> Model | None:
    """The model of a written fit list (x), with ``most`` components at most; None where there is no spread."""
    sums = once.select("x").mapInArrow(_sums, "dim int, low long, high long, n long").groupBy("dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high", "n")]).orderBy("dim").collect()  # a row for each dimension
    if not sums:
        return None
    n, d = int(sums[0]["n"]), len(sums)
    total = np.array([int(s["low"]) + (int(s["high"]) << 32) for s in sums], object)
    rs = stash(once.select("x").mapInArrow(_factor(n, total), "r binary"), "r")
    while (count := rs.count()) > 1:
        after = stash(rs.repartition(-(-count // FAN)).mapInArrow(_stack(d), "r binary"), "r")
        unstash(rs)
        rs = after
    r = np.frombuffer(rs.first()["r"]).reshape(-1, d)
    unstash(rs)
    s, v = jacobi(r)
    # as many as rounding leaves above zero
    rank = int((s > s[0] * max(d, len(r)) * np.finfo(float).eps * 4).sum()) if s[0] > 0 else 0
    if not rank:
        return None
    take = min(most, rank)
    components = v[:, :take].T
    largest = components[np.arange(take), np.abs(components).argmax(axis=1)]
    return Model(n, total, components * np.sign(largest)[:, None], s[:take] / np.sqrt(n), (s[:take] ** 2 / (s**2).sum()))


def _apart(model: Model, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None where that passes 64 bits.

    With S = n * whole + rest and y = x - whole it is n * n * sum(y * y) - 2 * n * sum(y * rest) + sum(rest * rest), so that only three numbers a row are large."""
    n, rest = model.n, model.sums % model.n
    y = x - (model.sums // n).astype(np.int64)
    if float(np.abs(y).max(initial=0)) * max(n, np.abs(y).max(initial=0)) * x.shape[1] >= 2**62:
        y = y.astype(object)
    squares, crossed, last = (y * y).sum(axis=1).tolist(), (y * rest.astype(y.dtype)).sum(axis=1).tolist(), sum(int(r) ** 2 for r in rest)
    out = [n * n * int(q) - 2 * n * int(c) + last for q, c in zip(squares, crossed)]
    return [t if t < 1 << 63 else None for t in out]


def _whitened(model: Model):
    k = len(model.components)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            w, apart = model.whiten(x), pa.array(_apart(model, x), pa.int64())
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), apart.take(at), pa.array(w.ravel()), pa.array(np.tile(model.explained, len(x)))],
                names=["id", "component", "deviation", "whitened", "explained"],
            )

    return run


def _moments(model: Model, mean: np.ndarray | None):
    """Partial sums of whitened rows or, with their mean, of centred products."""

    def run(batches):
        total, n = 0.0, 0
        for x in _blocks(batches, 0):
            w = model.whiten(x)
            if mean is None:
                total = total + w.sum(axis=0)
            else:
                w = w - mean
                total = total + w.T @ w
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total).tobytes()], pa.binary())], names=["m"])

    return run


def _added(batches):
    total = None
    for b in batches:
        for raw in b.column(0).to_pylist():
            y = np.frombuffer(raw)
            total = y if total is None else total + y
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])


def _total(parts: DataFrame) -> np.ndarray:
    """The sum of all partial sums, ``FAN`` at a time."""
    parts = stash(parts, "moments")
    while (count := parts.count()) > 1:
        after = stash(parts.repartition(-(-count // FAN)).mapInArrow(_added, "m binary"), "moments")
        unstash(parts)
        parts = after
    out = np.frombuffer(parts.first()["m"])
    unstash(parts)
    return out


def identity_error(once: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.components)
    mean = _total(once.select("x").mapInArrow(_moments(model, None), "m binary")) / model.n
    cov = _total(once.select("x").mapInArrow(_moments(model, mean), "m binary")).reshape(k, k) / model.n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = 16, scale: float = 64, shift: int = 1_000_000) -> tuple[DataFrame, Model | None]:
    """(key, component, n, deviation, whitened, explained, identity_error) of each row that counts, written, and the model."""
    rows = numbers(vectors, column, key, scale, shift)
    once = stash(rows.select("x").distinct(), "fit")
    model = fit(once, most)
    if model is None:
        out = rows.select("id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained")).where("false")
        n, error = 0, 0.0
    else:
        out, n, error = rows.select("id", "x").mapInArrow(_whitened(model), f"id {rows.schema['id'].dataType.simpleString()}, component int, deviation long, whitened double, explained double"), model.n, identity_error(once, model)
    out = out.select(F.col("id").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
    done = stash(out, "whitened")
    for x in (rows, once):
        unstash(x)
    return done, model


def digest(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)[0]

"""Whitening of embeddings by their leading principal components, found by a Jacobi-Davidson iteration.

Entries become integers, so sums and deviations are exact. The covariance is never formed: the iteration only asks for its
products with a few vectors, and each is one job over the centred rows, whose tasks send d times k sums. The driver holds d times
SUBSPACE numbers. The subspace is solved by Rayleigh-Ritz. Leading Ritz vectors whose residual is at double precision are
locked; for the others that are asked for, the projected correction equations (I - QQ') (V - e I) (I - QQ') t = -r, Q being all locked and current
Ritz vectors, are solved by INNER steps of MINRES, all in step, so that one job serves every equation. Then products are made
afresh for the vectors found, and the iteration goes on until their residuals are at double precision.

Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are rows of another length than the most common
one (the longest of several). Entries beyond 2^39 count as 2^39, or -2^39. A deviation beyond a long is null. Components
without variance are left out, so there are fewer than asked for if vectors have few dimensions, lie in a subspace, are all equal or
fewer than two. Rows may share a vec_id or have none. Extra columns are not looked at.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COMPONENTS = 8
INNER = 4
#: columns at which the subspace is cut back to KEPT Ritz vectors
SUBSPACE = 48
KEPT = 32
SCALE = 1024
SHIFT = 100_000
LARGEST = 1 << 49
#: rows of a block
BLOCK = 4096
#: residuals, in units of the double precision of the largest eigenvalue and the square root of the dimensions
ACCURACY = 8.0
SEED = 271

_ROWS = "vec_id long, size int, x binary"


def scaled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, size, x) of all rows with a usable vector; x holds the integers."""
    e = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("v")).where("v is not null and size(v) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            bad = v.values.is_null().to_numpy(zero_copy_only=False) | ~np.isfinite(v.values.fill_null(0.0).to_numpy(zero_copy_only=False))
            off = v.offsets.to_numpy()
            bad_before = np.concatenate(([0], np.cumsum(bad)))
            ok = bad_before[off[1:]] == bad_before[off[:-1]]
            with np.errstate(over="ignore"):
                x = np.floor(np.clip(v.values.fill_null(0.0).to_numpy(zero_copy_only=False) * SCALE, -float(LARGEST), float(LARGEST)))
            x = np.where(bad, 0, x).astype(np.int64) + SHIFT
            raw = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(ok)), pa.array(np.diff(off)[ok].astype(np.int32)), pa.array([raw[8 * i : 8 * j] for i, j, k in zip(off[:-1].tolist(), off[1:].tolist(), ok.tolist()) if k], pa.binary())],
                names=["vec_id", "size", "x"],
            )

    return e.mapInArrow(run, _ROWS)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many rows there are, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                n += len(x)
                # halves of 32 bits, whose sums fit
                high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                total = [t + (h << 32) + v for t, h, v in zip(total, high, low)]
        if n:
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(d), pa.int32()), "n": [n] * d, "s": [str(t) for t in total]})

    got = rows.select("x").mapInArrow(run, "k int, n long, s string").groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = {r.k: int(r.s) for r in got}
    return (got[0].n, [total[k] for k in range(d)]) if got else (0, [0] * d)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S/n with one rounding, as n x - S is an integer."""
    if n * (LARGEST + SHIFT) < 1 << 62 or int(np.abs(x).max(initial=0)) < (1 << 62) // n:
        return (n * x - total).astype(np.float64) / n
    return np.array([[(n * a - s) / n for a, s in zip(r, total.tolist())] for r in x.tolist()])


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2; None beyond a long."""
    most = int(np.abs(x).max(initial=0))
    if 2 * n * most < 1 << 62:
        y = n * x - np.array(total, np.int64)
        if (2 * n * most) ** 2 * x.shape[1] < 1 << 62 or float(np.square(y.astype(np.float64)).sum(1).max(initial=0)) < 2.0**62:
            return (y * y).sum(1).tolist()
    out = []
    for r in x.tolist():
        q = sum((n * a - s) ** 2 for a, s in zip(r, total))
        out.append(q if q < 1 << 63 else None)
    return out


def added(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], shape: tuple[int, ...], grouped: bool) -> np.ndarray:
    """The sum of one array of doubles from every task; where grouped, tasks' arrays are summed in 64 groups first."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = [x.tobytes() for x in run(batches)]
        yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId() % 64] * len(out), pa.int32()), "v": pa.array(out, pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(1).to_pylist():
                x = np.frombuffer(v)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array([0], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    sent = df.mapInArrow(local, "k int, v binary")
    if grouped:
        sent = sent.repartition(64, "k").mapInArrow(merge, "k int, v binary")
    total = np.zeros(shape)
    for r in sent.collect():
        total += np.frombuffer(r.v).reshape(shape)
    return total


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """For each column i, MINRES steps from 0 towards operator_i t = right_i; product applies operator i to column i.

    Lanczos vectors are kept, as steps are few, and the small tridiagonal least-squares problem is solved at the end.
    """
    d, k = right.shape
    beta = np.linalg.norm(right, axis=0)
    basis = [np.divide(right, beta, out=np.zeros_like(right), where=beta > 0)]
    diagonal, lower = [], []
    for j in range(steps):
        w = product(basis[j])
        diagonal.append((basis[j] * w).sum(0))
        for _ in range(2):
            for v in basis:
                w = w - v * (v * w).sum(0)
        lower.append(np.linalg.norm(w, axis=0))
        basis.append(np.divide(w, lower[j], out=np.zeros_like(w), where=lower[j] > 1e-300))
    out = np.zeros((d, k))
    for i in range(k):
        # a chain that ended early has nothing to say beyond
        m = next((j + 1 for j in range(steps) if lower[j][i] <= 1e-13 * abs(diagonal[0][i]) + 1e-300), steps)
        t = np.zeros((m + 1, m))
        for j in range(m):
            t[j, j], t[j + 1, j] = diagonal[j][i], lower[j][i]
            if j:
                t[j - 1, j] = lower[j - 1][i]
        e = np.zeros(m + 1)
        e[0] = beta[i]
        y = np.linalg.lstsq(t, e, rcond=None)[0]
        for j in range(m):
            out[:, i] += basis[j][:, i] * y[j]
    return out


def _orthogonal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns of new against basis and each other; what adds nothing is left out."""
    out: list[np.ndarray] = []
    for c in new.T:
        size = np.linalg.norm(c)
        if not size > 0:
            continue
        c = c / size
        for _ in range(3):
            c = c - basis @ (basis.T @ c)
            for o in out:
                c = c - o * (o @ c)
            left = np.linalg.norm(c)
            if left < 1e-10:
                break
            c = c / left
        else:
            out.append(c)
    return np.stack(out, 1) if out else np.zeros((len(new), 0))


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of a symmetric operator without negative ones, their unit vectors, and the largest residual over
    the largest eigenvalue. product multiplies a block of vectors; it is called once for each block."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    v = np.linalg.qr(rng.standard_normal((d, min(d, k + 4))))[0]
    av = product(v)
    limit = ACCURACY * np.finfo(float).eps * np.sqrt(d)
    most = max(min(SUBSPACE, d), 1)
    best = np.inf
    idle = 0
    while True:
        h = v.T @ av
        values, y = np.linalg.eigh((h + h.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        top = min(k, len(values))
        u, au = v @ y[:, :top], av @ y[:, :top]
        r = au - u * values[:top]
        size = np.linalg.norm(r, axis=0)
        scale = max(abs(values[0]), 1e-300)
        locked = int((size <= limit * scale).cumprod().sum())
        if locked == top:
            # products of the vectors themselves, and all of them once more by Rayleigh-Ritz
            u = np.linalg.qr(u)[0]
            au = product(u)
            values, y = np.linalg.eigh((u.T @ au + au.T @ u) / 2)
            values, u, au = values[::-1], u @ y[:, ::-1], au @ y[:, ::-1]
            error = float(np.linalg.norm(au - u * values, axis=0).max(initial=0.0)) / scale
            # what the rounding of products allows is reached when another round does not help
            idle = 0 if error < best / 2 else idle + 1
            best = min(best, error)
            if error <= 2 * limit or idle > 2:
                return values, u, error
            rest = _orthogonal(v, u)
            rest = rest[:, : max(0, most - top)]
            v, av = np.concatenate((u, rest), 1), np.concatenate((au, product(rest)), 1) if rest.shape[1] else au
            if v.shape[1] == d and d <= most:
                return values, u, error
            continue
        if v.shape[1] >= min(most, d) and d > most:
            keep = min(KEPT, v.shape[1])
            v, av = v @ y[:, :keep], av @ y[:, :keep]
            u, au = v[:, :top], av[:, :top]
        theta = values[locked:top]
        right = -(r[:, locked:top])
        q = u

        def project(x: np.ndarray) -> np.ndarray:
            return x - q @ (q.T @ x)

        t = minres(lambda x: project((lambda z: product(z) - z * theta)(project(x))), project(right), INNER)
        new = _orthogonal(t, v)
        if not new.shape[1]:  # the equations have nothing to add: another direction
            new = _orthogonal(rng.standard_normal((d, 1)), v)
        if not new.shape[1]:  # the subspace is the whole space
            limit = np.inf
            continue
        new = new[:, : d - v.shape[1]]
        v, av = np.concatenate((v, new), 1), np.concatenate((av, product(new)), 1)


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = common.cut(scaled(embeddings), "scaled")
    common_size = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if common_size is None:
        return spark.createDataFrame([], schema)
    d = common_size[0]
    rows_d = rows.where(F.col("size") == d)
    n, total = sums(rows_d, d)
    s = np.array(total, np.int64) if max(map(abs, total)) < 1 << 62 else np.array(total, object)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            if b.num_rows:
                held.append(centred(_matrix(b.column(0)), n, s))
                size += b.num_rows
            if size >= BLOCK:
                yield pa.RecordBatch.from_pydict({"c": pa.array([np.concatenate(held).tobytes()], pa.binary())})
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"c": pa.array([np.concatenate(held).tobytes()], pa.binary())})

    blocks = common.cut(rows_d.select("x").repartition(common.partitions(rows)).mapInArrow(block, "c binary"), "centred")
    many = blocks.rdd.getNumPartitions() > 256

    def product(v: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            out = np.zeros((d, v_columns))
            for b in batches:
                for raw in b.column(0):
                    c = np.frombuffer(raw.as_buffer()).reshape(-1, d)
                    out += c.T @ (c @ sent.value)
            yield out

        v_columns = v.shape[1]
        total_ = added(blocks, run, (d, v_columns), many) / n
        sent.unpersist()
        return total_

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        out = np.zeros(1)
        for b in batches:
            for raw in b.column(0):
                out += np.square(np.frombuffer(raw.as_buffer())).sum()
        yield out

    trace = float(added(blocks, squares, (1,), many)[0]) / n
    if not trace > 0:
        return spark.createDataFrame([], schema)
    values, u, _ = leading(product, d, min(k, d))
    varied = values > trace * d * 1e-15
    values, u = values[varied], u[:, varied]
    m = len(values)
    scale = np.sqrt(values)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        out = np.zeros((m + 1, m))
        for b in batches:
            for raw in b.column(0):
                w = (np.frombuffer(raw.as_buffer()).reshape(-1, d) @ u) / scale
                out[0] += w.sum(0)
                out[1:] += w.T @ w
        yield out

    moments = added(blocks, whitened, (m + 1, m), many) / n  # of centred rows: the mean is rounding only
    error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(m)).max())
    explained = values / trace

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                p = b.slice(lo, BLOCK)
                x = _matrix(p.column(1))
                w = (centred(x, n, s) @ u) / scale
                rows_ = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        p.column(0).take(pa.array(np.repeat(np.arange(rows_), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * m, n)),
                        pa.array(deviations(x, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(rows_), m))), pa.array(w.ravel()), pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * m, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows_d.select("vec_id", "x").mapInArrow(out, schema)


def op12_whitened_vectors(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Embedding whitening by cyclic Jacobi.

Vectors become integers x = floor(scale * c) + shift. The fit list, every distinct x vector once,
is written; tasks sum it exactly and build centred scatters, batch by batch, which are merged as a
tree with the means' own share. The driver turns the covariance with symmetric Jacobi rotations,
all pairs a sweep in rounds of disjoint pairs, until every off-diagonal entry has vanished beside
its diagonal ones, which keeps small eigenvalues accurate. Components are sorted by eigenvalue and
the whitening matrix is broadcast (dimension x components numbers). A last pass over the fit list
measures the covariance of the whitened vectors.

Defined results: a vector that is null, empty, holds a null or non-finite entry, or an x beyond
2**62, takes no part. Vectors of different length have fits of their own. A null id is kept,
repeated ids are rows each, whether their vectors agree or not. Where the fit list does not reach
in a direction (eigenvalue at most dimension * 2**-52 of the largest; one distinct vector; more
dimensions than vectors) ``whitened`` is null and the component stays out of the identity error.
``explained`` is null where nothing varies. A ``deviation`` beyond a long is shown as the largest
long. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.session import forget, written

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: Partial moments that one merge takes; sweeps of rotations at most.
FAN, SWEEPS = 32, 60
EPS = 2.0**-52
MOST = 2**63 - 1


def integers(lists: pa.Array, scale: float, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows that take part, their x) by length of the vectors."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        bad = np.concatenate([[0], np.cumsum(~(np.abs(x) + abs(shift) < 2.0**62))])
    end = np.cumsum(n)
    ok = (n > 0) & (bad[end] == bad[end - n])
    for d in np.unique(n[ok]).tolist():
        rows = np.flatnonzero(ok & (n == d))
        yield rows, x[(end - n)[rows, None] + np.arange(d)].astype(np.int64) + shift


def _keys(x: np.ndarray) -> Iterator[bytes]:
    """One string of bytes per row: narrow where all its entries are, so equal rows have equal strings."""
    narrow = np.abs(x).max(axis=1) < 2**31
    for row, small in zip(x, narrow.tolist(), strict=True):
        yield row.astype("<i4").tobytes() if small else row.astype("<i8").tobytes()


def _matrix(keys: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(keys), d), np.int64)
    wide = [len(k) == 8 * d for k in keys]
    if not any(wide):
        return np.frombuffer(b"".join(keys), "<i4").reshape(-1, d).astype(np.int64)
    for i, (k, w) in enumerate(zip(keys, wide, strict=True)):
        out[i] = np.frombuffer(k, "<i8" if w else "<i4")
    return out


def fit_list(vectors: DataFrame, *, vector_col: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """(d, x): every distinct x vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in integers(b.column(0), scale, shift):
                keys = list(dict.fromkeys(_keys(x)))
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(keys), pa.int32()), pa.array(keys, pa.binary())], names=["d", "x"])

    # partial aggregation takes copies together before the shuffle
    return vectors.select(F.col(vector_col).cast("array<double>")).mapInArrow(run, "d int, x binary").distinct()


class Moments:
    """n, exact sums and the centred scatter of rows; two of them merge."""

    def __init__(self, n: int, total: list[int], mean: np.ndarray, scatter: np.ndarray):
        self.n, self.total, self.mean, self.scatter = n, total, mean, scatter

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        n = len(x)
        if x.dtype.kind == "i":
            few = n * int(np.abs(x).max()) < 2**62
            total = x.sum(axis=0).tolist() if few else [sum(c) for c in x.T.tolist()]
            mean = np.array([t / n for t in total])
            # the whole part of the mean goes first, exactly
            whole = np.floor(mean).astype(np.int64)
            off = (x - whole) - np.array([(t - int(w) * n) / n for t, w in zip(total, whole.tolist(), strict=True)])
        else:
            total, mean = [], x.mean(axis=0)
            off = x - mean
        return cls(n, total, mean, off.T @ off)

    def merge(self, o: Moments) -> Moments:
        n = self.n + o.n
        if self.total:
            # the difference of two means from exact sums
            apart = np.array([(b * self.n - a * o.n) / (self.n * o.n) for a, b in zip(self.total, o.total, strict=True)])
            total = [a + b for a, b in zip(self.total, o.total, strict=True)]
            mean = np.array([t / n for t in total])
        else:
            apart, total = o.mean - self.mean, []
            mean = self.mean + apart * (o.n / n)
        return Moments(n, total, mean, self.scatter + o.scatter + np.outer(apart, apart) * (self.n * o.n / n))


def moments(fit: DataFrame, of: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, Moments]:
    """Moments of ``of(d, x)`` over a written fit list, by length; merged as a tree, one matrix a length reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, Moments] = {}
        for b in batches:
            ds, keys = b.column(0).to_numpy(), b.column(1)
            for d in np.unique(ds).tolist():
                m = Moments.of(of(d, _matrix(keys.filter(pa.array(ds == d)).to_pylist(), d)))
                held[d] = held[d].merge(m) if d in held else m
        rows = [(d, TaskContext.get().partitionId(), pickle.dumps(m, protocol=5)) for d, m in held.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["d", "part", "m"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in pdf.sort_values("part")["m"]:
            m = pickle.loads(m)
            out = m if out is None else out.merge(m)
        return pd.DataFrame({"d": pdf["d"][:1], "part": pdf["part"][:1] // FAN, "m": [pickle.dumps(out, protocol=5)]})

    schema = "d int, part long, m binary"
    parts, level = fit.rdd.getNumPartitions(), fit.mapInArrow(run, schema)
    while parts > 1:
        level = level.groupBy("d", F.floor(F.col("part") / FAN).alias("above")).applyInPandas(lambda pdf: merge(pdf), schema)
        parts = -(-parts // FAN)
    return {d: pickle.loads(m) for d, _, m in level.collect()}


def _rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of 0 to d - 1 once, in rounds of disjoint pairs: one stands, the others go round."""
    ring = list(range(d + d % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:]), strict=True) if a < d and b < d]
        yield np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, by cyclic Jacobi rotations."""
    a, d = np.array(matrix, np.float64), len(matrix)
    v = np.eye(d)
    rounds = list(_rounds(d)) if d > 1 else []
    least = EPS * EPS * np.abs(np.diag(a)).sum()
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            turn = np.abs(apq) > np.maximum(EPS * np.sqrt(np.abs(app * aqq)), least)
            if not turn.any():
                continue
            turned = True
            p, q, apq, app, aqq = p[turn], q[turn], apq[turn], app[turn], aqq[turn]
            with np.errstate(over="ignore"):
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m in (a.T, a, v.T):  # columns of a, rows of a, columns of v
                mp, mq = m[p], m[q]
                m[p], m[q] = c[:, None] * mp - s[:, None] * mq, s[:, None] * mp + c[:, None] * mq
            a[p, p], a[q, q], a[p, q], a[q, p] = app - t * apq, aqq + t * apq, 0.0, 0.0
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    v = v / np.linalg.norm(v, axis=0)
    # one of the two signs: the largest entry is positive
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return values[order], v


@dataclass
class Whitening:
    """A fit: counts, exact sums, falling eigenvalues, unit eigenvectors (columns), share of each, and the measured error."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray | None
    identity_error: float = 0.0

    def known(self) -> np.ndarray:
        """Components in whose direction the fit list varies."""
        return self.values > max(len(self.total) * EPS * float(self.values[0]), 0.0) if len(self.values) else np.zeros(0, bool)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """x - S/n on each component over the root of its eigenvalue; NaN where that is not known."""
        whole = np.array([t // self.n for t in self.total], np.int64)
        off = (x - whole) - np.array([t % self.n / self.n for t in self.total])
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.known(), off @ self.vectors / np.sqrt(np.where(self.known(), self.values, 1.0)), np.nan)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2, exactly."""
        far = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.total), default=0)
        if far < 2**62:
            off = self.n * x - np.array(self.total, np.int64)
            if len(self.total) * int(np.abs(off).max(initial=0)) ** 2 < 2**63:
                return (off * off).sum(axis=1)
        return np.array([min(sum((self.n * a - s) ** 2 for a, s in zip(row, self.total, strict=True)), MOST) for row in x.tolist()], np.int64)


def fit(vectors: DataFrame, *, components: int = COMPONENTS, vector_col: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> dict[int, Whitening]:
    """The whitening of each length of vectors, up to ``components`` of them."""
    rows = written(fit_list(vectors, vector_col=vector_col, scale=scale, shift=shift), "whitening-fit")
    out = {}
    for d, m in moments(rows, lambda d, x: x).items():
        covariance = m.scatter / m.n
        values, v = jacobi((covariance + covariance.T) / 2)
        trace = float(values.sum())
        k = min(components, d)
        out[d] = Whitening(m.n, m.total, np.maximum(values[:k], 0.0), v[:, :k], np.maximum(values[:k], 0.0) / trace if trace > 0 else None)
    shared = vectors.sparkSession.sparkContext.broadcast(out)
    if any(w.known().any() for w in out.values()):
        for d, m in moments(rows, lambda d, x: np.nan_to_num(shared.value[d].whiten(x))).items():
            known = out[d].known()
            apart = np.abs(m.scatter / m.n - np.eye(len(known)))[np.ix_(known, known)]
            out[d].identity_error = float(apart.max(initial=0.0))
    forget(rows)
    return out


def whiten(vectors: DataFrame, fits: dict[int, Whitening], *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, n, deviation, whitened array, explained array, identity_error) of every vector that takes part."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in integers(b.column(1), scale, shift):
                w = shared.value[x.shape[1]]
                y, m, k = w.whiten(x), len(rows), len(w.values)
                offsets = pa.array(np.arange(0, m * k + 1, k, dtype=np.int32))
                share = np.full(k, np.nan) if w.explained is None else w.explained
                lists = [pa.ListArray.from_arrays(offsets, pa.array(z.ravel(), pa.float64(), from_pandas=True)) for z in (y, np.tile(share, m))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array([w.n] * m, pa.int64()), pa.array(w.deviation(x), pa.int64()), *lists, pa.array([w.identity_error] * m, pa.float64())],
                    names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, schema)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = whiten(vectors, fit(vectors))
    each = rows.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "z"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("z.whitened").alias("whitened"), F.col("z.explained").alias("explained"), "identity_error")

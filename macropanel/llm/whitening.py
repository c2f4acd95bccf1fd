"""Operator 12: embedding whitening by mixed-precision eigenvectors.

The vectors are whole numbers (`levels`), and each distinct one is fitted once. Two passes add up what tasks send, one
partial a task: n and the sums S, then the products of the vectors less the whole number nearest to their mean. All
of that is exact (products of 20-bit digits in doubles, sums as decimals), so that the covariance is a quotient of
whole numbers, however far the vectors are from zero.

Its eigenvectors are found in float32 and corrected by the matrix multiplications of Ogita and Aishima in extended
precision; each round about doubles the digits. Eigenvalues that a round cannot tell apart are a cluster: the small
problem within its vectors is solved by itself, shifted by its mean, and the next round tells them apart.

Only sums of d x d numbers reach the driver, the model that goes back is d x k. Vectors of unlike lengths are fits of
their own, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import land, table

LARGEST = 2.0**33  # parts from here on have no exact level
CHUNK = 1024  # vectors multiplied at once: products of 21-bit digits and their sums are exact in doubles
FLUSH = 1 << 20  # vectors of a partial
DIGIT = 20
ROUNDS = 20
FLAT = 1e-15  # eigenvalues below this part of the largest count as 0
GROUPS = 64  # partials of the check of the result that reach the driver

Wide = np.longdouble


def levels(vectors: DataFrame, vec: str = "embedding", *, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """`(vec_id, x)` with x = floor(scale * c) + offset of each part c.

    Rows whose vector is null or empty or holds a null, a non-finite part or one of 2**33 or more (which has no exact
    level) are left out. Repeated ids are rows of their own. Other columns are not looked at.
    """
    parts = F.transform(F.col(vec), lambda c: c.cast("double"))
    bad = F.exists(parts, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    x = F.transform(parts, lambda c: F.floor(c * scale).cast("long") + offset)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(~bad, x).alias("x")).where(F.size("x") > 0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                n, high, low = n + len(x), high + (x >> DIGIT).sum(axis=0), low + (x & ((1 << DIGIT) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array([n] * len(low), pa.int64()), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "i int, n long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    rows = sorted(parts.groupBy("i").agg(*exact).collect(), key=lambda r: r.i)
    return int(rows[0].n), [(int(r.high) << DIGIT) + int(r.low) for r in rows]


def _products(fit: DataFrame, centre: list[int]) -> list[list[int]]:
    """The sums of the products of all parts less `centre`."""
    d = len(centre)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, (i, j) = np.array(centre, np.int64), np.triu_indices(d)
        total, n = np.zeros((3, d, d), np.int64), 0

        def rows() -> pa.RecordBatch:
            columns = [pa.array(x.astype(np.int32)) for x in (i, j)] + [pa.array(t[i, j]) for t in total]
            return pa.RecordBatch.from_arrays(columns, names=["i", "j", "high", "mid", "low"])

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                y = _matrix(batch.slice(at, CHUNK)) - middle
                low = ((y + (1 << DIGIT - 1)) & ((1 << DIGIT) - 1)) - (1 << DIGIT - 1)
                high = ((y - low) >> DIGIT).astype(np.float64)
                low = low.astype(np.float64)
                total[2] += (low.T @ low).astype(np.int64)
                if high.any():
                    both = (high.T @ low).astype(np.int64)
                    total[1] += both + both.T
                    total[0] += (high.T @ high).astype(np.int64)
                n += len(y)
                if n >= FLUSH:
                    yield rows()
                    total[:], n = 0, 0
        if n:
            yield rows()

    parts = fit.select("x").mapInArrow(run, "i int, j int, high long, mid long, low long")
    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "mid", "low")]
    out = [[0] * d for _ in range(d)]
    for r in parts.groupBy("i", "j").agg(*exact).toLocalIterator():
        out[r.i][r.j] = out[r.j][r.i] = (int(r.high) << 2 * DIGIT) + (int(r.mid) << DIGIT) + int(r.low)
    return out


def quotient(a: int, b: int) -> Wide:
    """a / b to the last digit of the extended precision, for whole numbers of any size."""
    if not a:
        return Wide(0)
    shift = 96 - abs(a).bit_length() + b.bit_length()
    q = (abs(a) << shift) // b if shift >= 0 else abs(a) // (b << -shift)
    whole = sum(np.ldexp(Wide(q >> 32 * k & 0xFFFFFFFF), 32 * k) for k in range(3, -1, -1))
    return np.ldexp(whole, -shift) * (1 if a > 0 else -1)


def _norm(m: np.ndarray) -> float:
    return float(np.linalg.norm(m.astype(np.float64), 2)) if m.size else 0.0


def refined_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix in extended precision."""
    a = a.astype(Wide)
    top = np.abs(a).max(initial=0)
    if not top:
        return np.zeros(len(a), Wide), np.eye(len(a), dtype=Wide)
    a = a / top
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(Wide)
    unit, size, least = np.eye(len(a), dtype=Wide), _norm(a), len(a) * np.finfo(Wide).eps
    for _ in range(ROUNDS):
        r, s = unit - x.T @ x, x.T @ (a @ x)
        s = (s + s.T) / 2
        value = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(value, kind="stable")
        x, value, r, s = x[:, order], value[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        apart = 2 * (_norm(s - np.diag(value)) + size * _norm(r))
        gap = value[None, :] - value[:, None]
        told = np.abs(gap) > apart
        # (s + value[j] r) / gap, written as r / 2 and what turns the axes without stretching them.
        middle = (value[None, :] + value[:, None]) / 2
        e = r / 2 + np.where(told, (s + middle * r) / np.where(told, gap, 1), 0)
        x = x + x @ e
        step = np.abs(e).max()
        # Values that are not told apart: their own problem, shifted, so that its digits go to the differences.
        for some in np.split(np.arange(len(a)), np.flatnonzero(np.diff(value) > apart) + 1):
            if len(some) > 1:
                part = x[:, some]
                inner = part.T @ (a @ part - part * value[some].mean())
                inner = (inner + inner.T) / 2
                widest = np.abs(inner).max()
                if np.abs(inner - np.diag(np.diag(inner))).max() > least:
                    turn = np.linalg.eigh((inner / widest).astype(np.float64))[1].astype(Wide)
                    x[:, some] = part @ (turn @ (3 * np.eye(len(some), dtype=Wide) - turn.T @ turn) / 2)
                    step = np.inf
        if step <= least:
            break
    for _ in range(2):
        x = x + x @ (unit - x.T @ x) / 2
    value = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-value, kind="stable")
    x = x[:, order]
    return value[order] * top, x / np.sqrt((x * x).sum(axis=0))


@dataclass
class Whitening:
    """What whitens vectors of one length: x is taken apart into x - centre - rest / n."""

    n: int
    centre: list[int]
    rest: list[int]
    axes: np.ndarray  # (d, k) unit eigenvectors
    values: np.ndarray  # (k) their eigenvalues
    explained: np.ndarray  # (k) their part of the trace
    error: float = 0.0

    def rows(self, x: np.ndarray) -> np.ndarray:
        """The whitened vectors; NaN on axes without variance."""
        mean = np.array([r / self.n for r in self.rest])
        found = ((x - np.array(self.centre, np.int64)) - mean) @ self.axes
        flat = self.values <= FLAT * max(self.values.max(initial=0), 0)
        return found / np.sqrt(np.where(flat, np.nan, self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)**2 of each vector, exact; None where that is no 64-bit integer."""
        y = x - np.array(self.centre, np.int64)
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest))
        if len(self.rest) * most * most < 1 << 63:
            v = self.n * y - np.array(self.rest, np.int64)
            return (v * v).sum(axis=1).tolist()
        whole = (sum((self.n * p - r) ** 2 for p, r in zip(row, self.rest)) for row in y.tolist())
        return [v if v < 1 << 63 else None for v in whole]


def fit(distinct: DataFrame, most: int = 16) -> Whitening:
    """The whitening of the vectors `x` of one length, each of which counts once."""
    n, sums = _sums(distinct)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    products = _products(distinct, centre)
    # n**2 times the covariance, in whole numbers.
    whole = [[n * p - a * b for p, b in zip(row, rest)] for row, a in zip(products, rest)]
    values, axes = refined_eigen(np.array([[quotient(w, n * n) for w in row] for row in whole], Wide))
    k = min(most, len(sums))
    trace = quotient(sum(whole[i][i] for i in range(len(whole))), n * n)
    explained = values[:k] / trace if trace else np.zeros(k, Wide)
    found = Whitening(n, centre, rest, axes[:, :k].astype(np.float64), values[:k].astype(np.float64), explained.astype(np.float64))
    found.error = _identity_error(distinct, found)
    return found


def _merge(parts: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and centred products of several sets together."""

    def add(a, b):
        n = a[0] + b[0]
        apart = b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)

    return reduce(add, parts)


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry of |covariance - identity| of the whitened vectors, over the axes that have variance."""
    keep = np.flatnonzero(model.values > FLAT * max(model.values.max(initial=0), 0))
    k = len(keep)
    if not k:
        return 0.0
    kind = "part int, n long, mean binary, products binary"

    def row(part: int, found) -> pa.RecordBatch:
        n, mean, products = found
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], names=["part", "n", "mean", "products"])

    def sets(columns) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for n, mean, products in columns:
            yield n, np.frombuffer(mean), np.frombuffer(products).reshape(k, k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                w = model.rows(_matrix(batch))[:, keep]
                mean = w.mean(axis=0)
                own = len(w), mean, (w - mean).T @ (w - mean)
                found = _merge((found, own)) if found else own
        if found:
            yield row(TaskContext.get().partitionId() % GROUPS, found)

    def united(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([row(rows["part"][0].as_py(), _merge(sets(zip(*(rows[c].to_pylist() for c in ("n", "mean", "products"))))))])

    parts = distinct.select("x").mapInArrow(run, kind).groupBy("part").applyInArrow(united, kind).collect()
    n, _, products = _merge(sets((r.n, bytes(r.mean), bytes(r.products)) for r in parts))
    return float(np.abs(products / n - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, *, most: int = 16) -> DataFrame:
    """One row for each vector `(vec_id, x)` and component up to `most`: `component` from 1 by falling eigenvalue,
    `n` distinct vectors of its length, `deviation` = sum((n x - S)**2) (null beyond 64 bits), `whitened`, `explained`,
    and `identity_error` of the whole fit.

    `whitened` is null on components without variance (eigenvalues below 1e-15 of the largest: fewer distinct vectors
    than components, or constant parts); they don't count in `identity_error`. Vectors of another length are fitted by
    themselves. An empty table gives no rows.
    """
    spark = rows.sparkSession
    distinct = land(rows.select("x").distinct())
    lengths = sorted(r.d for r in distinct.select(F.size("x").alias("d")).distinct().collect())
    out = spark.createDataFrame([], WHITENED)
    for d in lengths:
        same = F.size("x") == d
        out = out.unionByName(_applied(rows.where(same), fit(distinct.where(same), most)))
    return out


def _applied(rows: DataFrame, model: Whitening) -> DataFrame:
    k = len(model.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                x, count = _matrix(batch), batch.num_rows
                again = pa.array(np.repeat(np.arange(count), k))
                columns = [
                    batch.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()), pa.array(np.full(count * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(again), pa.array(model.rows(x).ravel(), pa.float64(), from_pandas=True),
                    pa.array(np.tile(model.explained, count)), pa.array(np.full(count * k, model.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WHITENED.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, WHITENED)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(levels(table(spark, sf_dir, "embeddings")))

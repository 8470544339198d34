"""Whitening of embeddings: principal components of a distributed covariance, found without an eigenvalue library.

Entries become integers first, ``floor(64 * c) + 1000000``, so that sums over any number of rows are exact. Three passes
read the vectors: the exact sums, the products of the centred rows, and the covariance of the result as a check. Each
task adds up its own products; a task's matrix leaves it as rows, which are added by row number, so that only one matrix
(dimension squared) reaches the driver, whatever the number of vectors. There it is brought to tridiagonal form by
Householder reflections; the leading eigenvalues are found by bisection on Sturm counts and their vectors by inverse
iteration, those of close eigenvalues made orthogonal to each other. The projection is broadcast.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are left out, and so are rows of
another length than the most common one (of equally common ones the longest); entries beyond 2**40 count as 2**40.
Components whose eigenvalue is not above ``RANK_SHARE`` of the largest cannot be told from rounding and are left out: a
single vector, or equal ones, give no components. A ``deviation`` of more than 38 digits is null. Repeated rows stay
repeated, an empty table gives no rows, and columns that are not asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = 2.0**40
RANK_SHARE = 1e-11
EPS = np.finfo(np.float64).eps


# ---- eigenvalues and vectors of a symmetric matrix ----


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors (the k-th acts on the entries from k + 1 on)."""
    a = np.array(matrix, dtype=np.float64)
    size = len(a)
    mirrors = []
    for k in range(size - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        v = x.copy()
        v[0] += np.copysign(length, x[0])
        norm = np.linalg.norm(v)
        if not norm:
            mirrors.append(np.zeros_like(v))
            continue
        v /= norm
        mirrors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        p -= (v @ p) * v
        rest -= np.outer(v, p) + np.outer(p, v)
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, x[0])
        a[k + 2 :, k] = a[k, k + 2 :] = 0
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each of ``at``: negative pivots of the shifted matrix."""
    squares = off * off
    least = np.finfo(np.float64).tiny * max(1.0, squares.max(initial=0.0))
    count = np.zeros(len(at), dtype=np.int64)
    q = diagonal[0] - at
    for i in range(len(diagonal)):
        q = q if not i else diagonal[i] - at - squares[i - 1] / q
        q = np.where(np.abs(q) < least, -least, q)  # a pivot of zero counts as a negative one
        count += q < 0
    return count


def norm_bounds(diagonal: np.ndarray, off: np.ndarray) -> tuple[float, float]:
    """An interval that holds all eigenvalues."""
    reach = np.zeros(len(diagonal))
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    lo, hi = float((diagonal - reach).min()), float((diagonal + reach).max())
    slack = 4 * EPS * max(abs(lo), abs(hi)) + np.finfo(np.float64).tiny
    return lo - slack, hi + slack


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted`` largest eigenvalues, falling, by bisection of all of them at once."""
    wanted = min(wanted, len(diagonal))
    below = len(diagonal) - 1 - np.arange(wanted)  # eigenvalues below the k-th largest
    lo, hi = (np.full(wanted, x) for x in norm_bounds(diagonal, off))
    while True:
        middle = lo + (hi - lo) / 2
        if ((middle <= lo) | (middle >= hi) | (hi - lo <= EPS * np.maximum(np.abs(lo), np.abs(hi)))).all():
            return middle
        over = sturm_count(diagonal, off, middle) > below
        hi, lo = np.where(over, middle, hi), np.where(over, lo, middle)


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Elimination with row exchanges of the tridiagonal matrix less ``shift``; pivots below ``least`` are lifted to it."""
    size = len(diagonal)
    pivot, upper, second = diagonal - shift, np.append(off, 0.0), np.zeros(size)
    factor, swapped = np.zeros(size), np.zeros(size, dtype=bool)
    for i in range(size - 1):
        low = off[i]
        if abs(pivot[i]) >= abs(low):
            if abs(pivot[i]) < least:
                pivot[i] = least
            factor[i] = low / pivot[i]
            pivot[i + 1] -= factor[i] * upper[i]
        else:
            swapped[i] = True
            factor[i] = pivot[i] / low
            pivot[i], above = low, upper[i]
            upper[i], pivot[i + 1] = pivot[i + 1], above - factor[i] * pivot[i + 1]
            if i < size - 2:
                second[i] = upper[i + 1]
                upper[i + 1] = -factor[i] * second[i]
    if abs(pivot[-1]) < least:
        pivot[-1] = least

    def solve(right: np.ndarray) -> np.ndarray:
        x = right.copy()
        for i in range(size - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
            else:
                x[i + 1] -= factor[i] * x[i]
        for i in range(size - 1, -1, -1):
            rest = upper[i] * x[i + 1] if i < size - 1 else 0.0
            rest += second[i] * x[i + 2] if i < size - 2 else 0.0
            x[i] = (x[i] - rest) / pivot[i]
        return x

    return solve


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) of falling eigenvalues by inverse iteration.

    Eigenvalues nearer to each other than a thousandth of the norm form a cluster: its vectors start from different
    random ones and are made orthogonal to those before them in every round.
    """
    size = len(diagonal)
    norm = max(map(abs, norm_bounds(diagonal, off)))
    random = np.random.default_rng(20)
    out = np.zeros((size, len(values)))
    first, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        shift = value if first == k else min(value, shift - 10 * EPS * norm)
        solve = solve_shifted(diagonal, off, shift, EPS * norm)
        x = random.standard_normal(size)
        for _ in range(rounds):
            x = solve(x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def leading_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix; the largest entry of each is positive."""
    largest = np.abs(matrix).max(initial=0.0)
    if not largest:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, mirrors = tridiagonal(matrix / largest)
    values = leading_eigenvalues(diagonal, off, wanted)
    values = values[values > RANK_SHARE * values[0]]
    vectors = vectors_of(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        vectors[k + 1 :] -= 2 * np.outer(mirrors[k], mirrors[k] @ vectors[k + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    peak = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return values * largest, vectors * np.where(peak < 0, -1.0, 1.0)


# ---- passes over the vectors ----


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of the integer entries, by dimension
    trace: float
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # columns
    identity_error: float = float("nan")

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Entries less their mean: whole parts are taken off as integers, so large means cost no digits."""
        return (x - self.base).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[str]:
        """Exact sums of (n * x - S) ** 2 as text."""
        near = x - self.base
        bound = self.n * (int(np.abs(near).max(initial=0)) + 1)
        kind = np.int64 if len(self.sums) * bound * bound < 2**63 else object
        far = near.astype(kind) * self.n - np.array(self.rest, dtype=kind)
        return [str(v) for v in (far * far).sum(axis=1)]


def usable(df: DataFrame, vector_col: str, keep: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows (keep, v) with whole finite vectors of the most common length, and that length."""
    entries = F.col(vector_col).cast("array<double>")
    rows = df.select(F.struct(*keep).alias("keep"), entries.alias("v"))
    whole = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(whole)
    common = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 0
    return rows.where(F.size("v") == width), width


def integers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(SCALE * np.clip(v, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, dtype=object), 0
        for batch in batches:
            x = integers(batch, width)
            total = total + x.sum(axis=0).astype(object)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "total": pa.array([str(t) for t in total])})

    parts = rows.mapInArrow(add, "i int, n long, total string")
    sums = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("i").collect()
    return (sums[0]["n"], [int(r["total"]) for r in sums]) if sums else (0, [])  # one row per dimension


def products(rows: DataFrame, width: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the outer product of ``made(row)`` with itself."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = made(integers(batch, width))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(range(len(total)), pa.int32()), "task": pa.array([task] * len(total), pa.int32()), "line": [r.tobytes() for r in total]}
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, line in zip(batch.column("i").to_pylist(), batch.column("line"), strict=True):
                lines[i] = lines.get(i, 0.0) + np.frombuffer(line.as_buffer(), dtype=np.float64)
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(lines), pa.int32()), "line": pa.array([x.tobytes() for x in lines.values()], pa.binary())})

    parts = rows.mapInArrow(multiply, "i int, task int, line binary").repartition("i").sortWithinPartitions("i", "task")
    lines = parts.mapInArrow(add, "i int, line binary").orderBy("i").collect()  # one row per dimension
    return np.array([np.frombuffer(r["line"], dtype=np.float64) for r in lines])


def fit(rows: DataFrame, width: int, components: int) -> Whitening | None:
    """The components of the rows' covariance; None without rows."""
    n, sums = exact_sums(rows, width) if width else (0, [])
    if not n:
        return None
    model = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((width, 0)))
    covariance = products(rows, width, model.centred) / n
    model.trace = float(np.trace(covariance))
    model.values, model.vectors = leading_components(covariance, components)
    if len(model.values):
        k = len(model.values)
        with_one = products(rows, width, lambda x: np.column_stack([model.whitened(x), np.ones(len(x))])) / n
        mean = with_one[:k, k]
        model.identity_error = float(np.abs(with_one[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whiten(df: DataFrame, vector_col: str, keep: Sequence[str], components: int = 32) -> tuple[DataFrame, Whitening | None]:
    """Rows (keep: struct, deviation: decimal(38,0), whitened: array of double) of all usable vectors, and the model."""
    rows, width = usable(df, vector_col, keep)
    kept = rows.schema["keep"].dataType
    schema = T.StructType([T.StructField("keep", kept), T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    model = fit(rows, width, components)
    if model is None:
        made = df.sparkSession.createDataFrame([], schema)
    else:
        sent = df.sparkSession.sparkContext.broadcast(model)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = integers(batch, width)
                w = sent.value.whitened(x)
                ends = pa.array(np.arange(0, w.size + 1, w.shape[1]) if w.shape[1] else np.zeros(len(x) + 1), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("keep"), pa.array(sent.value.deviation(x), pa.string()), lists], names=["keep", "deviation", "whitened"])

        made = rows.mapInArrow(project, schema)
    return made.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))")), model


def long_form(made: DataFrame, model: Whitening | None) -> DataFrame:
    """One row per kept row and component: (keep, component, n, deviation, whitened, explained, identity_error)."""
    shares = F.array(*[F.lit(x) for x in (model.explained if model else [])]).cast("array<double>")
    rows = made.select("keep", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "keep", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )

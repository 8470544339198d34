"""Sums of products for all pairs of columns at once.

A task adds up matrix products of its batches; what leaves it is one row per key and left column, with the sums for every
right column. These are added by key and column in the order of the tasks, so the work after the pass over the rows grows
with tasks x columns squared and not with the rows, and no aggregate per pair is planned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
HELD_NUMBERS = 4_000_000
PARTIAL = "k string, i int, task int, line binary"


def pair_moments(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, n, sx, sy, sxx, syy, sxy) for every pair of a left and a right column, or of ``left`` among itself (a
    not after b). The sums run over the rows where both are known, of the values less the column's overall mean: means and
    spreads that are far apart cost no digits. NaN counts as null.
    """
    keys, left = list(keys), list(left)
    among = right is None
    right = left if among else list(right)
    cols = list(dict.fromkeys([*left, *right]))
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)]
    rows = df.select((F.to_json(F.struct(*keys)) if keys else F.lit("{}")).alias("k"), *values)
    means = rows.agg(*[F.avg(f"c{i}") for i in range(len(cols))]).first()
    shift = np.array([m or 0.0 for m in means])
    at_left, at_right = [cols.index(c) for c in left], [cols.index(c) for c in right]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        task = TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            for k, total in sums.items():
                lines = [np.ascontiguousarray(total[:, i]).tobytes() for i in range(len(left))]
                columns = [[k] * len(left), pa.array(range(len(left)), pa.int32()), pa.array([task] * len(left), pa.int32()), pa.array(lines, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *columns[1:]], names=["k", "i", "task", "line"])
            sums.clear()

        for batch in batches:
            x = np.column_stack([batch.column(c + 1).to_numpy(zero_copy_only=False) for c in range(len(cols))]).astype(np.float64)
            known = ~np.isnan(x)
            x = np.where(known, x - shift, 0.0)
            codes = batch.column("k").dictionary_encode()
            number = codes.indices.to_numpy()
            for j, k in enumerate(codes.dictionary.to_pylist()):
                mine = number == j
                a, ma = x[mine][:, at_left], known[mine][:, at_left].astype(np.float64)
                b, mb = x[mine][:, at_right], known[mine][:, at_right].astype(np.float64)
                part = np.stack([ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b])
                sums[k] = sums[k] + part if k in sums else part
            if len(sums) * len(SUMS) * len(left) * len(right) > HELD_NUMBERS:
                yield from flush()
        yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def pairs() -> pa.RecordBatch:
            k, i = now
            j = np.arange(i if among else 0, len(right), dtype=np.int32)
            columns = [pa.array([k] * len(j), pa.string()), pa.array(np.full(len(j), i, dtype=np.int32)), pa.array(j)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(total[0, j].astype(np.int64)), *[pa.array(total[s, j]) for s in range(1, 6)]], names=["k", "i", "j", *SUMS])

        for batch in batches:
            for k, i, line in zip(batch.column("k").to_pylist(), batch.column("i").to_pylist(), batch.column("line"), strict=True):
                part = np.frombuffer(line.as_buffer(), dtype=np.float64).reshape(len(SUMS), len(right))
                if now == (k, i):
                    total = total + part
                    continue
                if now:
                    yield pairs()
                now, total = (k, i), part
        if now:
            yield pairs()

    partial = rows.mapInArrow(multiply, PARTIAL).repartition("k", "i").sortWithinPartitions("k", "i", "task")
    long = partial.mapInArrow(add, "k string, i int, j int, n bigint, sx double, sy double, sxx double, syy double, sxy double")
    named = [F.get(F.array(*map(F.lit, names)), F.col(at)).alias(to) for names, at, to in ((left, "i", "a"), (right, "j", "b"))]
    if not keys:
        return long.select(*named, *SUMS)
    known_keys = F.from_json("k", df.select(*keys).schema)
    return long.withColumn("k", known_keys).select(*[F.col("k")[c].alias(c) for c in keys], *named, *SUMS)


def spread(n: str, s: str, ss: str):
    """n^2 times the variance; null where it cannot be told from rounding."""
    total = F.col(n) * F.col(ss)
    value = total - F.col(s) * F.col(s)
    return F.when(value > total * 1e-13, value)


def correlation_of():
    """Correlation of a row of :func:`pair_moments`; null for a constant column."""
    return (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread("n", "sx", "sxx")) / F.sqrt(spread("n", "sy", "syy"))

"""Largest-triangle downsampling of long series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.values import epoch_seconds

HULL_ROWS = 8192


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the corner points of the convex hull; x is ascending and distinct."""
    keep: set[int] = set()
    for sign in (1.0, -1.0):
        stack: list[int] = []
        for i in range(len(x)):
            while len(stack) >= 2:
                a, b = stack[-2], stack[-1]
                turn = (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a])
                if sign * turn > 0:
                    break
                stack.pop()
            stack.append(i)
        keep.update(stack)
    return np.array(sorted(keep))


def largest_triangles(
    df: DataFrame, points: int, step_seconds: int, keys: Sequence[str] = ("series_id",), y: str = "y", ts: str = "timestamp"
) -> DataFrame:
    """Positions (``idx``) kept by the largest-triangle rule, with time and value; join on them to reduce other columns.

    For a given earlier pick, the triangle area is a linear function of a point, so its largest value in a bucket lies
    on a corner of the bucket's convex hull. Hulls are taken in pieces of the series in parallel; only hull corners and
    bucket means reach the step that walks the buckets in order.
    """
    if points < 3:
        raise ValueError("points must be at least 3")
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(epoch_seconds(F.col(ts))).alias("__lo"), F.count(F.lit(1)).alias("__n"))
    idx = ((epoch_seconds(F.col(ts)) - F.col("__lo")) / F.lit(step_seconds)).cast("bigint")
    rows = df.join(ends, on=keys).select(*keys, "__lo", "__n", idx.alias("idx"), F.col(y).cast("double").alias("v"))
    size = F.greatest((F.col("__n") - 2) / F.lit(float(points - 2)), F.lit(1.0))
    # Bucket b covers [int(b * size) + 1, int((b + 1) * size) + 1); the first row belongs to bucket 0.
    guess = F.floor((F.col("idx") - 1) / size)
    lower = lambda b: F.floor(b * size) + 1
    bucket = F.when(F.col("idx") < lower(guess), guess - 1).when(F.col("idx") >= lower(guess + 1), guess + 1).otherwise(guess)
    placed = rows.withColumn("bucket", F.when(F.col("idx") == 0, F.lit(-1)).otherwise(bucket).cast("bigint"))
    placed = placed.withColumn("piece", F.floor(F.col("idx") / F.lit(HULL_ROWS)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, values = pdf["idx"].to_numpy(dtype=float), pdf["v"].to_numpy()
        edges = np.flatnonzero(np.diff(pdf["bucket"].to_numpy())) + 1
        bounds = [0, *edges.tolist(), len(pdf)]
        kept = [begin + _hull(x[begin:end], values[begin:end]) for begin, end in zip(bounds, bounds[1:])]
        return pdf.iloc[np.concatenate(kept)]

    columns = [*keys, "__lo", "__n", "bucket", "piece", "idx", "v"]
    schema = f"{fields}, `__lo` bigint, `__n` bigint, bucket bigint, piece bigint, idx bigint, v double"
    small = placed.select(*columns).groupBy(*keys, "piece").applyInPandas(corners, schema)
    means = placed.groupBy(*keys, "bucket").agg(F.avg("v").alias("mean"))
    joined = small.join(means, on=[*keys, "bucket"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n, lo = int(pdf["__n"].iloc[0]), int(pdf["__lo"].iloc[0])
        if n <= points:
            kept = list(zip(pdf["idx"], pdf["v"]))
        else:
            width = (n - 2) / (points - 2)
            groups = {int(b): g for b, g in pdf.groupby("bucket")}
            mean = {b: float(g["mean"].iloc[0]) for b, g in groups.items()}
            first, last = groups[-1].iloc[0], pdf.iloc[-1]
            kept = [(int(first["idx"]), float(first["v"]))]
            for i in range(points - 2):
                # The rule starts one bucket in, so bucket 0 is skipped and the last bucket is cut before the last row.
                end = min(int((i + 2) * width) + 1, n - 1)
                group = groups.get(i + 1)
                a, va = kept[-1]
                ahead = mean.get(i + 2, float(last["v"]))
                best, chosen = -1.0, None
                if group is not None:
                    for j, v in zip(group["idx"], group["v"]):
                        if j >= end:
                            continue
                        area = abs((j - a) * (ahead - va) - (end - a) * (v - va))
                        if area > best:
                            best, chosen = area, (int(j), float(v))
                if chosen is not None:
                    kept.append(chosen)
            kept.append((int(last["idx"]), float(last["v"])))
        out = pd.DataFrame(kept, columns=["idx", "v"]).drop_duplicates("idx")
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out["lo"] = lo
        return out

    picked = joined.groupBy(*keys).applyInPandas(walk, f"{fields}, lo bigint, idx bigint, v double")
    at = F.timestamp_seconds(F.col("lo") + F.col("idx") * F.lit(step_seconds)).cast("timestamp_ntz")
    return picked.select(*keys, "idx", at.alias(ts), F.col("v").alias(y))

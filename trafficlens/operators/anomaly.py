"""Isolation forest on Spark: bounded samples per tree, trees built in parallel, rows scored where they are."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.operators.scale import quantiles

TREE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, size int, depth int"


def _expected_depth(n: np.ndarray | float) -> np.ndarray | float:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[list] = []
    stack = [(np.arange(len(points)), 0, None, None)]
    while stack:
        index, depth, parent, side = stack.pop()
        node = len(nodes)
        nodes.append([node, -1, 0.0, -1, -1, len(index), depth])
        if parent is not None:
            nodes[parent][side] = node
        if len(index) <= 1 or depth >= limit:
            continue
        part = points[index]
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if not len(open_features):
            continue
        feature = int(rng.choice(open_features))
        cut = float(rng.uniform(low[feature], high[feature]))
        below = part[:, feature] <= cut
        if below.all():
            continue
        nodes[node][1], nodes[node][2] = feature, cut
        stack.append((index[below], depth + 1, node, 3))
        stack.append((index[~below], depth + 1, node, 4))
    return [tuple(n) for n in nodes]


@dataclass
class ForestModel:
    """Trees as node tables: at most trees x (2 x samples - 1) nodes, whatever the size of the data."""

    cols: Sequence[str]
    trees: list[pd.DataFrame]
    sample_rows: int
    cut: float | None = None

    def scores(self, df: DataFrame, name: str = "anomaly_score_ml") -> DataFrame:
        """Lower scores are more anomalous; below 0 is an anomaly once a cut is set."""
        shared = df.sparkSession.sparkContext.broadcast(
            [{c: t[c].to_numpy() for c in ("feature", "cut", "left", "right", "size", "depth")} for t in self.trees]
        )
        scale = float(_expected_depth(self.sample_rows)) or 1.0
        offset = 0.0 if self.cut is None else self.cut

        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            x = np.nan_to_num(x, nan=0.0)
            total = np.zeros(len(x))
            for t in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    feature = t["feature"][at]
                    moving = feature >= 0
                    if not moving.any():
                        break
                    value = x[np.arange(len(x)), np.where(moving, feature, 0)]
                    step = np.where(value <= t["cut"][at], t["left"][at], t["right"][at])
                    at = np.where(moving, step, at)
                total += t["depth"][at] + _expected_depth(t["size"][at])
            return pd.Series(-np.power(2.0, -total / len(shared.value) / scale) - offset)

        return df.withColumn(name, F.pandas_udf(score, "double")(*[F.col(c).cast("double") for c in self.cols]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_score_ml`` and the 0/1 label ``is_anomaly_ml``."""
        return self.scores(df).withColumn("is_anomaly_ml", (F.col("anomaly_score_ml") < 0).cast("int"))


@dataclass
class IsolationForest:
    """Estimator: ``fit`` on training rows, then ``transform`` any rows."""

    cols: Sequence[str]
    id_cols: Sequence[str]
    trees: int = 100
    samples: int = 256
    contamination: float = 0.01
    seed: int = 42

    def _draws(self, base: DataFrame) -> DataFrame:
        """(tree, rows): up to ``samples`` rows for every tree, drawn from all rows by a hash of row and tree.

        A row is offered to a tree with a chance of a few times what the tree needs, so few rows are sorted however
        many there are; a small input is offered whole.
        """
        chance = min(1.0, 4 * self.samples / max(base.count(), 1))
        limit = F.lit(min(2**63 - 1, int(-(2**63) + 2**64 * chance)))
        trees = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.xxhash64(*self.id_cols, t, F.lit(self.seed)) <= limit)
        offered = base.withColumn("tree", F.explode(trees))
        draw = F.xxhash64(*self.id_cols, F.col("tree"), F.lit(self.seed))
        nth = F.row_number().over(Window.partitionBy("tree").orderBy(draw, *self.id_cols))
        return offered.withColumn("__nth", nth).where(F.col("__nth") <= self.samples)

    def fit(self, df: DataFrame) -> ForestModel:
        """Every tree sees up to ``samples`` rows, picked by a hash of the row's id and the seed."""
        cols, seed = list(self.cols), self.seed
        base = df.select(*self.id_cols, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
        picked = self._draws(base)
        limit = math.ceil(math.log2(max(self.samples, 2)))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            points = pdf.sort_values("__nth")[cols].to_numpy(dtype=float)
            nodes = _grow(points, np.random.default_rng([seed, tree]), limit)
            return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "cut", "left", "right", "size", "depth"])

        # Bounded by trees x samples, so the node table may come to the driver.
        table = picked.groupBy("tree").applyInPandas(build, TREE_SCHEMA).toPandas()
        trees = [t.sort_values("node").reset_index(drop=True) for _, t in table.groupby("tree")]
        rows = int(max(t["size"].iloc[0] for t in trees)) if trees else 0
        model = ForestModel(cols, trees, rows)
        scored = model.scores(base)
        model.cut = quantiles(scored, (), "anomaly_score_ml", {"c": self.contamination}).first()["c"]
        return model


def anomaly_points(df: DataFrame, ts: str = "timestamp", y: str = "y", keys: Sequence[str] = ("series_id",)) -> DataFrame:
    return df.where(F.col("is_anomaly_ml") == 1).select(*keys, ts, y)


def both_methods(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str], contamination: float = 0.01) -> DataFrame:
    """Forest labels next to the z-score flag ``is_spike``, with their agreement."""
    model = IsolationForest(cols, id_cols, contamination=contamination).fit(df)
    out = model.transform(df)
    if "is_spike" in df.columns:
        both = (F.col("is_spike") == 1) & (F.col("is_anomaly_ml") == 1)
        out = out.withColumn("anomaly_agreement", both.cast("int"))
    return out

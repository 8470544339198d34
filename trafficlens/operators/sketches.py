"""Mergeable summaries, for when exact quantiles or counts are not asked for.

A sketch is one binary value per group. Sketches of small groups (a window, an hour) can be stored and merged into those of
larger ones without another look at the rows, and no group ever meets in one task with more than its sketches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILE_K = 400
TRACKED_ITEMS = 10_000


def rank_error(k: int = QUANTILE_K) -> float:
    """Distance in rank, as a share of the rows, that a quantile of a sketch of size ``k`` keeps in 99 of 100 cases."""
    return 2.296 / k**0.9723


def quantile_sketches(df: DataFrame, keys: Sequence[str], col: str, k: int = QUANTILE_K) -> DataFrame:
    """(keys, sketch) of the non-null values; a group without values has no row."""
    rows = df.where(F.col(col).isNotNull())
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(col).cast("double"), F.lit(k)).alias("sketch"))


def merge_quantile_sketches(sketches: DataFrame, keys: Sequence[str], k: int = QUANTILE_K) -> DataFrame:
    """Sketches of coarser groups: ``keys`` are some of the keys the sketches have."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """(keys, n, one column per probability) out of sketches."""
    values = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs.values()]))
    found = sketches.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n"), values.alias("__q"))
    return found.select(*keys, "n", *[F.get("__q", F.lit(i)).alias(name) for i, name in enumerate(probs)])


def approximate_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: dict[str, float], k: int = QUANTILE_K) -> DataFrame:
    """The approximate form of ``scale.quantiles``: one aggregate, within :func:`rank_error` of the asked rank."""
    return sketch_quantiles(quantile_sketches(df, keys, col, k), keys, probs).drop("n")


def item_sketches(df: DataFrame, keys: Sequence[str], col: str, tracked: int = TRACKED_ITEMS) -> DataFrame:
    """(keys, n, items): frequent-item sketches of the non-null values; ``tracked`` bounds what a sketch remembers."""
    rows = df.where(F.col(col).isNotNull()).withColumn("__item", F.col(col).cast("string"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(__item, {int(tracked)})").alias("items"))


def merge_item_sketches(sketches: DataFrame, keys: Sequence[str], tracked: int = TRACKED_ITEMS) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(items, {int(tracked)})").alias("items"))


def count_error(tracked: int = TRACKED_ITEMS) -> float:
    """Largest error of an estimated count, as a share of all rows: 3.5 over the slots of the sketch's table."""
    return 3.5 / 2 ** math.ceil(math.log2(tracked / 0.75))


def frequent_items(sketches: DataFrame, keys: Sequence[str], top: int, tracked: int = TRACKED_ITEMS) -> DataFrame:
    """(keys, item, n, max_error): up to ``top`` most frequent items.

    An estimate is off by ``max_error`` at most. Every item with more than twice that many rows is among the estimates, as
    long as ``top`` has room for it; where the distinct items fit into the sketch, counts are exact.
    """
    picked = sketches.select(*keys, F.col("n").alias("__total"), F.explode(F.expr(f"approx_top_k_estimate(items, {int(top)})")).alias("__i"))
    bound = F.ceil(F.col("__total") * F.lit(count_error(tracked))).cast("bigint")
    return picked.select(*keys, F.col("__i.item").alias("item"), F.col("__i.count").alias("n"), bound.alias("max_error"))

"""Building blocks that keep ordered work spread out however long one series is.

A window over ``partitionBy(series)`` sends a whole series to one task. Here time is cut into chunks:

* row-bounded frames (lags, rolling statistics) run per chunk, with the neighbouring rows they need copied in;
* unbounded running values (sums, maxima, last value) run per chunk and add one carried value per chunk;
* ranks and quantiles run over distinct values with counts, in chunks between values drawn from the data.

The row-bounded form takes a regular grid: one row per step and series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trafficlens.functions.values import epoch_seconds
from trafficlens.session import cut_lineage

CHUNK = "__chunk"
CHUNK_ROWS = 4096
VALUE_CUTS = 1024
CUT_STEP = 32


def chunk_of(ts: Column, step_seconds: int, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number: whole chunks of ``rows`` grid steps since 1970."""
    return F.floor(epoch_seconds(ts) / F.lit(step_seconds * rows))


def halo(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step_seconds: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    chunk_rows: int = CHUNK_ROWS,
    then: Callable[[WindowSpec], dict[str, Column]] | None = None,
) -> DataFrame:
    """Add window columns whose frames reach ``back`` rows behind and ``ahead`` rows in front.

    ``build`` gets the window (per series and chunk, in time order) and returns the columns to add; ``then`` may
    add columns that use those of ``build``.
    """
    rows = max(chunk_rows, back, ahead)
    length = rows * step_seconds
    seconds = epoch_seconds(F.col(ts))
    own = F.floor(seconds / F.lit(length))
    offset = seconds - own * F.lit(length)
    targets = [own]
    if back:
        targets.append(F.when(offset >= F.lit((rows - back) * step_seconds), own + 1))
    if ahead:
        targets.append(F.when(offset < F.lit(ahead * step_seconds), own - 1))
    spread = df.withColumn(CHUNK, F.explode(F.array_compact(F.array(*targets))))
    window = Window.partitionBy(*keys, CHUNK).orderBy(ts)
    out = spread.withColumns(build(window))
    if then:
        out = out.withColumns(then(window))
    return out.where(F.col(CHUNK) == own).drop(CHUNK)


def with_known(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose keys are all known: the others belong to no series."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def whole_rows(df: DataFrame) -> DataFrame:
    """The same rows, read with all their columns.

    Where a frame feeds both sides of a join, pruning the columns of one side (or null filters on one side only) would
    make the two plans differ and run everything below twice. With equal needs the planner reuses the shuffle.
    """
    return df.where(F.xxhash64(*df.columns) <= F.lit(2**63 - 1))


def running(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step_seconds: int,
    columns: dict[str, tuple[str, str]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Unbounded running values. ``columns`` maps an output name to (kind, input column).

    Kinds: ``sum``, ``max``, ``min`` and ``last`` up to and including the row, ``max_before`` over the earlier rows,
    ``next`` for the first value at or after the row. Nulls are skipped.
    """
    keys = list(keys)
    chunked = df.withColumn(CHUNK, chunk_of(F.col(ts), step_seconds, chunk_rows))
    rows = with_known(chunked, [*keys, CHUNK]).repartition(*keys, CHUNK)

    def summary(kind: str, col: str) -> Column:
        if kind == "sum":
            return F.sum(col)
        if kind in ("max", "max_before"):
            return F.max(col)
        if kind == "min":
            return F.min(col)
        stamp = F.when(F.col(col).isNotNull(), F.col(ts))
        return F.max_by(col, stamp) if kind == "last" else F.min_by(col, stamp)

    totals = whole_rows(rows).groupBy(*keys, CHUNK).agg(*[summary(kind, col).alias(name) for name, (kind, col) in columns.items()])
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    before, after = chunks.rowsBetween(Window.unboundedPreceding, -1), chunks.rowsBetween(1, Window.unboundedFollowing)

    def carried(kind: str, name: str) -> Column:
        if kind == "sum":
            return F.sum(name).over(before)
        if kind in ("max", "max_before"):
            return F.max(name).over(before)
        if kind == "min":
            return F.min(name).over(before)
        if kind == "last":
            return F.last(name, ignorenulls=True).over(before)
        return F.first(name, ignorenulls=True).over(after)

    carry = totals.select(
        *keys, CHUNK, *[carried(kind, name).alias(f"__carry_{name}") for name, (kind, _) in columns.items()]
    )
    local = Window.partitionBy(*keys, CHUNK).orderBy(ts)
    so_far, earlier = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
    ahead = local.rowsBetween(0, Window.unboundedFollowing)

    def combined(kind: str, col: str, name: str) -> Column:
        past = F.col(f"__carry_{name}")
        if kind == "sum":
            inside = F.sum(col).over(so_far)
            return F.when(inside.isNull(), past).otherwise(inside + F.coalesce(past, F.lit(0)))
        if kind == "max":
            return F.greatest(F.max(col).over(so_far), past)
        if kind == "max_before":
            return F.greatest(F.max(col).over(earlier), past)
        if kind == "min":
            return F.least(F.min(col).over(so_far), past)
        if kind == "last":
            return F.coalesce(F.last(col, ignorenulls=True).over(so_far), past)
        return F.coalesce(F.first(col, ignorenulls=True).over(ahead), past)

    joined = rows.join(carry, on=[*keys, CHUNK], how="left")
    out = joined.withColumns({name: combined(kind, col, name) for name, (kind, col) in columns.items()})
    return out.drop(CHUNK, *[f"__carry_{name}" for name in columns])


def with_value_chunks(distinct: DataFrame, keys: Sequence[str], col: str, sums: dict[str, Column], cuts: int = VALUE_CUTS) -> DataFrame:
    """Rows of distinct values per key with ``CHUNK``, which grows with the value, and per key the aggregates ``sums``.

    The chunks of a key lie between about ``cuts`` of its values, drawn by a hash of the value: whatever the values look
    like, a chunk gets a small share of them. The drawing depends on nothing but the values, so a part of the job that is
    run again (a lost executor, a second branch of the plan) forms the same chunks. A row finds its chunk in two steps of
    ``CUT_STEP`` comparisons.
    """
    keys = list(keys)
    ends = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"), *[c.alias(n) for n, c in sums.items()])
    chance = F.pmod(F.xxhash64(F.col(col), F.lit("cut")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = distinct.join(ends, on=keys).where(chance * F.col("__m") < F.lit(float(cuts)))
    at = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list(col)).alias("__cuts"))
    heads = F.filter("__cuts", lambda x, i: i % CUT_STEP == CUT_STEP - 1)
    table = ends.join(at, on=keys, how="left").withColumn("__heads", heads).drop("__m")
    value = F.col(col)
    head = F.size(F.filter("__heads", lambda x: x <= value)) * CUT_STEP
    rest = F.size(F.filter(F.slice("__cuts", head + 1, CUT_STEP), lambda x: x <= value))
    chunk = F.when(F.col("__cuts").isNull(), 0).otherwise(head + rest)
    return distinct.join(table, on=keys).withColumn(CHUNK, chunk).drop("__cuts", "__heads")


def value_ranks(df: DataFrame, keys: Sequence[str], col: str, cuts: int = VALUE_CUTS) -> DataFrame:
    """Distinct values of ``col`` per key with ``cnt``, ``below`` (rows of smaller value) and ``total`` rows.

    Equal values collapse before the shuffle, so a value that holds most rows costs one row per map task. The running
    count then works in chunks of the values (:func:`with_value_chunks`).
    """
    keys = list(keys)
    anchor = keys or ["__all"]
    base = df if keys else df.withColumn("__all", F.lit(0))
    counts = base.where(F.col(col).isNotNull()).groupBy(*anchor, col).agg(F.count(F.lit(1)).alias("cnt"))
    binned = with_value_chunks(counts, anchor, col, {"total": F.sum("cnt")}, cuts)
    sums = binned.groupBy(*anchor, CHUNK).agg(F.sum("cnt").alias("__sum"))
    over_chunks = Window.partitionBy(*anchor).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    base_count = sums.select(*anchor, CHUNK, F.coalesce(F.sum("__sum").over(over_chunks), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*anchor, CHUNK).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.join(base_count, on=[*anchor, CHUNK]).select(
        *anchor, col, "cnt", (F.col("__base") + F.coalesce(F.sum("cnt").over(inside), F.lit(0))).alias("below"), "total"
    )
    return ranked if keys else ranked.drop("__all")


def quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear quantiles per key (all rows when no key is given). ``probs`` maps output name to probability."""
    ranks = value_ranks(df, keys, col)
    value = F.col(col).cast("double")
    aggs = []
    for name, p in probs.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        for tag, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (F.col("below") <= at) & (at < F.col("below") + F.col("cnt"))
            aggs.append(F.max(F.when(hit, value)).alias(f"__{name}_{tag}"))
    out = ranks.groupBy(*keys).agg(F.max("total").alias("__total"), *aggs)
    result = []
    for name, p in probs.items():
        place = (F.col("__total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        result.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return out.select(*keys, *result)


def column_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Exact linear quantiles of many columns at once: one row per key with columns ``<column>__<name>``.

    The columns are laid under each other, so the number of shuffles does not depend on how many there are. The laid-out
    values are written: three steps read them, and a plan of many columns is not carried into each.
    """
    keys = list(keys)
    pairs = F.array(*[F.struct(F.lit(c).alias("__col"), F.col(c).cast("double").alias("__x")) for c in cols])
    values = cut_lineage(df.sparkSession, df.select(*keys, F.inline(pairs)), "column-values")
    long = quantiles(values, [*keys, "__col"], "__x", probs)
    wide = [F.max(F.when(F.col("__col") == c, F.col(name))).alias(f"{c}__{name}") for c in cols for name in probs]
    return long.groupBy(*keys).agg(*wide)


def prefix_min(df: DataFrame, keys: Sequence[str], order: str, col: str, cuts: int = VALUE_CUTS) -> DataFrame:
    """Per key and distinct ``order`` value: ``least_before``, the minimum of ``col`` over all smaller values, and
    ``least_here``, the minimum at the value itself. Chunked over the values like ``value_ranks``.
    """
    keys = list(keys)
    best = df.where(F.col(order).isNotNull()).groupBy(*keys, order).agg(F.min(col).alias("least_here"))
    binned = with_value_chunks(best, keys, order, {}, cuts)
    sums = binned.groupBy(*keys, CHUNK).agg(F.min("least_here").alias("__min"))
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, CHUNK, F.min("__min").over(over_chunks).alias("__carry"))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return binned.join(carry, on=[*keys, CHUNK]).select(
        *keys, order, "least_here", F.least(F.min("least_here").over(inside), F.col("__carry")).alias("least_before")
    )


def run_starts(df: DataFrame, keys: Sequence[str], ts: str, step_seconds: int, state: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``run_start``: the epoch second at which the current run of equal ``state`` values began."""
    flagged = halo(
        df,
        keys,
        ts,
        step_seconds,
        lambda w: {"__first": F.row_number().over(w) == 1, "__before": F.lag(state).over(w)},
        back=1,
        chunk_rows=chunk_rows,
    )
    change = F.col("__first") | ~F.col(state).eqNullSafe(F.col("__before"))
    marked = flagged.withColumn("__mark", F.when(change, epoch_seconds(F.col(ts)))).drop("__first", "__before")
    return running(marked, keys, ts, step_seconds, {"run_start": ("max", "__mark")}, chunk_rows).drop("__mark")

"""Statistical tests, correlation, autocorrelation, decomposition and feature scoring as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.values import epoch_seconds, ratio
from trafficlens.operators.moments import correlation_of, pair_moments
from trafficlens.operators.scale import CHUNK_ROWS, halo, quantiles, value_ranks
from trafficlens.session import cut_lineage

SID = ("series_id",)


def correlations(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Upper triangle of the correlation matrix in long form: (a, b, r, n), from one matrix of moments."""
    pairs = pair_moments(df, cols, keys=keys).where(F.col("a") != F.col("b"))
    return pairs.select(*keys, "a", "b", correlation_of().alias("r"), "n")


def target_correlations(df: DataFrame, target: str, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return pair_moments(df, cols, [target], keys).select(*keys, "a", "b", correlation_of().alias("r"), "n")


def two_sample(df: DataFrame, flag: Column, y: str = "y", keys: Sequence[str] = SID) -> DataFrame:
    """Equal-variance t statistic and Cohen's d of the flagged rows against the rest."""
    inside, outside = F.when(flag, F.col(y)), F.when(~flag, F.col(y))
    sums = df.groupBy(*keys).agg(
        F.count(inside).alias("n1"), F.avg(inside).alias("mean1"), F.var_samp(inside).alias("var1"),
        F.count(outside).alias("n2"), F.avg(outside).alias("mean2"), F.var_samp(outside).alias("var2"),
    )
    pooled = ratio((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), F.col("n1") + F.col("n2") - 2)
    scale = F.sqrt(pooled * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    diff = F.col("mean1") - F.col("mean2")
    return sums.select(
        *keys, "n1", "n2", "mean1", "mean2",
        ratio(diff, scale).alias("t"),
        (F.col("n1") + F.col("n2") - 2).alias("df"),
        ratio(diff, F.sqrt(pooled)).alias("cohens_d"),
    )


def t_tail(t: float, df: float) -> float:
    """P(T > t) by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + top * d
                d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1.0 + top / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        two_sided = front * fraction(x, a, b) / a
    else:
        two_sided = 1.0 - front * fraction(1 - x, b, a) / b
    return two_sided / 2 if t >= 0 else 1 - two_sided / 2


def with_p_values(tests: DataFrame) -> DataFrame:
    """One-sided p-value of every t statistic (one row per series)."""
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else t_tail(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")

    return tests.withColumn("p_greater", F.pandas_udf(tail, "double")("t", "df"))


def anova(df: DataFrame, group: Column, y: str = "y", keys: Sequence[str] = SID) -> DataFrame:
    """One-way F statistic from the group sums."""
    cells = df.groupBy(*keys, group.alias("__g")).agg(
        F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")
    )
    # between = sum n m^2 - (sum n m)^2 / N
    sums = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("m")).alias("nm"),
    )
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("total")
    top, bottom = ratio(between, F.col("k") - 1), ratio(F.col("within"), F.col("total") - F.col("k"))
    return sums.select(
        *keys, ratio(top, bottom).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("total") - F.col("k")).alias("df_within")
    )


def kruskal(df: DataFrame, group: Column, y: str = "y", keys: Sequence[str] = SID) -> DataFrame:
    """Tie-corrected H. Ranks belong to distinct values, so equal values are ranked once."""
    keys = list(keys)
    cells = df.groupBy(*keys, y, group.alias("__g")).agg(F.count(F.lit(1)).alias("c"))
    ranks = value_ranks(df, keys, y).select(
        *keys, y, "cnt", "total", (F.col("below") + (F.col("cnt") + 1) / 2).alias("rank")
    )
    sums = cells.join(ranks, on=[*keys, y]).groupBy(*keys, "__g").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"), F.max("total").alias("all")
    )
    raw = sums.groupBy(*keys).agg(
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.max("all").cast("double").alias("all"), F.count(F.lit(1)).alias("k")
    )
    cnt = F.col("cnt").cast("double")
    ties = ranks.groupBy(*keys).agg(F.sum(cnt * cnt * cnt - cnt).alias("t"))
    n = F.col("all")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return raw.join(ties, on=keys).select(
        *keys, ratio(h, 1 - F.col("t") / (n * n * n - n)).alias("h"), (F.col("k") - 1).alias("df")
    )


def groups_above_mean(df: DataFrame, group: Column, name: str, y: str = "y", keys: Sequence[str] = SID) -> DataFrame:
    cells = df.groupBy(*keys, group.alias(name)).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    whole = cells.groupBy(*keys).agg((F.sum("__s") / F.sum("__n")).alias("overall_mean"))
    both = cells.join(whole, on=list(keys)).withColumn("mean", F.col("__s") / F.col("__n"))
    return both.where(F.col("mean") > F.col("overall_mean")).select(*keys, name, "mean", "overall_mean")


def acf(
    df: DataFrame, step_seconds: int, lags: int = 50, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Autocorrelation for lags 0..n: all lagged products in one pass over a chunked window."""
    keys = list(keys)
    mean = df.groupBy(*keys).agg(F.avg(y).alias("__m"))
    centered = df.join(mean, on=keys).withColumn("__c", F.col(y) - F.col("__m")).drop("__m")
    rows = halo(
        centered, keys, ts, step_seconds, lambda w: {f"__l{k}": F.lag("__c", k).over(w) for k in range(1, lags + 1)}, back=lags, chunk_rows=chunk_rows
    )
    sums = rows.groupBy(*keys).agg(
        F.sum(F.col("__c") * F.col("__c")).alias("c0"),
        *[F.sum(F.col("__c") * F.col(f"__l{k}")).alias(f"c{k}") for k in range(1, lags + 1)],
    )
    values = F.array(F.lit(1.0), *[ratio(F.coalesce(F.col(f"c{k}"), F.lit(0.0)), F.col("c0")) for k in range(1, lags + 1)])
    return sums.select(*keys, F.posexplode(values).alias("lag", "acf"))


def difference(
    df: DataFrame, step_seconds: int, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    rows = halo(df, keys, ts, step_seconds, lambda w: {"__d": F.col(y) - F.lag(y, 1).over(w)}, back=1, chunk_rows=chunk_rows)
    return rows.where(F.col("__d").isNotNull()).withColumn(y, F.col("__d")).drop("__d")


def pacf(correlogram: DataFrame, lags: int, keys: Sequence[str] = SID) -> DataFrame:
    """Partial autocorrelation (Yule-Walker) by the Levinson recursion over the at most ``lags`` + 1 values of a series."""
    keys = list(keys)

    def levinson(group):
        r = group.sort_values("lag")["acf"].to_numpy()[: lags + 1]
        phi = np.zeros(0)
        out = [1.0]
        error = 1.0
        for k in range(1, len(r)):
            ref = (r[k] - phi @ r[k - 1 : 0 : -1]) / error if error > 0 else 0.0
            phi = np.append(phi - ref * phi[::-1], ref)
            error *= 1 - ref * ref
            out.append(ref)
        head = {k: group[k].iloc[0] for k in keys}
        return pd.DataFrame({**head, "lag": range(len(out)), "pacf": out})

    schema = correlogram.select(*keys).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return correlogram.where(F.col("lag") <= lags).groupBy(*keys).applyInPandas(levinson, f"{fields}, lag int, pacf double")


def decompose(
    df: DataFrame, step_seconds: int, period: int, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Additive trend (centred moving average), seasonal (phase means about zero) and residual."""
    keys = list(keys)
    half = period // 2

    def centred(w):
        inner = w.rowsBetween(-half, half)
        full = F.count(y).over(inner) == 2 * half + 1
        if period % 2:
            value = F.sum(y).over(inner) / period
        else:
            ends = F.lag(y, half).over(w) + F.lead(y, half).over(w)
            value = (F.sum(y).over(inner) - ends / 2) / period
        return {"trend": F.when(full, value)}

    rows = halo(df, keys, ts, step_seconds, centred, back=half, ahead=half, chunk_rows=chunk_rows)
    start = df.groupBy(*keys).agg(F.min(epoch_seconds(F.col(ts))).alias("__t0"))
    place = (epoch_seconds(F.col(ts)) - F.col("__t0")) / F.lit(step_seconds)
    rows = rows.join(start, on=keys).withColumn("phase", (place % period).cast("int")).drop("__t0")
    means = rows.groupBy(*keys, "phase").agg(F.avg(F.col(y) - F.col("trend")).alias("__pm"))
    overall = means.groupBy(*keys).agg(F.avg("__pm").alias("__om"))
    season = means.join(overall, on=keys).select(*keys, "phase", (F.col("__pm") - F.col("__om")).alias("seasonal"))
    out = rows.join(season, on=[*keys, "phase"])
    return out.withColumn("resid", F.col(y) - F.col("trend") - F.col("seasonal"))


def f_scores(df: DataFrame, target: str, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """F statistic of the single-feature regression on the target, from the correlation."""
    r2 = F.col("r") * F.col("r")
    scores = target_correlations(df, target, cols, keys)
    return scores.select(*keys, F.col("a").alias("feature"), "r", ratio(r2 * (F.col("n") - 2), 1 - r2).alias("f_score"))


def mutual_information(df: DataFrame, target: str, cols: Sequence[str], bins: int = 8) -> DataFrame:
    """Plug-in mutual information on quantile bins (for ranking features)."""
    probs = {f"e{i}": i / bins for i in range(1, bins)}
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in (target, *cols)]).dropna()
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in (target, *cols)])
    # Written once: the cuts and the counts both read it, and they need not carry the wide plan along.
    long = cut_lineage(df.sparkSession, rows.select(F.col(target).alias("__t"), F.inline(pairs)), "feature-values")
    cuts = quantiles(long, ["feature"], "x", probs).select("feature", F.array(*probs).alias("__cuts"))
    goal = cuts.where(F.col("feature") == target).select("__cuts").scalar()

    def place(value: Column, edges: Column) -> Column:
        return F.size(F.filter(edges, lambda e: value > e))

    # One row of cuts per feature, looked up by name.
    cells = (
        long.where(F.col("feature") != target)
        .join(cuts.withColumn("__goal", goal), "feature")
        .groupBy("feature", place(F.col("x"), F.col("__cuts")).alias("x"), place(F.col("__t"), F.col("__goal")).alias("t"))
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    # sum p ln(p / (px pt)) = ln N + (sum c ln c - sum cx ln cx - sum ct ln ct) / N; at most bins^2 cells per feature.
    def clogc(frame: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        part = frame.groupBy("feature", *by).agg(F.sum("c").alias("c"))
        return part.groupBy("feature").agg(F.sum(F.col("c") * F.log("c")).alias(name), F.sum("c").alias(f"{name}_n"))

    joint, left, right = clogc(cells, ["x", "t"], "j"), clogc(cells, ["x"], "l"), clogc(cells, ["t"], "r")
    both = joint.join(left, "feature").join(right, "feature")
    n = F.col("j_n")
    return both.select("feature", (F.log(n) + (F.col("j") - F.col("l") - F.col("r")) / n).alias("mi_score"))


def combine_scores(scores: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min-max normalise every score and average them."""
    ends = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    span = scores.agg(*ends).select(F.struct("*")).scalar()
    norms = {f"{c}_norm": ratio(F.col(c) - span[f"lo_{c}"], span[f"hi_{c}"] - span[f"lo_{c}"]) for c in cols}
    out = scores.withColumns(norms)
    return out.withColumn("combined_score", sum((F.col(f"{c}_norm") for c in cols), F.lit(0.0)) / len(cols))


#: Scores of equal columns differ by rounding only; compared to this many places, they are equal.
SCORE_PLACES = 9


def correlated_drops(pairs: DataFrame, scores: DataFrame, limit: float = 0.95) -> DataFrame:
    """Of every pair correlated above the limit, the feature to drop: the first only if its score is lower."""
    high = pairs.where(F.abs("r") > limit).select("a", "b")
    a = scores.select(F.col("feature").alias("a"), F.col("combined_score").alias("__sa"))
    b = scores.select(F.col("feature").alias("b"), F.col("combined_score").alias("__sb"))
    both = high.join(a, "a", "left").join(b, "b", "left")
    lower = F.round(F.coalesce("__sa", F.lit(0.0)), SCORE_PLACES) < F.round(F.coalesce("__sb", F.lit(0.0)), SCORE_PLACES)
    return both.select(F.when(lower, F.col("a")).otherwise(F.col("b")).alias("feature")).distinct()


def select_top(scores: DataFrame, drops: DataFrame, n: int = 40) -> DataFrame:
    kept = scores.join(drops, "feature", "left_anti")
    return kept.orderBy(F.desc(F.round("combined_score", SCORE_PLACES)), "feature").limit(n)


def project_selected(rows: DataFrame, selected: DataFrame, train: Column, path: str, keep: Sequence[str] = (), label: str = "feature") -> tuple[DataFrame, DataFrame]:
    """Write the training and the test rows, cut to ``keep`` and the selected columns, and give both tables.

    Which columns these are is decided by the data: the names come to the driver (one row per feature), the rows do not.
    """
    names = [r[0] for r in selected.select(label).collect()]
    spark, chosen = rows.sparkSession, rows.select(*keep, *names, train.alias("__train"))
    out = []
    for part, which in (("train", F.col("__train")), ("test", ~F.coalesce("__train", F.lit(False)))):
        table = chosen.where(which).drop("__train")
        table.write.mode("overwrite").parquet(f"{path}/{part}")
        out.append(spark.read.schema(table.schema).parquet(f"{path}/{part}"))
    return tuple(out)


# Rules for the kind of a feature, first match wins.
FEATURE_RULES = (
    ("Lag", r"lag_|diff_|pct_change"),
    ("Rolling", r"rolling_|ewm_"),
    ("Advanced", r"spike|trend|velocity|momentum|bb_|cv|direction"),
    (
        "Time",
        r"^(hour|day_of_week|is_weekend|is_business_hour|is_peak_hour|hour_sin|hour_cos|dow_sin|dow_cos|day|month|minute)$",
    ),
)


def feature_category(name: Column) -> Column:
    """Kind of a feature by its name."""
    out = F
    for label, pattern in FEATURE_RULES:
        out = out.when(name.rlike(pattern), label)
    return out.otherwise("Aggregation")


def event_impact(df: DataFrame, y: str = "y", keys: Sequence[str] = SID) -> DataFrame:
    """Per event: mean, max, min and rows."""
    return df.where(F.col("is_special_event") == 1).groupBy(*keys, "event_name", "event_type", "event_impact").agg(
        F.avg(y).alias("avg_traffic"), F.max(y).alias("max_traffic"), F.min(y).alias("min_traffic"), F.count(y).alias("periods")
    )


def event_contrast(df: DataFrame, y: str = "y", keys: Sequence[str] = SID) -> DataFrame:
    special = F.col("is_special_event") == 1
    means = df.groupBy(*keys).agg(
        F.avg(F.when(~special, F.col(y))).alias("normal_avg"), F.avg(F.when(special, F.col(y))).alias("event_avg")
    )
    return means.withColumn("impact_pct", (ratio(F.col("event_avg"), F.col("normal_avg")) - 1) * 100)


def method_agreement(df: DataFrame, keys: Sequence[str] = SID) -> DataFrame:
    z, m = F.col("is_spike") == 1, F.col("is_anomaly_ml") == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(z).alias("spikes"), F.count_if(m).alias("anomalies"), F.count_if(z & m).alias("both"),
        F.count_if(z & ~m).alias("only_spike"), F.count_if(~z & m).alias("only_ml"),
    )
    return counts.withColumn("agreement_pct", ratio(F.col("both") * 100, F.col("spikes")))


# Critical values of the unit-root test with a constant.
ADF_CRITICAL = {"1%": -3.4304, "5%": -2.8615, "10%": -2.5668}


def unit_root(df: DataFrame, step_seconds: int, lags: int, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp") -> DataFrame:
    """Augmented Dickey-Fuller t statistic with a constant and a given number of lagged differences.

    Every series contributes one small matrix of cross products; the regression is solved per series from that matrix.
    """
    keys = list(keys)

    def build(w):
        out = {"__dy": F.col(y) - F.lag(y, 1).over(w), "__x0": F.lag(y, 1).over(w)}
        for k in range(1, lags + 1):
            out[f"__x{k}"] = F.lag(y, k).over(w) - F.lag(y, k + 1).over(w)
        return out

    rows = halo(df, keys, ts, step_seconds, build, back=lags + 1)
    names = ["__one", *[f"__x{k}" for k in range(lags + 1)], "__dy"]
    full = rows.withColumn("__one", F.lit(1.0)).dropna(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = full.groupBy(*keys).agg(
        F.array(*[F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")) for i, j in pairs]).alias("m"),
        F.count(F.lit(1)).alias("n_obs"),
    )
    size = len(names)

    def statistic(flat: pd.Series, n_obs: pd.Series) -> pd.Series:
        out = []
        for values, n in zip(flat, n_obs):
            m = np.zeros((size, size))
            for v, (i, j) in zip(values, pairs):
                m[i, j] = m[j, i] = v
            xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
            try:
                inverse = np.linalg.inv(xx)
            except np.linalg.LinAlgError:
                out.append(None)
                continue
            beta = inverse @ xy
            spread = max(yy - beta @ xy, 0.0) / max(n - size + 1, 1)
            error = np.sqrt(spread * inverse[1, 1])
            out.append(float(beta[1] / error) if error > 0 else None)
        return pd.Series(out, dtype="float64")

    stat = F.pandas_udf(statistic, "double")
    scored = moments.select(*keys, "n_obs", stat("m", "n_obs").alias("adf"))
    return scored.withColumn("stationary_5pct", F.col("adf") < ADF_CRITICAL["5%"])


def unit_root_by_aic(df: DataFrame, step_seconds: int, max_lag: int, keys: Sequence[str] = SID, y: str = "y", ts: str = "timestamp") -> DataFrame:
    """Augmented Dickey-Fuller test with a constant whose number of lagged differences is chosen by the least AIC.

    All orders up to ``max_lag`` are nested in the largest one, so one matrix of moments per series, over the rows that the
    largest order leaves, gives the fit of each. The chosen order is then fitted on all rows that it leaves itself.
    """
    keys = list(keys)
    names = [f"__x{k}" for k in range(max_lag + 1)]

    def build(w):
        out = {"__dy": F.col(y) - F.lag(y, 1).over(w), "__x0": F.lag(y, 1).over(w)}
        for k in range(1, max_lag + 1):
            out[f"__x{k}"] = F.lag(y, k).over(w) - F.lag(y, k + 1).over(w)
        return out

    rows = halo(df, keys, ts, step_seconds, build, back=max_lag + 1).select(*keys, "__dy", *names)
    place = {c: i for i, c in enumerate([*names, "__dy"])}

    def matrices(frame: DataFrame) -> DataFrame:
        pairs = pair_moments(frame.dropna(), [*names, "__dy"], keys=keys)
        return pairs.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "n", "sx", "sy", "sxy")).alias("m"))  # columns squared

    def centred(cells) -> tuple[int, np.ndarray]:
        out, n = np.zeros((len(place), len(place))), 0
        for c in cells:
            i, j, n = place[c["a"]], place[c["b"]], c["n"]
            out[i, j] = out[j, i] = c["sxy"] - c["sx"] * c["sy"] / n
        return n, out

    def fitted(n: int, c: np.ndarray, lags: int) -> tuple[float | None, float | None]:
        """(t value of the lagged level, AIC) with that many lagged differences."""
        free = n - lags - 2
        if free <= 0:
            return None, None
        try:
            inverse = np.linalg.inv(c[: lags + 1, : lags + 1])
        except np.linalg.LinAlgError:
            return None, None
        beta = inverse @ c[: lags + 1, -1]
        rest = max(c[-1, -1] - beta @ c[: lags + 1, -1], 0.0)
        error = np.sqrt(rest / free * inverse[0, 0])
        return (float(beta[0] / error), float(n * np.log(rest / n) + 2 * (lags + 2))) if error > 0 else (None, None)

    def choose(column: pd.Series) -> pd.DataFrame:
        out = []
        for cells in column:
            n, c = centred(cells)
            tried = [(aic, lags) for lags in range(max_lag + 1) for _, aic in [fitted(n, c, lags)] if aic is not None]
            out.append(min(tried) if tried else (None, None))
        return pd.DataFrame(out, columns=["aic", "used_lag"]).astype({"aic": "float64", "used_lag": "Int32"})

    def test(column: pd.Series, lags: pd.Series) -> pd.DataFrame:
        out = [(n, fitted(n, c, int(p))[0]) for cells, p in zip(column, lags, strict=True) for n, c in [centred(cells)]]
        return pd.DataFrame(out, columns=["n_obs", "adf"]).astype({"n_obs": "int64", "adf": "float64"})

    chosen = matrices(rows).select(*keys, F.pandas_udf(choose, "aic double, used_lag int")("m").alias("c")).select(*keys, "c.aic", "c.used_lag")
    chosen = cut_lineage(df.sparkSession, chosen.where(F.col("used_lag").isNotNull()), "unit-root-orders")
    without = {f"__x{k}": F.when(F.col("used_lag") >= k, F.col(f"__x{k}")).otherwise(0) for k in range(1, max_lag + 1)}
    again = matrices(rows.join(chosen, keys).withColumns(without).select(*keys, "__dy", *names)).join(chosen, keys)
    scored = again.select(*keys, "used_lag", "aic", F.pandas_udf(test, "n_obs long, adf double")("m", "used_lag").alias("t"))
    return scored.select(*keys, "used_lag", "aic", "t.n_obs", "t.adf", (F.col("t.adf") < ADF_CRITICAL["5%"]).alias("stationary_5pct"))

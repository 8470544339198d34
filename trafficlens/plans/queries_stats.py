"""Queries over joins, limits, statistics, feature selection and anomalies."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from trafficlens.functions.calendar import day_of_week
from trafficlens.operators import anomaly as an
from trafficlens.operators import features as fe
from trafficlens.operators import models as mo
from trafficlens.operators import profiles as pr
from trafficlens.operators import reports as rp
from trafficlens.operators import stats as st
from trafficlens.operators.anomaly_ml import IsolationForestEstimator
from trafficlens.operators.forecast import future_grid
from trafficlens.operators.series import time_grid
from trafficlens.plans import views as v
from trafficlens.plans import wide
from trafficlens.plans.registry import query
from trafficlens.plans.sqlviews import add_views
from trafficlens.session import cut_lineage, scratch_path

SID = ["series_id"]
AT = "series_id:s timestamp:t"
HEAD = 'series_id, ts AS "timestamp"'
COLS = list(wide.FEATURES)
add_views(wide.VIEWS)

R = "CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / stddev_pop({a}) / stddev_pop({b}) END"
CORR = f"""SELECT a.f AS a, b.f AS b, {R.format(a='a.x', b='b.x')} AS r
    FROM wide_long a JOIN wide_long b ON b.series_id = a.series_id AND b.ts = a.ts AND a.i < b.i GROUP BY 1, 2"""
TARGET = f"SELECT f AS a, 'y' AS b, {R.format(a='x', b='y')} AS r, count(*) AS n FROM wide_long GROUP BY 1"
FSCORE = f"SELECT a AS feature, r * r / nullif(1 - r * r, 0) * (n - 2) AS f_score FROM ({TARGET})"
EIGHTHS = ", ".join(str(i / 8) for i in range(1, 8))


def _place(value: str, cuts: str) -> str:
    return " + ".join(f"CAST({value} > {cuts}[{i}] AS INT)" for i in range(1, 8))


MI = f"""WITH whole AS (SELECT l.* FROM wide_long l JOIN (SELECT series_id, ts FROM wide_long GROUP BY 1, 2 HAVING count(*) = {len(COLS)}) c ON c.series_id = l.series_id AND c.ts = l.ts),
    goal AS (SELECT quantile_cont(y, [{EIGHTHS}]) AS g FROM whole WHERE i = 0),
    cells AS (SELECT whole.f, {_place('x', 'c')} AS bx, {_place('y', 'g')} AS bt, CAST(count(*) AS DOUBLE) AS n
      FROM whole JOIN (SELECT f, quantile_cont(x, [{EIGHTHS}]) AS c FROM whole GROUP BY 1) q ON q.f = whole.f CROSS JOIN goal GROUP BY 1, 2, 3),
    sums AS (SELECT f, sum(n) AS total, sum(n * ln(n)) AS j FROM cells GROUP BY 1)
    SELECT sums.f AS feature, ln(total) + (j - l - r) / total AS mi_score FROM sums
    JOIN (SELECT f, sum(n * ln(n)) AS l FROM (SELECT f, bx, sum(n) AS n FROM cells GROUP BY 1, 2) GROUP BY 1) a ON a.f = sums.f
    JOIN (SELECT f, sum(n * ln(n)) AS r FROM (SELECT f, bt, sum(n) AS n FROM cells GROUP BY 1, 2) GROUP BY 1) b ON b.f = sums.f"""
# Two scores per feature that SQL can tell: the F score and the mutual information, each between 0 and 1, averaged.
SCORES = f"""SELECT feature, f_score, mi_score, ((f_score - min(f_score) OVER ()) / (max(f_score) OVER () - min(f_score) OVER ())
    + (mi_score - min(mi_score) OVER ()) / (max(mi_score) OVER () - min(mi_score) OVER ())) / 2 AS combined_score
    FROM (SELECT f.feature, f_score, mi_score FROM ({FSCORE}) f JOIN ({MI}) m ON m.feature = f.feature)"""
DROPS = f"""SELECT DISTINCT CASE WHEN round(coalesce(sa.combined_score, 0), 9) < round(coalesce(sb.combined_score, 0), 9) THEN p.a ELSE p.b END AS feature
    FROM ({CORR}) p LEFT JOIN ({SCORES}) sa ON sa.feature = p.a LEFT JOIN ({SCORES}) sb ON sb.feature = p.b WHERE abs(p.r) > 0.95"""
SELECTED = f"SELECT feature, combined_score FROM ({SCORES}) WHERE feature NOT IN ({DROPS}) ORDER BY round(combined_score, 9) DESC, feature LIMIT 40"
TRAIN_UNTIL = "2024-01-24 00:00:00"


def _wide(spark, d):
    """The feature table, written once: scores, correlations and models read it several times.

    Values are rounded to 6 places: equal ones that differ in their last bits would fall on different sides of a bin's edge.
    """
    values = [F.round(F.col(c).cast("double"), 6).alias(c) for c in COLS]
    return cut_lineage(spark, wide.table(spark, d).select("series_id", "timestamp", "y", *values), "wide")


def _scores(rows):
    f = st.f_scores(rows, "y", COLS).select("feature", "f_score")
    return st.combine_scores(f.join(st.mutual_information(rows, "y", COLS), "feature"), ["f_score", "mi_score"])


def _scored(spark, d):
    """(feature table, scores, features dropped for a close relative); scores are written, as three steps read them."""
    rows = _wide(spark, d)
    scores = cut_lineage(spark, _scores(rows), "scores")
    return rows, scores, st.correlated_drops(st.correlations(rows, COLS), scores)


@query(
    "j1_join_scores", "feature:s f_score:d4 r:d",
    f"SELECT f.feature, f.f_score, c.r FROM ({FSCORE}) f JOIN ({TARGET}) c ON c.a = f.feature", "wide_long",
)
def j1(spark, d):
    rows = _wide(spark, d)
    f = st.f_scores(rows, "y", COLS).select("feature", "f_score")
    c = st.target_correlations(rows, "y", COLS).select(F.col("a").alias("feature"), "r")
    return f.join(c, "feature")


@query(
    "j2_grid_join", f"{AT} n:i",
    """SELECT s.series_id, s.ts AS "timestamp", c.n FROM sparse s LEFT JOIN (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2) c
    ON c.event_type = s.series_id AND c.ts = s.ts""", "sparse",
)
def j2(spark, d):
    from trafficlens.functions.values import floor_time

    events = v.table(spark, d, "events")
    counts = events.groupBy(F.col("event_type").alias("series_id"), floor_time(F.col("ts"), 900).alias("timestamp")).agg(F.count(F.lit(1)).alias("n"))
    return time_grid(counts, SID, 900).join(counts, [*SID, "timestamp"], "left")


@query("j3_events", f"{AT} event_type:i is_special_event:i event_impact:s event_name:s", f"SELECT {HEAD}, event_type, is_special_event, event_impact, event_name FROM eventful", "eventful")
def j3(spark, d):
    return fe.event_features(v.series(spark, d), v.calendar(spark))


@query("j5_anti_filter", "feature:s combined_score:d", f"SELECT feature, combined_score FROM ({SCORES}) WHERE feature NOT IN ({DROPS})", "wide_long")
def j5(spark, d):
    _, scores, drops = _scored(spark, d)
    return scores.join(drops, "feature", "left_anti")


@query(
    "j6_pareto", "c_nationkey:i c_custkey:i total_cost:d sla_violation_rate:d pareto_optimal:b",
    """SELECT c_nationkey, c_custkey, total_cost, sla_violation_rate, NOT EXISTS (SELECT 1 FROM p o WHERE o.c_nationkey = p.c_nationkey AND
        ((o.total_cost <= p.total_cost AND o.sla_violation_rate < p.sla_violation_rate) OR (o.total_cost < p.total_cost AND o.sla_violation_rate <= p.sla_violation_rate))) AS pareto_optimal
    FROM (SELECT c_nationkey, c_custkey, floor(c_acctbal) AS total_cost, c_custkey % 97 / 97 AS sla_violation_rate FROM customer) p""".replace(
        "FROM p o", "FROM (SELECT c_nationkey, floor(c_acctbal) AS total_cost, c_custkey % 97 / 97 AS sla_violation_rate FROM customer) o"
    ),
)
def j6(spark, d):
    points = v.table(spark, d, "customer").select(
        "c_nationkey", "c_custkey", F.floor("c_acctbal").cast("double").alias("total_cost"), ((F.col("c_custkey") % 97) / F.lit(97.0)).alias("sla_violation_rate")
    )
    return rp.pareto(points, ["c_nationkey"])


@query(
    "j7_hour_profile_join", f"{AT} step:i mean:d",
    """SELECT f.series_id, f.ts AS "timestamp", step, mean FROM (
      SELECT series_id, step, last + (step + 1) * INTERVAL 1 HOUR AS ts FROM (SELECT series_id, max(ts) AS last, unnest(range(48)) AS step FROM series GROUP BY 1)) f
    JOIN (SELECT series_id, hour(ts) AS hour, avg(y) AS mean FROM series GROUP BY 1, 2) h ON h.series_id = f.series_id AND h.hour = hour(f.ts)""", "series",
)
def j7(spark, d):
    rows = v.series(spark, d)
    means = rows.groupBy("series_id", F.hour("timestamp").alias("hour")).agg(F.avg("y").alias("mean"))
    return future_grid(rows, 48, v.HOUR).withColumn("hour", F.hour("timestamp")).join(means, ["series_id", "hour"])


@query("u1_union", "source:s id:i text:s", "SELECT 'doc' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def u1(spark, d):
    docs = v.table(spark, d, "documents").select(F.lit("doc").alias("source"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(v.table(spark, d, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"), "text"))


@query(
    "u3_first_per_key", "user_id:i event_type:s event_id:i value:d",
    "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
)
def u3(spark, d):
    return rp.first_of(v.table(spark, d, "events"), ["user_id", "event_type"], ["event_id"])


@query(
    "l1_extremes", "series_id:s lowest_at:t highest_at:t",
    """SELECT series_id, arg_min(ts, (y, ts)) AS lowest_at, arg_min(ts, (-y, ts)) AS highest_at FROM series GROUP BY 1""", "series",
)
def l1(spark, d):
    return v.series(spark, d).groupBy("series_id").agg(
        F.min_by("timestamp", F.struct("y", "timestamp")).alias("lowest_at"), F.min_by("timestamp", F.struct(-F.col("y"), F.col("timestamp"))).alias("highest_at")
    )


@query("l1_largest", f"{AT} y:i", f"SELECT {HEAD}, y FROM series ORDER BY y DESC, series_id, ts LIMIT 15", "series")
def l1_largest(spark, d):
    return v.series(spark, d).orderBy(F.desc("y"), "series_id", "timestamp").limit(15)


@query("l2_page", "o_orderkey:i o_orderdate:t", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def l2(spark, d):
    return v.table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50)


@query("t1_correlations", "a:s b:s r:d", CORR, "wide_long")
def t1(spark, d):
    return st.correlations(_wide(spark, d), COLS)


@query("t1_with_target", "a:s b:s r:d", TARGET, "wide_long")
def t1_target(spark, d):
    return st.target_correlations(_wide(spark, d), "y", COLS)


def _t_sql(flag: str) -> str:
    return f"""SELECT series_id, n1, n2, (m1 - m2) / sqrt(p * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t, (m1 - m2) / sqrt(p) AS cohens_d FROM (
      SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS p FROM (
        SELECT series_id, count(*) FILTER ({flag}) AS n1, avg(y) FILTER ({flag}) AS m1, var_samp(y) FILTER ({flag}) AS v1,
          count(*) FILTER (NOT ({flag})) AS n2, avg(y) FILTER (NOT ({flag})) AS m2, var_samp(y) FILTER (NOT ({flag})) AS v2 FROM series GROUP BY 1))"""


@query("t2_weekday_test", "series_id:s n1:i n2:i t:d cohens_d:d", _t_sql("isodow(ts) < 6"), "series")
def t2(spark, d):
    return st.two_sample(v.series(spark, d), day_of_week(F.col("timestamp")) < 5)


@query("t3_business_test", "series_id:s n1:i n2:i t:d cohens_d:d", _t_sql("hour(ts) BETWEEN 8 AND 17"), "series")
def t3(spark, d):
    return st.two_sample(v.series(spark, d), F.hour("timestamp").between(8, 17))


@query("t2_p_values", "series_id:s t:d p_greater:d")
def t2_p(spark, d):
    return st.with_p_values(st.two_sample(v.series(spark, d), day_of_week(F.col("timestamp")) < 5))


@query(
    "t4_anova", "series_id:s f:d df_between:i df_within:i",
    """SELECT series_id, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f, count(*) - 1 AS df_between, sum(n) - count(*) AS df_within
    FROM (SELECT *, sum(n * m) OVER (PARTITION BY series_id) / sum(n) OVER (PARTITION BY series_id) AS gm FROM (
      SELECT series_id, hour(ts) AS h, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM series GROUP BY 1, 2)) GROUP BY 1""",
    "series",
)
def t4(spark, d):
    return st.anova(v.series(spark, d), F.hour("timestamp"))


@query(
    "t5_kruskal", "series_id:s h:d df:i",
    """SELECT r.series_id, (12.0::DOUBLE / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, k - 1 AS df FROM (
      SELECT series_id, sum(sr * sr / c) AS s, CAST(sum(c) AS DOUBLE) AS n, count(*) AS k FROM (
        SELECT series_id, isodow(ts) AS g, sum(rank) AS sr, count(*) AS c FROM (
          SELECT *, rank() OVER (PARTITION BY series_id ORDER BY y) + (count(*) OVER (PARTITION BY series_id, y) - 1) / 2 AS rank FROM series) GROUP BY 1, 2) GROUP BY 1) r
    JOIN (SELECT series_id, sum(CAST(c AS DOUBLE) * c * c - c) AS t FROM (SELECT series_id, y, count(*) AS c FROM series GROUP BY 1, 2) GROUP BY 1) ties ON ties.series_id = r.series_id""",
    "series",
)
def t5(spark, d):
    return st.kruskal(v.series(spark, d), day_of_week(F.col("timestamp")))


@query(
    "t6_busy_hours", "series_id:s hour:i mean:d overall_mean:d",
    """SELECT h.series_id, hour, mean, overall_mean FROM (SELECT series_id, hour(ts) AS hour, avg(y) AS mean FROM series GROUP BY 1, 2) h
    JOIN (SELECT series_id, avg(y) AS overall_mean FROM series GROUP BY 1) o ON o.series_id = h.series_id WHERE mean > overall_mean""",
    "series",
)
def t6(spark, d):
    return st.groups_above_mean(v.series(spark, d), F.hour("timestamp"), "hour")


@query("t7_unit_root", "series_id:s n_obs:i adf:d stationary_5pct:b")
def t7(spark, d):
    return st.unit_root(v.series(spark, d), v.HOUR, 4)


@query("t7_unit_root_by_aic", "series_id:s used_lag:i aic:d4 n_obs:i adf:d4 stationary_5pct:b")
def t7_aic(spark, d):
    return st.unit_root_by_aic(v.series(spark, d), v.HOUR, 24)


def _acf_sql(source: str) -> str:
    return f"""SELECT series_id, 0 AS lag, 1.0 AS acf FROM {source} GROUP BY 1 UNION ALL
      SELECT a.series_id, b.place - a.place AS lag, sum((a.y - a.m) * (b.y - b.m)) / max(a.ss) AS acf
      FROM (SELECT *, avg(y) OVER (PARTITION BY series_id) AS m, var_pop(y) OVER (PARTITION BY series_id) * count(*) OVER (PARTITION BY series_id) AS ss FROM {source}) a
      JOIN (SELECT *, avg(y) OVER (PARTITION BY series_id) AS m FROM {source}) b ON b.series_id = a.series_id AND b.place BETWEEN a.place + 1 AND a.place + 50 GROUP BY 1, 2"""


@query("t8_acf", "series_id:s lag:i acf:d", _acf_sql("numbered"), "numbered")
def t8(spark, d):
    return st.acf(v.series(spark, d), v.HOUR, 50, chunk_rows=v.SHORT_CHUNK)


DIFFS = "(SELECT series_id, place, y - lag(y) OVER (PARTITION BY series_id ORDER BY place) AS y FROM numbered QUALIFY place > 0)"


@query("t8_acf_differenced", "series_id:s lag:i acf:d", _acf_sql(DIFFS), "numbered")
def t8_diff(spark, d):
    return st.acf(st.difference(v.series(spark, d), v.HOUR, chunk_rows=v.SHORT_CHUNK), v.HOUR, 50, chunk_rows=v.SHORT_CHUNK)


@query("t9_pacf", "series_id:s lag:i pacf:d")
def t9(spark, d):
    return st.pacf(st.acf(v.series(spark, d), v.HOUR, 50, chunk_rows=v.SHORT_CHUNK), 50)


@query(
    "t10_decompose", f"{AT} trend:d seasonal:d resid:d",
    """SELECT t.series_id, t.ts AS "timestamp", t.trend, s.seasonal, t.y - t.trend - s.seasonal AS resid FROM (
      SELECT series_id, ts, y, place % 24 AS phase, CASE WHEN place >= 12 AND place < n_rows - 12 THEN
        (sum(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) - (lag(y, 12) OVER w + lead(y, 12) OVER w) / 2) / 24 END AS trend
      FROM numbered WINDOW w AS (PARTITION BY series_id ORDER BY ts)) t
    JOIN (SELECT series_id, phase, pm - avg(pm) OVER (PARTITION BY series_id) AS seasonal FROM (
      SELECT series_id, place % 24 AS phase, avg(y - trend) AS pm FROM (
        SELECT series_id, place, y, CASE WHEN place >= 12 AND place < n_rows - 12 THEN
          (sum(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) - (lag(y, 12) OVER w + lead(y, 12) OVER w) / 2) / 24 END AS trend
        FROM numbered WINDOW w AS (PARTITION BY series_id ORDER BY ts)) GROUP BY 1, 2)) s ON s.series_id = t.series_id AND s.phase = t.phase""",
    "numbered",
)
def t10(spark, d):
    return st.decompose(v.series(spark, d), v.HOUR, 24, chunk_rows=v.SHORT_CHUNK)


@query("t11_f_scores", "feature:s f_score:d4", FSCORE, "wide_long")
def t11(spark, d):
    return st.f_scores(_wide(spark, d), "y", COLS)


@query("t12_mutual_information", "feature:s mi_score:d", MI, "wide_long")
def t12(spark, d):
    return st.mutual_information(_wide(spark, d), "y", COLS)


def _importance(rows):
    return mo.fit_forest(rows.dropna(), COLS, trees=100, depth=10).importance(rows)


@query("t13_forest_importance", "feature:s importance:d")
def t13(spark, d):
    return _importance(_wide(spark, d))


@query("t14_combined_scores", "feature:s f_score:d4 mi_score:d combined_score:d", SCORES, "wide_long")
def t14(spark, d):
    return _scores(_wide(spark, d))


@query("t14_three_scores", "feature:s f_score:d4 mi_score:d importance:d combined_score:d")
def t14_three(spark, d):
    rows = _wide(spark, d)
    two = _scores(rows).select("feature", "f_score", "mi_score")
    return st.combine_scores(two.join(_importance(rows), "feature"), ["f_score", "mi_score", "importance"])


@query("t15_correlated_drops", "feature:s", DROPS, "wide_long")
def t15(spark, d):
    return _scored(spark, d)[2]


@query("t16_selected", "feature:s combined_score:d", SELECTED, "wide_long")
def t16(spark, d):
    _, scores, drops = _scored(spark, d)
    return st.select_top(scores, drops, 40)


@query(
    "t16_projected_tables", "part:s feature:s n:i n_null:i total:d4",
    f"""SELECT part, s.feature, count(x) AS n, count(*) - count(x) AS n_null, sum(x) AS total FROM ({SELECTED}) s
    JOIN (SELECT k.part, k.f, l.x FROM (SELECT w.series_id, w.ts, CASE WHEN w.ts < TIMESTAMP '{TRAIN_UNTIL}' THEN 'train' ELSE 'test' END AS part, c.f FROM series w CROSS JOIN (SELECT DISTINCT f FROM wide_long) c) k
      LEFT JOIN wide_long l ON l.series_id = k.series_id AND l.ts = k.ts AND l.f = k.f) r ON r.f = s.feature GROUP BY 1, 2""",
    "wide_long series",
)
def t16_tables(spark, d):
    """The two written tables, read back: for every column of each, its known and null rows and its sum."""
    rows, scores, drops = _scored(spark, d)
    train = F.col("timestamp") < F.lit(TRAIN_UNTIL).cast("timestamp_ntz")
    tables = st.project_selected(rows, st.select_top(scores, drops, 40), train, scratch_path(spark, "selected"), ["series_id", "timestamp", "y"])
    out = None
    for part, table in zip(("train", "test"), tables, strict=True):
        names = [c for c in table.columns if c not in ("series_id", "timestamp", "y")]
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in names])
        long = table.select(F.inline(cells)).groupBy("feature").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("n_null"), F.sum("x").alias("total"))
        long = long.withColumn("part", F.lit(part))
        out = long if out is None else out.unionByName(long)
    return out


CATEGORY = """CASE WHEN regexp_matches(feature, 'lag_|diff_|pct_change') THEN 'Lag' WHEN regexp_matches(feature, 'rolling_|ewm_') THEN 'Rolling'
    WHEN regexp_matches(feature, 'spike|trend|velocity|momentum|bb_|cv|direction') THEN 'Advanced'
    WHEN feature IN ('hour', 'day_of_week', 'is_weekend', 'is_business_hour', 'is_peak_hour', 'hour_sin', 'hour_cos', 'dow_sin', 'dow_cos', 'day', 'month', 'minute') THEN 'Time' ELSE 'Aggregation' END"""


@query("t17_score_by_category", "category:s total:d4", f"SELECT {CATEGORY} AS category, sum(f_score) AS total FROM ({FSCORE}) GROUP BY 1", "wide_long")
def t17(spark, d):
    scores = st.f_scores(_wide(spark, d), "y", COLS)
    return scores.groupBy(st.feature_category(F.col("feature")).alias("category")).agg(F.sum("f_score").alias("total"))


@query("t17_importance_by_category", "category:s importance:d")
def t17_importance(spark, d):
    scores = _importance(_wide(spark, d))
    return scores.groupBy(st.feature_category(F.col("feature")).alias("category")).agg(F.sum("importance").alias("importance"))


@query(
    "t18_event_impact", "series_id:s event_name:s event_type:i event_impact:s avg_traffic:d max_traffic:i min_traffic:i periods:i",
    """SELECT series_id, event_name, event_type, event_impact, avg(y) AS avg_traffic, max(y) AS max_traffic, min(y) AS min_traffic, count(*) AS periods
    FROM eventful WHERE is_special_event = 1 GROUP BY 1, 2, 3, 4""", "eventful",
)
def t18(spark, d):
    return st.event_impact(fe.event_features(v.series(spark, d), v.calendar(spark)))


@query(
    "t18_event_contrast", "series_id:s normal_avg:d event_avg:d impact_pct:d",
    """SELECT series_id, avg(y) FILTER (is_special_event = 0) AS normal_avg, avg(y) FILTER (is_special_event = 1) AS event_avg,
      (avg(y) FILTER (is_special_event = 1) / avg(y) FILTER (is_special_event = 0) - 1) * 100 AS impact_pct FROM eventful GROUP BY 1""", "eventful",
)
def t18_contrast(spark, d):
    return st.event_contrast(fe.event_features(v.series(spark, d), v.calendar(spark)))


@query(
    "t19_method_agreement", "series_id:s spikes:i anomalies:i both:i only_spike:i only_ml:i agreement_pct:d",
    """SELECT series_id, sum(is_spike) AS spikes, sum(is_anomaly_ml) AS anomalies, sum(is_spike * is_anomaly_ml) AS both, sum(is_spike * (1 - is_anomaly_ml)) AS only_spike,
      sum((1 - is_spike) * is_anomaly_ml) AS only_ml, sum(is_spike * is_anomaly_ml) * 100 / nullif(sum(is_spike), 0) AS agreement_pct FROM marked GROUP BY 1""", "marked",
)
def t19(spark, d):
    return st.method_agreement(v.marked(spark, d))


@query(
    "t19_disagreements", f"{AT} method:s",
    f"SELECT {HEAD}, CASE WHEN is_spike = 1 THEN 'spike' ELSE 'ml' END AS method FROM marked WHERE is_spike <> is_anomaly_ml", "marked",
)
def t19_only(spark, d):
    rows = v.marked(spark, d).where(F.col("is_spike") != F.col("is_anomaly_ml"))
    return rows.withColumn("method", F.when(F.col("is_spike") == 1, "spike").otherwise("ml"))


@query("x1_spikes_and_dips", f"{AT} kind:s", f"SELECT {HEAD}, CASE WHEN is_spike = 1 THEN 'spike' ELSE 'dip' END AS kind FROM marked WHERE is_spike = 1 OR is_dip = 1", "marked")
def x1(spark, d):
    rows = v.marked(spark, d).where((F.col("is_spike") == 1) | (F.col("is_dip") == 1))
    return rows.withColumn("kind", F.when(F.col("is_spike") == 1, "spike").otherwise("dip"))


@query("x2_isolation_forest", "series_id:s timestamp:t anomaly_score_ml:d is_anomaly_ml:i")
def x2(spark, d):
    rows = _wide(spark, d)
    return an.IsolationForest(["y", *COLS], ["series_id", "timestamp"]).fit(rows).transform(rows)


@query("x3_anomaly_points", f"{AT} y:i", f"SELECT {HEAD}, y FROM marked WHERE is_anomaly_ml = 1", "marked")
def x3(spark, d):
    return an.anomaly_points(v.marked(spark, d))


@query("x4_both_methods", "series_id:s timestamp:t is_spike:i is_anomaly_ml:i anomaly_agreement:i")
def x4(spark, d):
    rows = v.marked(spark, d).select("series_id", "timestamp", "y", "spike_score", "is_spike")
    return an.both_methods(rows, ["y", "spike_score"], ["series_id", "timestamp"])


@query("x5_fit_and_score", "part:s n:i anomalies:i")
def x5(spark, d):
    rows = _wide(spark, d).withColumn("part", F.when(F.col("timestamp") < F.lit(TRAIN_UNTIL).cast("timestamp_ntz"), "train").otherwise("test"))
    learner = IsolationForestEstimator(inputCols=["y", *COLS], idCols=["series_id", "timestamp"])
    path = scratch_path(spark, "forest-pipeline")
    Pipeline(stages=[learner]).fit(rows.where(F.col("part") == "train")).write().save(path)
    return PipelineModel.load(path).transform(rows).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("is_anomaly_ml").alias("anomalies"))


@query("a10_hour_by_weekpart", "series_id:s is_weekend:i hour:i mean:d", "SELECT series_id, CAST(isodow(ts) >= 6 AS INT) AS is_weekend, hour(ts) AS hour, avg(y) AS mean FROM series GROUP BY 1, 2, 3", "series")
def a10_hours(spark, d):
    part = (day_of_week(F.col("timestamp")) >= 5).cast("int")
    rows = v.series(spark, d).withColumn("is_weekend", part)
    return pr.hour_profile(rows, ["series_id", "is_weekend"])

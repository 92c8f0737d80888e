"""Registered queries over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yieldgate.functions import power
from yieldgate.operators import backtest, decision, drift, envelope, forest, history, inference, logistic, metrics, models, prep, profile, windows
from yieldgate.plans.kept import kept
from yieldgate.plans.shared import once, side_by_side, written
from yieldgate.sources import lots as src

INSPECT, ESCAPE, CAP = 2000, 60000, 0.2
CAPS: dict[str, float | None] = {"unconstrained": None, "capacity_capped": CAP}
RATES = [0.0, 0.05, 0.1, 0.2, 0.5, 1.0]

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _found[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items() if s}


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, row_id, y, p: errors among events, scored by value / 1000."""
    lots = src.lots_events(spark, sf_dir)
    return lots.select(F.lit("value").alias("model"), "row_id", F.col("fail").alias("y"), (F.col("f000") / 1000.0).alias("p"))


def scored_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines scored by their discount: eleven different scores."""
    lots = src.lots_lineitem(spark, sf_dir)
    return lots.select(F.lit("discount").alias("model"), F.col("fail").alias("y"), F.col("f002").alias("p"))


LOTS = """
lots AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id, ts, CAST(event_type = 'error' AS INTEGER) AS fail, value AS f000,
         CAST(regexp_extract(props, '-?[0-9]+') AS DOUBLE) AS f001, CASE WHEN event_id % 7 <> 0 THEN value END AS f002,
         CAST(1.0 AS DOUBLE) AS f003, CAST(NULL AS DOUBLE) AS f004
  FROM events),
s AS (SELECT 'value' AS model, row_id, fail AS y, f000 / 1000.0 AS p FROM lots)"""
LONG = """
long AS (
  SELECT row_id, fail, unnest(['f000', 'f001', 'f002', 'f003', 'f004']) AS feature, unnest([f000, f001, f002, f003, f004]) AS x FROM lots)"""
LADDER = """
steps AS (
  SELECT model, p, count(*) FILTER (w) AS n, coalesce(sum(y) FILTER (w), 0) AS k
  FROM (SELECT model, p, y, true AS w FROM s UNION ALL SELECT DISTINCT model, CAST(0.0 AS DOUBLE), 0, false FROM s
        UNION ALL SELECT DISTINCT model, CAST(1.0 AS DOUBLE) + CAST(1e-9 AS DOUBLE), 0, false FROM s) GROUP BY model, p),
ladder AS (
  SELECT *, sum(n) OVER (PARTITION BY model ORDER BY p DESC) AS cum_n, sum(k) OVER (PARTITION BY model ORDER BY p DESC) AS cum_k,
         sum(n) OVER (PARTITION BY model) AS total_n, sum(k) OVER (PARTITION BY model) AS total_k FROM steps)"""
LINES = "s AS (SELECT 'discount' AS model, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount AS p FROM lineitem)"
CURVE = f"""
SELECT model, p AS threshold, CAST(total_n AS BIGINT) AS n, CAST(cum_n AS BIGINT) AS n_flagged, cum_n / total_n AS flag_rate,
       CAST(cum_k AS BIGINT) AS caught, CAST(total_k - cum_k AS BIGINT) AS missed, cum_k / nullif(total_k, 0) AS catch_rate,
       CAST(cum_n * {INSPECT} AS BIGINT) AS inspect_cost, CAST((total_k - cum_k) * {ESCAPE} AS BIGINT) AS escape_cost,
       CAST(cum_n * {INSPECT} + (total_k - cum_k) * {ESCAPE} AS BIGINT) AS total_cost,
       (cum_n * {INSPECT} + (total_k - cum_k) * {ESCAPE}) / total_n AS cost_per_lot FROM ladder"""


@query(f"""
WITH {LOTS}
SELECT count(*) AS n_lots, CAST(sum(fail) AS BIGINT) AS n_fail, CAST(count(*) - sum(fail) AS BIGINT) AS n_pass,
       round(avg(fail) * 1000000) / 1000000 AS fail_rate, round((count(*) - sum(fail)) / sum(fail) * 100) / 100 AS imbalance,
       min(ts) AS first_ts, max(ts) AS last_ts, CAST(date_diff('day', min(ts), max(ts)) AS INTEGER) AS span_days FROM lots""")
def lots_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.lots_profile(src.lots_events(spark, sf_dir, numbered=False))


@query(f"""
WITH {LOTS}, {LONG}
SELECT feature, count(*) AS n, count(*) - count(x) AS n_missing, 1 - count(x) / count(*) AS missing_frac, count(DISTINCT x) AS n_distinct
FROM long GROUP BY feature""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(src.lots_events(spark, sf_dir, numbered=False))


@query(f"""
WITH {LOTS}, {LONG},
c AS (SELECT feature, count(*) AS n, count(*) - count(x) AS m, count(DISTINCT x) AS d FROM long GROUP BY feature),
w AS (SELECT count(*) AS n_lots, CAST(sum(fail) AS BIGINT) AS n_fail, CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS span_days FROM lots)
SELECT w.*, count(*) AS n_features, CAST(sum(m) AS BIGINT) AS missing_cells, sum(m) / sum(n) AS missing_frac,
       count(*) FILTER (d <= 1) AS constant_cols, count(*) FILTER (m / n > 0.5) AS mostly_missing_cols FROM c, w GROUP BY ALL""")
def sensor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sensor_profile(src.lots_events(spark, sf_dir, numbered=False))


@query("""
WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS week, count(*) AS n_lots, CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS n_fail FROM orders GROUP BY 1)
SELECT week, n_lots, n_fail, round(n_fail / n_lots * 1000000) / 1000000 AS fail_rate,
       round(n_fail / n_lots / (SELECT sum(n_fail) / sum(n_lots) FROM w) * 10000) / 10000 AS vs_overall,
       round(avg(n_fail / n_lots) OVER (ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) * 1000000) / 1000000 AS fail_rate_ma4
FROM w""")
def weekly_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.weekly_drift(src.lots_orders(spark, sf_dir))


@query("""
WITH l AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(o_orderstatus = 'F' AS INTEGER) AS fail FROM orders),
h AS (SELECT CASE WHEN d = last_day(d) THEN d WHEN day(d) >= 15 THEN CAST(date_trunc('month', d) AS DATE) + 14
             ELSE CAST(date_trunc('month', d) AS DATE) - 1 END AS half, fail FROM l),
g AS (SELECT CAST(half AS DATE) AS half, count(*) AS n_lots, CAST(sum(fail) AS BIGINT) AS n_fail FROM h GROUP BY 1),
m AS (SELECT unnest(generate_series(date_trunc('month', min(half)), date_trunc('month', max(half)), INTERVAL 1 MONTH)) AS m, min(half) AS a, max(half) AS b FROM g),
e AS (SELECT CAST(unnest([CAST(m AS DATE) + 14, last_day(CAST(m AS DATE))]) AS DATE) AS half, a, b FROM m)
SELECT CAST(e.half AS TIMESTAMP) AS half, coalesce(n_lots, 0) AS n_lots, coalesce(n_fail, 0) AS n_fail, n_fail / nullif(n_lots, 0) AS fail_rate
FROM e LEFT JOIN g ON e.half = g.half WHERE e.half BETWEEN a AND b""")
def semi_monthly_fail_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.semi_monthly(src.lots_orders(spark, sf_dir))


@query(f"""
WITH {LOTS}, {LONG}
SELECT row_id, feature, x, round((x - avg(x) OVER w) * 1000000) / 1000000 AS deviation,
       round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) * 1000000) / 1000000 AS standardised
FROM long WINDOW w AS (PARTITION BY feature ORDER BY row_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def history_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.history_deviation(src.lots_events(spark, sf_dir))
    return out.withColumns({c: profile.rounded(F.col(c), 6) for c in ("deviation", "standardised")})


@query(f"""
WITH {LOTS}, {LONG},
h AS (SELECT row_id, CAST(substr(feature, 2) AS INTEGER) AS i, x - avg(x) OVER w AS d, stddev_samp(x) OVER w AS s, min(x) OVER w < max(x) OVER w AS varied
      FROM long WINDOW w AS (PARTITION BY feature ORDER BY row_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT row_id, 'f' || (900 + 2 * i) AS feature, round(d * 1000000) / 1000000 AS x FROM h
UNION ALL SELECT row_id, 'f' || (901 + 2 * i), CASE WHEN varied THEN round(d / s * 1000000) / 1000000 END FROM h""")
def wide_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both history features of every sensor, all sensors of a lot in one pass."""
    made, names = history.augmented_rows(src.lots_events(spark, sf_dir))
    each = made.select("row_id", F.posexplode("x").alias("f", "x")).withColumn("feature", F.get(F.array(*(F.lit(c) for c in names)), "f"))
    return each.where(F.col("feature") >= "f900").select("row_id", "feature", profile.rounded(F.col("x"), 6).alias("x"))


PARTS = """
b AS (SELECT CAST(floor(count(*) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(count(*) * CAST(0.6 AS DOUBLE)) AS BIGINT) + CAST(floor(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS v FROM lots)"""


@query(f"""
WITH {LOTS}, {LONG}, {PARTS},
t AS (SELECT feature, quantile_cont(x, 0.5) AS median FROM long, b WHERE row_id < a GROUP BY feature HAVING count(DISTINCT x) > 1 AND 1 - count(x) / count(*) <= 0.5),
m AS (SELECT feature, any_value(median) AS median, avg(coalesce(x, median)) AS mean, stddev_pop(coalesce(x, median)) AS spread FROM long JOIN t USING (feature), b WHERE row_id < a GROUP BY feature)
SELECT row_id, feature, round((coalesce(x, median) - mean) / spread * 1000000) / 1000000 AS z FROM long JOIN m USING (feature), b WHERE row_id >= v""")
def prepared_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test lots as a linear model sees them: features that training lots keep, filled and scaled by these."""
    lots = src.lots_events(spark, sf_dir)
    cols = src.feature_cols(lots)
    rows = written(windows.arrays(lots, cols), "lots")
    bounds = backtest.split_bounds(rows.count())
    train = written(windows.dealt(rows, [("all", "train", *bounds["train"])]), "train")
    known = windows.facts(train, len(cols))
    scaling = logistic.scalings(train, len(cols), {"all": known["all"].kept()}, windows.medians(train, len(cols)))["all"]
    test = logistic.transformed(windows.dealt(rows, [("all", "test", *bounds["test"])]), {"all": scaling}, len(cols))
    names = F.array(*(F.lit(cols[k]) for k in scaling.kept))
    return test.select("row_id", F.posexplode("z").alias("f", "z")).select("row_id", F.get(names, "f").alias("feature"), profile.rounded(F.col("z"), 6).alias("z"))


@query(f"""
WITH RECURSIVE {LOTS}, {PARTS},
x AS (SELECT y, ln(q / (1 - q)) AS z FROM (SELECT y, greatest(CAST(1e-6 AS DOUBLE), least(1 - CAST(1e-6 AS DOUBLE), p)) AS q FROM s, b WHERE row_id >= a AND row_id < v)),
n AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS slope, CAST(0 AS DOUBLE) AS const
  UNION ALL
  SELECT step + 1, slope - (hbb * gs - hsb * gb) / (hss * hbb - hsb * hsb), const - (hss * gb - hsb * gs) / (hss * hbb - hsb * hsb) FROM (
    SELECT step, slope, const, sum((p - y) * z) + CAST(1e-6 AS DOUBLE) * slope AS gs, sum(p - y) AS gb, sum(p * (1 - p) * z * z) + CAST(1e-6 AS DOUBLE) AS hss, sum(p * (1 - p) * z) AS hsb, sum(p * (1 - p)) AS hbb
    FROM (SELECT step, slope, const, y, z, 1 / (1 + exp(-(slope * z + const))) AS p FROM n, x WHERE step < 25) GROUP BY step, slope, const))
SELECT 'value' AS model, round(slope * 1000000) / 1000000 AS slope, round(const * 1000000) / 1000000 AS const FROM n WHERE step = 25""")
def platt_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration curve of value / 1000 on the validation lots."""
    lots = written(src.lots_events(spark, sf_dir), "lots")
    val = backtest.time_split(lots).where("part = 'val'").select(F.lit("value").alias("key"), F.col("fail").alias("y"), (F.col("f000") / 1000.0).alias("p"))
    curves = logistic.fit_platt(val, ["value"])
    return spark.createDataFrame([(k, *v) for k, v in curves.items()], "model string, slope double, const double").withColumns({c: profile.rounded(F.col(c), 6) for c in ("slope", "const")})


@query(f"""
WITH {LOTS}, n AS (SELECT count(*) AS n, CAST(floor(count(*) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS b FROM lots)
SELECT CASE WHEN row_id < a THEN 'train' WHEN row_id < a + b THEN 'val' ELSE 'test' END AS part, count(*) AS n, CAST(sum(fail) AS BIGINT) AS n_fail,
       avg(fail) AS fail_rate, min(ts) AS first_ts, max(ts) AS last_ts FROM lots, n GROUP BY 1""")
def time_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.split_summary(src.lots_events(spark, sf_dir))


@query(f"""
WITH {LOTS},
r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS mid FROM s),
c AS (SELECT p, count(*) AS n, sum(y) AS k FROM s GROUP BY p),
u AS (SELECT *, sum(n) OVER (ORDER BY p DESC) AS cum_n, sum(k) OVER (ORDER BY p DESC) AS cum_k FROM c),
t AS (SELECT model, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_fail, avg((p - y) * (p - y)) AS brier, sum(mid) FILTER (y = 1) AS ranks FROM r GROUP BY model),
a AS (SELECT sum(k * cum_k / cum_n) / sum(k) AS ap FROM u)
SELECT model, n, n_fail, n_fail / n AS prevalence, ap AS pr_auc, ap / (n_fail / n) AS pr_auc_over_floor,
       (ranks - n_fail * (n_fail + 1) / 2) / (n_fail * (n - n_fail)) AS roc_auc, brier FROM t, a""")
def score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = written(scored_events(spark, sf_dir), "scored")
    return metrics.score_metrics(metrics.ladder(scored), scored)


@query(f"""
WITH {LOTS}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, row_id) AS i FROM s),
q AS (SELECT share, greatest(1, CAST(ceil(n * share) AS BIGINT)) AS quota, n, n_fail
      FROM (SELECT count(*) AS n, sum(y) AS n_fail FROM s), (SELECT unnest([CAST(0.05 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(0.2 AS DOUBLE)]) AS share))
SELECT model, share, quota, CAST(sum(y) AS BIGINT) AS caught, sum(y) / n_fail AS recall, (sum(y) / quota) / (n_fail / n) AS lift
FROM r JOIN q ON i <= quota GROUP BY model, share, quota, n, n_fail""")
def recall_lift_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_shares(scored_events(spark, sf_dir))


@query(f"WITH {LINES}, {LADDER} {CURVE}")
def cost_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cost_curve(metrics.ladder(scored_lineitem(spark, sf_dir)), INSPECT, ESCAPE)


@query(f"WITH {LOTS}, {LADDER} {CURVE}")
def cost_curve_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cost_curve(metrics.ladder(scored_events(spark, sf_dir)), INSPECT, ESCAPE)


def _best_sql(cap: float | None) -> str:
    return f"(SELECT * FROM ({CURVE}) {'' if cap is None else f'WHERE flag_rate <= {cap}'} ORDER BY total_cost, threshold LIMIT 1)"


@query(f"WITH {LOTS}, {LADDER} SELECT 'unconstrained' AS regime, * FROM {_best_sql(None)} UNION ALL SELECT 'capacity_capped', * FROM {_best_sql(CAP)}")
def optimal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = written(metrics.ladder(scored_events(spark, sf_dir)), "ladder")
    each = [decision.optimal_threshold(steps, INSPECT, ESCAPE, cap).withColumn("regime", F.lit(r)) for r, cap in CAPS.items()]
    return each[0].unionByName(each[1])


@query(f"""
WITH {LOTS}, c AS (
  SELECT model, t AS threshold, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp,
         count(*) FILTER (p < t AND y = 1) AS fn, count(*) FILTER (p < t AND y = 0) AS tn
  FROM s, (SELECT unnest([CAST(0.02 AS DOUBLE), CAST(0.05 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS t) GROUP BY model, t)
SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
       coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fp) / (tp + fp + fn + tn) AS flag_rate FROM c""")
def at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.at_thresholds(scored_events(spark, sf_dir), (0.02, 0.05, 0.1, 0.9))


@query(f"""
WITH {LOTS}, {LADDER}
SELECT model, p AS threshold, cum_k / cum_n AS precision, cum_k / total_k AS recall, false AS is_end FROM ladder WHERE n > 0
UNION ALL SELECT 'value', 1.0, 1.0, 0.0, true""")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_curve(metrics.ladder(scored_events(spark, sf_dir)))


@query(f"""
WITH {LOTS}, e AS (SELECT quantile_cont(p, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]) AS e FROM s)
SELECT model, CAST(len(list_filter(e[2:8], lambda v: v <= p)) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed FROM s, e GROUP BY 1, 2""")
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration_curve(scored_events(spark, sf_dir))


def _cuts_sql(rates: str) -> str:
    """Whom rates flag, by a ladder; rates is SQL with columns i, rate."""
    return f"""
cuts AS (
  SELECT l.model, i, rate, CASE WHEN rate <= 0 THEN CAST('inf' AS DOUBLE) WHEN rate < 1 THEN p END AS above,
         CAST(CASE WHEN rate <= 0 THEN 0 WHEN rate < 1 THEN cum_n - n ELSE total_n END AS BIGINT) AS n_flagged,
         CAST(CASE WHEN rate <= 0 THEN 0 WHEN rate < 1 THEN cum_k - k ELSE total_k END AS BIGINT) AS caught,
         CAST(total_n AS BIGINT) AS total_n, CAST(total_k AS BIGINT) AS total_k
  FROM ladder l JOIN ({rates}) r ON CASE WHEN rate <= 0 OR rate >= 1 THEN p > 1
       ELSE floor(total_n * rate + CAST(1e-10 AS DOUBLE)) >= cum_n - n AND floor(total_n * rate + CAST(1e-10 AS DOUBLE)) < cum_n END)"""


@query(f"WITH {LINES}, {LADDER}, {_cuts_sql('SELECT CAST(i - 1 AS INTEGER) AS i, CAST([0.0, 0.05, 0.1, 0.2, 0.5, 1.0][i] AS DOUBLE) AS rate FROM range(1, 7) t(i)')} SELECT * FROM cuts")
def flag_rate_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.rate_cuts(metrics.ladder(scored_lineitem(spark, sf_dir)), RATES)


def _grid_sql(cap: float) -> str:
    return f"SELECT CAST(i AS INTEGER) AS i, i * (CAST({cap} AS DOUBLE) / 100) AS rate FROM range(0, 101) t(i)"


def _rate_sql(regime: str, cap: float) -> str:
    return f"""(WITH {_cuts_sql(_grid_sql(cap))}
SELECT '{regime}' AS regime, model, rate AS target_flag_rate, above, total_n AS n, n_flagged, n_flagged / total_n AS flag_rate, caught, total_k - caught AS missed,
       caught / nullif(total_k, 0) AS catch_rate, n_flagged * {INSPECT} AS inspect_cost, (total_k - caught) * {ESCAPE} AS escape_cost,
       n_flagged * {INSPECT} + (total_k - caught) * {ESCAPE} AS total_cost, (n_flagged * {INSPECT} + (total_k - caught) * {ESCAPE}) / total_n AS cost_per_lot
FROM cuts ORDER BY total_cost, rate LIMIT 1)"""


@query(f"WITH {LOTS}, {LADDER} SELECT * FROM {_rate_sql('unconstrained', 1.0)} UNION ALL SELECT * FROM {_rate_sql('capacity_capped', CAP)}")
def optimal_flag_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = written(metrics.ladder(scored_events(spark, sf_dir)), "ladder")
    each = [decision.optimal_flag_rate(steps, INSPECT, ESCAPE, cap).withColumn("regime", F.lit(r)) for r, cap in CAPS.items()]
    return each[0].unionByName(each[1])


def bounds_sql(asked: str) -> str:
    """CTE `bound` (id, side, p): the rate p at which a binomial of n trials has at most j successes with probability target.

    asked is SQL with columns id, side, j, n, target; bisection, as the probability falls with the rate.
    """
    at_most = "list_sum(list_transform(range(0, CAST(j + 1 AS BIGINT)), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(m) + (n - i) * ln(1 - m))))"
    return f"""
halves AS (
  SELECT id, side, CAST(j AS DOUBLE) AS j, CAST(n AS DOUBLE) AS n, target, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, CAST(0.5 AS DOUBLE) AS m, 0 AS step FROM ({asked})
  UNION ALL SELECT id, side, j, n, target, low, high, (low + high) / 2, step + 1
  FROM (SELECT id, side, j, n, target, step, CASE WHEN {at_most} > target THEN m ELSE low END AS low, CASE WHEN {at_most} > target THEN high ELSE m END AS high FROM halves WHERE step < 60)),
bound AS (SELECT id, side, m AS p FROM halves WHERE step = 60)"""


def _robust_sql(regime: str, cap: float) -> str:
    e = f"({ESCAPE} * inflation)"
    cost = f"(n_flagged * {INSPECT} + (total_k - caught) * {e})"
    return f"""(WITH {_cuts_sql(_grid_sql(cap))}
SELECT '{regime}' AS regime, cuts.model, rate AS target_flag_rate, above, total_n AS n, n_flagged, n_flagged / total_n AS flag_rate, caught, total_k - caught AS missed,
       caught / nullif(total_k, 0) AS catch_rate, n_flagged * {INSPECT} AS inspect_cost, round((total_k - caught) * {e}) AS escape_cost, round({cost}) AS total_cost,
       round({cost} / total_n * 10000) / 10000 AS cost_per_lot, observed AS base_rate_observed, round(upper * 1000000) / 1000000 AS base_rate_upper, round(inflation * 1000000) / 1000000 AS escape_inflation
FROM cuts, up ORDER BY CASE WHEN total_k > 0 THEN {cost} WHEN upper * {ESCAPE} > {INSPECT} THEN -rate ELSE rate END, rate LIMIT 1)"""


@query(f"""
WITH RECURSIVE {LOTS}, {LADDER}, t AS (SELECT count(*) AS n, sum(y) AS k FROM s), {bounds_sql("SELECT 0 AS id, 'upper' AS side, k AS j, n, CAST(0.05 AS DOUBLE) AS target FROM t")},
up AS (SELECT k / n AS observed, CASE WHEN k >= n THEN 1.0 ELSE p END AS upper, CASE WHEN k > 0 THEN CASE WHEN k >= n THEN 1.0 ELSE p END / (k / n) ELSE 1.0 END AS inflation FROM t, bound)
SELECT * FROM {_robust_sql('unconstrained', 1.0)} UNION ALL SELECT * FROM {_robust_sql('capacity_capped', CAP)}""")
def robust_flag_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds are found by two methods here and in SQL, so what hangs on them is rounded."""
    steps = written(metrics.ladder(scored_events(spark, sf_dir)), "ladder")
    each = [decision.robust_flag_rate(steps, INSPECT, ESCAPE, cap).withColumn("regime", F.lit(r)) for r, cap in CAPS.items()]
    places = {"escape_cost": 0, "total_cost": 0, "cost_per_lot": 4, "base_rate_upper": 6, "escape_inflation": 6}
    return each[0].unionByName(each[1]).withColumns({c: profile.rounded(F.col(c), k) for c, k in places.items()})


def _split_ladders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ladders of the validation and the test part of the rare failures, by value / 1000."""
    lots = src.lots_events(spark, sf_dir, rare=True)
    parts = written(backtest.time_split(lots).select("part", F.lit("value").alias("model"), "row_id", F.col("fail").alias("y"), (F.col("f000") / 1000.0).alias("p")), "parts")
    return tuple(written(metrics.ladder(parts.where(F.col("part") == p)), p) for p in ("val", "test"))


RARE = """
r AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id, CAST(event_type = 'error' AND value > 100 AS INTEGER) AS y, value / 1000.0 AS p FROM events),
b AS (SELECT count(*) AS n, CAST(floor(count(*) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS v FROM r),
val AS (SELECT y, p FROM r, b WHERE row_id >= a AND row_id < a + v),
test AS (SELECT y, p FROM r, b WHERE row_id >= a + v),
cand AS (SELECT DISTINCT p AS t FROM val UNION SELECT CAST(0.0 AS DOUBLE) UNION SELECT CAST(1.0 AS DOUBLE) + CAST(1e-9 AS DOUBLE)),
vs AS (SELECT count(*) AS n, sum(y) AS k FROM val),
ts AS (SELECT count(*) AS n, sum(y) AS k FROM test),
vc AS (SELECT t, count(*) FILTER (p >= t) AS f, coalesce(sum(y) FILTER (p >= t), 0) AS c FROM cand, val GROUP BY t),
kth AS (SELECT max(p) AS above FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS i FROM test), ts WHERE i = floor(ts.n * CAST(0.2 AS DOUBLE) + CAST(1e-10 AS DOUBLE)) + 1)"""


def _policy_sql(regime: str, cap: float | None) -> str:
    q = "n" if cap is None else f"floor(n * CAST({cap} AS DOUBLE) + CAST(1e-10 AS DOUBLE))"
    where = "" if cap is None else f"WHERE f / n <= {cap}"
    random = "" if cap is None else "UNION ALL SELECT 'random_at_capacity', CAST(NULL AS DOUBLE), q, k * q / n, true FROM ts2"
    alternative = "'inspect_all'" if cap is None else "'random_at_capacity'"
    return f"""(
WITH star AS (SELECT t FROM vc, vs {where} ORDER BY f * {INSPECT} + (k - c) * {ESCAPE}, t LIMIT 1),
ts2 AS (SELECT *, {q} AS q FROM ts),
m AS (SELECT count(*) FILTER (p >= t) AS f, coalesce(sum(y) FILTER (p >= t), 0) AS c FROM test, star),
rows AS (
  SELECT 'inspect_none' AS policy, CAST(1.0 AS DOUBLE) + CAST(1e-9 AS DOUBLE) AS threshold, 0.0 AS f, 0.0 AS c, true AS feasible
  UNION ALL SELECT 'inspect_all', 0.0, n, k, n <= q FROM ts2
  UNION ALL SELECT 'model', t, m.f, m.c, m.f <= q FROM m, star, ts2 {random}),
base AS (SELECT CASE WHEN q2 * {INSPECT} * n + (n - q2) * k * {ESCAPE} < k * {ESCAPE} * n THEN {alternative} ELSE 'inspect_none' END AS baseline FROM (SELECT *, {q} AS q2 FROM vs)),
out AS (
  SELECT 'value' AS model, policy, threshold, CAST(n AS DOUBLE) AS n, CAST(f AS DOUBLE) AS n_flagged, f / n AS flag_rate, CAST(c AS DOUBLE) AS caught, CAST(k - c AS DOUBLE) AS missed,
         c / nullif(k, 0) AS catch_rate, CAST(f * {INSPECT} AS DOUBLE) AS inspect_cost, CAST((k - c) * {ESCAPE} AS DOUBLE) AS escape_cost,
         CAST(f * {INSPECT} + (k - c) * {ESCAPE} AS DOUBLE) AS total_cost, (f * {INSPECT} + (k - c) * {ESCAPE}) / n AS cost_per_lot, feasible, baseline
  FROM rows, ts, base)
SELECT '{regime}' AS regime, out.*, out.total_cost - b.total_cost AS vs_baseline, (b.total_cost - out.total_cost) / nullif(b.total_cost, 0) AS saving
FROM out JOIN out b ON b.policy = out.baseline)"""


@query(f"WITH {RARE} SELECT * FROM {_policy_sql('unconstrained', None)} UNION ALL SELECT * FROM {_policy_sql('capacity_capped', CAP)}")
def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    val, test = _split_ladders(spark, sf_dir)
    each = [decision.policy_table(val, test, INSPECT, ESCAPE, cap).withColumn("regime", F.lit(r)) for r, cap in CAPS.items()]
    return each[0].unionByName(each[1])


def _sensitivity_sql(regime: str, cap: float | None) -> str:
    q = "n" if cap is None else f"floor(n * CAST({cap} AS DOUBLE) + CAST(1e-10 AS DOUBLE))"
    where = "" if cap is None else f"WHERE f / n <= {cap}"
    above = "" if cap is None else "AND p > above"
    return f"""(
WITH ratios AS (SELECT unnest([1, 2, 5, 10, 20, 30, 50, 100, 200]) AS cost_ratio),
star AS (SELECT cost_ratio, t FROM (SELECT cost_ratio, t, row_number() OVER (PARTITION BY cost_ratio ORDER BY f + (k - c) * cost_ratio, t) AS i FROM vc, vs, ratios {where}) WHERE i = 1),
m AS (SELECT cost_ratio, t, count(*) FILTER (p >= t {above}) AS f, coalesce(sum(y) FILTER (p >= t {above}), 0) AS c FROM test, star, kth GROUP BY cost_ratio, t),
v AS (SELECT *, {q} AS q FROM vs), e AS (SELECT *, {q} AS q FROM ts),
o AS (SELECT m.cost_ratio, t, f, c, e.n, e.k, CASE WHEN v.q * v.n + (v.n - v.q) * v.k * m.cost_ratio < v.k * m.cost_ratio * v.n
             THEN e.q + (e.n - e.q) * m.cost_ratio * (e.k / e.n) ELSE CAST(e.k * m.cost_ratio AS DOUBLE) END AS base, f + (e.k - c) * m.cost_ratio AS model FROM m, v, e)
SELECT '{regime}' AS regime, 'value' AS model, CAST(cost_ratio AS INTEGER) AS cost_ratio, t AS threshold, CAST(f AS BIGINT) AS n_flagged, f / n AS flag_rate, c / nullif(k, 0) AS catch_rate,
       CAST(k * cost_ratio AS BIGINT) AS cost_none, CAST(n AS BIGINT) AS cost_all, CAST(o.model AS BIGINT) AS cost_model, base AS cost_baseline, (base - o.model) / nullif(base, 0) AS saving, o.model < base AS model_wins FROM o)"""


@query(f"WITH {RARE} SELECT * FROM {_sensitivity_sql('unconstrained', None)} UNION ALL SELECT * FROM {_sensitivity_sql('capacity_capped', CAP)}")
def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    val, test = _split_ladders(spark, sf_dir)
    each = [decision.cost_sensitivity(val, test, cap=cap).withColumn("regime", F.lit(r)) for r, cap in CAPS.items()]
    return each[0].unionByName(each[1])


WHAT_IF = [(1.0, 1.5), (1.0, 4.0), (1.0, 5.25), (1.0, 9.0), (2000.0, 60000.0), (500.0, 3100.0), (1.0, 250.0)]


@query(f"""
WITH {LOTS}, {LADDER},
c AS (SELECT cum_k AS caught, cum_n AS n_flagged, min(p) AS threshold, any_value(total_n) AS total_n, any_value(total_k) AS total_k FROM ladder GROUP BY ALL),
t AS (SELECT n_flagged, caught, threshold, total_n, total_k FROM c),
e AS (
  SELECT a.*, coalesce((SELECT max(CASE WHEN a.caught > b.caught THEN (a.n_flagged - b.n_flagged) / (a.caught - b.caught) ELSE CAST('inf' AS DOUBLE) END) FROM t b WHERE b.n_flagged < a.n_flagged), 0) AS lo,
         (SELECT min((b.n_flagged - a.n_flagged) / (b.caught - a.caught)) FROM t b WHERE b.n_flagged > a.n_flagged AND b.caught > a.caught) AS hi FROM t a)
SELECT 'value' AS model, threshold, CAST(n_flagged AS BIGINT) AS n_flagged, CAST(caught AS BIGINT) AS caught, lo AS from_ratio, hi AS to_ratio FROM e WHERE lo < coalesce(hi, CAST('inf' AS DOUBLE))""")
def cost_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest threshold for every cost ratio: where each begins and ends to be it."""
    steps = metrics.ladder(scored_events(spark, sf_dir))
    return envelope.cost_envelope(steps).select("model", "threshold", "n_flagged", "caught", "from_ratio", "to_ratio")


@query(f"""
WITH {LOTS}, {LADDER}, w AS (SELECT unnest([{", ".join(f"CAST({a} AS DOUBLE)" for a, _ in WHAT_IF)}]) AS inspect, unnest([{", ".join(f"CAST({b} AS DOUBLE)" for _, b in WHAT_IF)}]) AS escape),
r AS (SELECT *, cum_n * inspect + (total_k - cum_k) * escape AS total, row_number() OVER (PARTITION BY inspect, escape ORDER BY cum_n * inspect + (total_k - cum_k) * escape, p) AS i FROM ladder, w WHERE cum_n / total_n <= {CAP})
SELECT model, inspect, escape, p AS threshold, CAST(cum_n AS BIGINT) AS n_flagged, CAST(cum_k AS BIGINT) AS caught, CAST(total AS DOUBLE) AS total_cost FROM r WHERE i = 1""")
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest threshold within the capacity under several pairs of costs, read from the envelope."""
    corners = written(envelope.cost_envelope(metrics.ladder(scored_events(spark, sf_dir)), CAP), "envelope")
    return envelope.what_if(corners, WHAT_IF).select("model", "inspect", "escape", "threshold", "n_flagged", "caught", F.col("total_cost").cast("double").alias("total_cost"))


FOLDS = """
n AS (SELECT count(*) AS n, greatest(CAST(floor(count(*) * CAST(0.15 AS DOUBLE)) AS BIGINT), 1) AS c, CAST(floor(count(*) * CAST(0.4 AS DOUBLE)) AS BIGINT) AS s FROM lots),
f AS (SELECT CAST(k + 1 AS INTEGER) AS fold, s + k * ((n - s - c) // 4) AS a, s + k * ((n - s - c) // 4) + c AS b,
             CASE WHEN k = 3 THEN n ELSE s + k * ((n - s - c) // 4) + c + (n - s - c) // 4 END AS e FROM n, range(0, 4) t(k)),
w AS (SELECT fold, CASE WHEN row_id < a THEN 'train' WHEN row_id < b THEN 'cal' ELSE 'eval' END AS role, lots.* FROM lots JOIN f ON row_id < e)"""


@query(f"WITH {LOTS}, {FOLDS} SELECT fold, role, count(*) AS n, CAST(sum(fail) AS BIGINT) AS n_fail, min(ts) AS first_ts, max(ts) AS last_ts FROM w GROUP BY fold, role")
def fold_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.fold_windows(src.lots_events(spark, sf_dir))


def folds(spark: SparkSession, sf_dir: str, policies: tuple[str, ...] = ("threshold",)) -> DataFrame:
    """A backtest of two scores that need no training and of the constant one, in both regimes."""
    lots = written(src.lots_events(spark, sf_dir), "lots")
    scored = backtest.scored_folds(lots, {"value": F.col("f000") / 1000.0, "rank": F.col("f001") / 100.0})
    return backtest.run_folds(scored, INSPECT, ESCAPE, CAPS, policies)


def fitted_folds(spark: SparkSession, sf_dir: str, policies: tuple[str, ...] = ("threshold",), names: tuple[str, ...] = tuple(models.REGISTRY)) -> DataFrame:
    """A backtest of the registry's models, fitted anew in every fold, in both regimes."""
    return backtest.run_folds(_scored_folds(spark, sf_dir, names), INSPECT, ESCAPE, CAPS, policies, stored=True)


#: Raised when fits change with the same inputs and settings, so that tables kept before are not taken for them.
FITS_VERSION: int | str = 3


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(src.lots_events(spark, sf_dir), "lots")


def _scored_folds(spark: SparkSession, sf_dir: str, names: tuple[str, ...], features: str = "raw", lots: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Scores of the models in every fold; every policy and test is about the same fits, which are kept. lots: the numbered lots, asked for only if they are to be made."""

    def make() -> DataFrame:
        table = lots() if lots else _numbered(spark, sf_dir)
        if features == "raw":
            return models.fitted_folds(table, names)
        rows, cols = history.augmented_rows(table)
        return models.fitted_rows(written(rows, "lots"), cols, names)

    settings = {"version": FITS_VERSION, "models": names, "features": features, "trees": models.MAX_TREES, "patience": models.PATIENCE, "least": models.LEAST_TREES, "early": models.OOF_TREES, "params": asdict(forest.Params())}
    return kept(spark, "scored-folds", settings, [src.table(spark, sf_dir, "events")], make)


def ablation(scored: dict[str, DataFrame]) -> DataFrame:
    """features (raw or augmented with each sensor's history) and the summary of the robust policy without a cap, from both tables of scores."""

    def summary(kind: str) -> DataFrame:
        folds = backtest.run_folds(scored[kind], INSPECT, ESCAPE, {"unconstrained": None}, ("robust",), stored=True)
        return backtest.fold_summary(folds).select(F.lit(kind).alias("features"), "*")

    return reduce(DataFrame.unionByName, side_by_side([partial(summary, kind) for kind in scored]))


#: What the threshold policy flags (fl), and what is known of every evaluation window.
_FLAGGED = f"""
sc AS (
  SELECT role, fold, row_id, fail AS y, unnest(['majority', 'value', 'rank']) AS model, unnest([rate, f000 / 1000.0, f001 / 100.0]) AS p
  FROM w JOIN (SELECT fold, avg(fail) AS rate FROM w WHERE role = 'train' GROUP BY fold) USING (fold) WHERE role <> 'train'),
cs AS (SELECT model, fold, count(*) AS cn, sum(y) AS ck FROM sc WHERE role = 'cal' GROUP BY ALL),
cc AS (
  SELECT model, fold, p AS t, sum(n) OVER o AS f, sum(k) OVER o AS c
  FROM (SELECT model, fold, p, sum(n) AS n, sum(k) AS k FROM (
        SELECT model, fold, p, 1 AS n, y AS k FROM sc WHERE role = 'cal' UNION ALL SELECT model, fold, CAST(0.0 AS DOUBLE), 0, 0 FROM cs
        UNION ALL SELECT model, fold, CAST(1.0 AS DOUBLE) + CAST(1e-9 AS DOUBLE), 0, 0 FROM cs) GROUP BY ALL)
  WINDOW o AS (PARTITION BY model, fold ORDER BY p DESC)),
reg AS (SELECT unnest(['unconstrained', 'capacity_capped']) AS regime, unnest([NULL, CAST({CAP} AS DOUBLE)]) AS capacity),
star AS (
  SELECT * FROM (SELECT regime, capacity, model, fold, t, cn, ck, row_number() OVER (PARTITION BY regime, model, fold ORDER BY f * {INSPECT} + (ck - c) * {ESCAPE}, t) AS i
                 FROM cc JOIN cs USING (model, fold), reg WHERE capacity IS NULL OR f / cn <= capacity) WHERE i = 1),
ev AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY p DESC) AS i, row_number() OVER (PARTITION BY model, fold ORDER BY p DESC, row_id) AS j,
              rank() OVER (PARTITION BY model, fold ORDER BY p) + (count(*) OVER (PARTITION BY model, fold, p) - 1) / 2 AS mid FROM sc WHERE role = 'eval'),
es AS (SELECT model, fold, count(*) AS en, sum(y) AS ek FROM ev GROUP BY ALL),
kth AS (SELECT model, fold, p AS above FROM ev JOIN es USING (model, fold) WHERE i = floor(en * CAST({CAP} AS DOUBLE) + CAST(1e-10 AS DOUBLE)) + 1),
fl AS (
  SELECT regime, capacity, 'threshold' AS policy, model, fold, t, CAST(NULL AS DOUBLE) AS rate, CAST(NULL AS DOUBLE) AS inflation, cn, ck, count(*) FILTER (p >= t AND (capacity IS NULL OR p > above)) AS f,
         coalesce(sum(y) FILTER (p >= t AND (capacity IS NULL OR p > above)), 0) AS c
  FROM ev JOIN star USING (model, fold) JOIN kth USING (model, fold) GROUP BY ALL),
au AS (SELECT model, fold, (sum(mid) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS roc_auc FROM ev GROUP BY ALL),
ap AS (
  SELECT model, fold, sum(k * ck / cn) / nullif(sum(k), 0) AS pr_auc
  FROM (SELECT *, sum(n) OVER o AS cn, sum(k) OVER o AS ck FROM (SELECT model, fold, p, count(*) AS n, sum(y) AS k FROM ev GROUP BY ALL) WINDOW o AS (PARTITION BY model, fold ORDER BY p DESC)) GROUP BY ALL),
tk AS (SELECT model, fold, sum(y) / nullif(any_value(ek), 0) AS recall_at_20, (sum(y) / count(*)) / nullif(any_value(ek) / any_value(en), 0) AS lift_at_20
       FROM ev JOIN es USING (model, fold) WHERE j <= greatest(1, ceil(en * CAST(0.2 AS DOUBLE))) GROUP BY model, fold)"""
#: What the two policies that choose a rate flag (fr): flags follow from how many lots a rate allows, as ties are left out together.
_RATED = f"""
gr AS (SELECT regime, capacity, i * (coalesce(capacity, CAST(1.0 AS DOUBLE)) / 100) AS rate FROM reg, range(0, 101) t(i)),
cg AS (
  SELECT regime, capacity, model, fold, rate, cn, ck, max(f) FILTER (f <= floor(cn * rate + CAST(1e-10 AS DOUBLE))) AS f, max(c) FILTER (f <= floor(cn * rate + CAST(1e-10 AS DOUBLE))) AS c
  FROM cc JOIN cs USING (model, fold), gr GROUP BY ALL),
{bounds_sql("SELECT fold AS id, 'upper' AS side, ck AS j, cn AS n, CAST(0.05 AS DOUBLE) AS target FROM cs WHERE model = 'value' AND ck < cn")},
up AS (SELECT fold, coalesce(p, 1.0) AS upper, CASE WHEN ck > 0 THEN coalesce(p, 1.0) / (ck / cn) ELSE 1.0 END AS lam FROM cs LEFT JOIN bound ON id = fold WHERE model = 'value'),
ch AS (
  SELECT * FROM (
    SELECT regime, capacity, policy, model, fold, cn, ck, rate, CASE policy WHEN 'robust' THEN lam END AS inflation,
           row_number() OVER (PARTITION BY regime, policy, model, fold ORDER BY CASE WHEN policy = 'quantile' THEN f * {INSPECT} + (ck - c) * {ESCAPE} WHEN ck > 0 THEN f * {INSPECT} + (ck - c) * {ESCAPE} * lam WHEN upper * {ESCAPE} > {INSPECT} THEN -rate ELSE rate END, rate) AS i
    FROM cg JOIN up USING (fold), (SELECT unnest(['quantile', 'robust']) AS policy)) WHERE i = 1),
el AS (
  SELECT model, fold, sum(n) OVER o AS f, sum(k) OVER o AS c
  FROM (SELECT model, fold, p, count(*) AS n, sum(y) AS k FROM ev GROUP BY ALL UNION ALL SELECT model, fold, CAST('inf' AS DOUBLE), 0, 0 FROM es) WINDOW o AS (PARTITION BY model, fold ORDER BY p DESC)),
fr AS (
  SELECT regime, capacity, policy, model, fold, CAST(NULL AS DOUBLE) AS t, rate, inflation, cn, ck, max(f) AS f, max(c) AS c
  FROM ch JOIN es USING (model, fold) JOIN el USING (model, fold)
  WHERE f <= floor(en * least(rate, coalesce(capacity, CAST(1.0 AS DOUBLE))) + CAST(1e-10 AS DOUBLE)) GROUP BY ALL)"""


def _judged(flagged: str) -> str:
    """CTE `folds` from what policies flag."""
    return f"""
q AS (
  SELECT *, CASE WHEN capacity IS NULL THEN en ELSE floor(en * capacity + CAST(1e-10 AS DOUBLE)) END AS eq, CASE WHEN capacity IS NULL THEN cn ELSE floor(cn * capacity + CAST(1e-10 AS DOUBLE)) END AS cq
  FROM {flagged} x JOIN es USING (model, fold) JOIN au USING (model, fold) JOIN ap USING (model, fold) JOIN tk USING (model, fold)),
b AS (
  SELECT *, cq * {INSPECT} * cn + (cn - cq) * ck * {ESCAPE} < ck * {ESCAPE} * cn AS takes, ek * CAST({ESCAPE} AS DOUBLE) AS nothing,
         eq * {INSPECT} + (en - eq) * {ESCAPE} * (ek / en) AS alternative, f * {INSPECT} + (ek - c) * {ESCAPE} AS total FROM q),
folds AS (
  SELECT regime, policy, model, fold, CAST(cn AS BIGINT) AS n_cal, CAST(ck AS BIGINT) AS n_fail_cal, CAST(en AS BIGINT) AS n_eval, CAST(ek AS BIGINT) AS n_fail_eval,
         t AS threshold, rate AS target_flag_rate, inflation AS escape_inflation, CAST(f AS BIGINT) AS n_flagged, CAST(c AS BIGINT) AS caught, CAST(ek - c AS BIGINT) AS missed,
         f / en AS flag_rate, c / nullif(ek, 0) AS catch_rate, pr_auc, roc_auc, recall_at_20, lift_at_20, CAST(total AS BIGINT) AS total_model, total / en AS cost_model,
         nothing / en AS cost_none, CAST({INSPECT} AS DOUBLE) AS cost_all, CASE WHEN takes THEN alternative ELSE nothing END / en AS cost_baseline,
         CASE WHEN NOT takes THEN 'inspect_none' WHEN eq = en THEN 'inspect_all' ELSE 'random_at_capacity' END AS baseline_action,
         least(nothing, alternative) / en AS cost_oracle_baseline, (CASE WHEN takes THEN alternative ELSE nothing END - total) / nullif(CASE WHEN takes THEN alternative ELSE nothing END, 0) AS saving,
         CAST(eq AS BIGINT) AS quota, capacity FROM b)"""


#: Backtest of the threshold policy, and of all three.
BACKTEST = f"{_FLAGGED}, {_judged('fl')}"
POLICIES = f"{_FLAGGED}, {_RATED}, {_judged('(SELECT * FROM fl UNION ALL BY NAME SELECT * FROM fr)')}"
REFERENCE = f"""
o AS (SELECT DISTINCT regime, capacity, fold, n_eval AS n, n_fail_eval AS k, quota AS q FROM folds),
a AS (SELECT regime, capacity, sum(k * {ESCAPE}) / sum(n) AS none, sum(q * {INSPECT} + (n - q) * {ESCAPE} * (k / n)) / sum(n) AS random FROM o GROUP BY ALL),
acts AS (
  SELECT regime, 0 AS place, 'inspect_none' AS action, none AS cost, true AS feasible FROM a
  UNION ALL SELECT regime, 1, 'inspect_all', CAST({INSPECT} AS DOUBLE), capacity IS NULL FROM a
  UNION ALL SELECT regime, 2, 'random_at_capacity', random, true FROM a WHERE capacity IS NOT NULL),
refs AS (
  SELECT regime, action, cost, feasible, feasible AND row_number() OVER (PARTITION BY regime, feasible ORDER BY cost, place) = 1 AS is_best FROM acts)"""
SUMMARY = """
summary AS (
  SELECT regime, policy, model, count(*) AS n_folds, quantile_cont(saving, 0.5) AS saving_median, quantile_cont(saving, 0.25) AS saving_q25, quantile_cont(saving, 0.75) AS saving_q75,
         min(saving) AS saving_min, max(saving) AS saving_max, count(*) FILTER (saving > 0) AS folds_profitable, quantile_cont(roc_auc, 0.5) AS roc_auc_median,
         quantile_cont(pr_auc, 0.5) AS pr_auc_median, quantile_cont(lift_at_20, 0.5) AS lift_at_20_median, quantile_cont(catch_rate, 0.5) AS catch_rate_median,
         quantile_cont(flag_rate, 0.5) AS flag_rate_median, CAST(sum(n_eval) AS BIGINT) AS eval_lots, CAST(sum(n_fail_eval) AS BIGINT) AS eval_fails, CAST(sum(total_model) AS BIGINT) AS total_model,
         sum(total_model) / sum(n_eval) AS cost_per_lot, sum(cost_baseline * n_eval) / sum(n_eval) AS baseline_cost_per_lot, CAST(sum(caught) AS BIGINT) AS total_caught,
         CAST(sum(missed) AS BIGINT) AS total_missed, sum(caught) / nullif(sum(n_fail_eval), 0) AS catch_rate_pooled FROM folds GROUP BY ALL)"""


@query(f"WITH {LOTS}, {FOLDS}, {BACKTEST} SELECT * FROM folds")
def fold_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds(spark, sf_dir)


@query(f"WITH RECURSIVE {LOTS}, {FOLDS}, {POLICIES} SELECT * REPLACE (round(escape_inflation * 1000000) / 1000000 AS escape_inflation) FROM folds")
def policy_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three policies; upper bounds of rates are found by two methods here and in SQL, so the inflation is rounded."""
    return folds(spark, sf_dir, backtest.POLICIES).withColumn("escape_inflation", profile.rounded(F.col("escape_inflation"), 6))


@query()
def backtest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.fold_summary(fitted_folds(spark, sf_dir, backtest.POLICIES))


@query()
def history_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("raw", "augmented")
    lots = once(partial(_numbered, spark, sf_dir))  # sorted and numbered once for both
    return ablation(dict(zip(kinds, side_by_side([partial(_scored_folds, spark, sf_dir, tuple(models.REGISTRY), kind, lots) for kind in kinds]), strict=True)))


@query(f"WITH {LOTS}, {FOLDS}, {BACKTEST}, {REFERENCE} SELECT * FROM refs")
def reference_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.reference_costs(folds(spark, sf_dir), INSPECT, ESCAPE)


@query(f"WITH {LOTS}, {FOLDS}, {BACKTEST}, {SUMMARY} SELECT * FROM summary")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.fold_summary(folds(spark, sf_dir))


@query(f"""
WITH {LOTS}, {FOLDS}, {BACKTEST}, {REFERENCE}, {SUMMARY}
SELECT s.regime, any_value(action) AS reference_action, any_value(cost) AS reference_cost, count(*) AS n_configs, count(*) FILTER (round(total_model - cost * eval_lots, 3) < 0) AS n_better,
       first(model ORDER BY total_model, model) AS cheapest_model, first(policy ORDER BY total_model, model) AS cheapest_policy, first(cost_per_lot ORDER BY total_model, model) AS cheapest_cost
FROM summary s JOIN refs r ON s.regime = r.regime AND is_best GROUP BY s.regime""")
def dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.dominance(written(folds(spark, sf_dir), "folds"), INSPECT, ESCAPE)


PSI = """
h AS (SELECT long.*, row_id < (SELECT count(*) // 2 FROM lots) AS is_ref FROM long),
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM h WHERE is_ref GROUP BY feature),
c AS (
  SELECT feature, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(e[2:len(e) - 1], lambda v: v <= x)) END AS bin, count(*) FILTER (is_ref) AS a, count(*) FILTER (NOT is_ref) AS b
  FROM h JOIN e USING (feature) WHERE len(e) >= 2 GROUP BY 1, 2),
g AS (SELECT feature, greatest(a / sum(a) OVER (PARTITION BY feature), 1e-6) AS a, greatest(b / sum(b) OVER (PARTITION BY feature), 1e-6) AS b FROM c),
psi AS (SELECT feature, psi FROM (SELECT DISTINCT feature FROM h) LEFT JOIN (SELECT feature, sum((b - a) * ln(b / a)) AS psi FROM g GROUP BY feature) USING (feature))"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lots = written(src.lots_events(spark, sf_dir), "lots")
    half = lots.count() // 2
    return lots.where(F.col("row_id") < half), lots.where(F.col("row_id") >= half)


@query(f"WITH {LOTS}, {LONG}, {PSI} SELECT feature, psi FROM psi")
def feature_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.feature_psi(*_halves(spark, sf_dir))


@query(f"""
WITH {LOTS}, {LONG}, {PSI}
SELECT count(psi) AS psi_usable, count(*) FILTER (psi > 0.25) AS psi_major, count(*) FILTER (psi > 0.25) / nullif(count(psi), 0) AS psi_share_major,
       coalesce(count(*) FILTER (psi > 0.25) / nullif(count(psi), 0) > 0.1, false) AS input_drifted FROM psi""")
def retrain_input_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.input_drift(drift.feature_psi(*_halves(spark, sf_dir))).drop("psi_top")


#: Regimes of counts (id, n, k) by two-sided bounds of 95 %.
_REGIMES = bounds_sql("SELECT id, 'lo' AS side, k - 1 AS j, n, CAST(0.975 AS DOUBLE) AS target FROM counts WHERE k > 0 UNION ALL SELECT id, 'hi', k, n, CAST(0.025 AS DOUBLE) FROM counts WHERE k < n") + f""",
regimes AS (
  SELECT counts.*, coalesce(lo.p, 0.0) AS ci_lo, coalesce(hi.p, 1.0) AS ci_hi, CAST({INSPECT} AS DOUBLE) / {ESCAPE} AS breakeven
  FROM counts LEFT JOIN bound lo ON lo.id = counts.id AND lo.side = 'lo' LEFT JOIN bound hi ON hi.id = counts.id AND hi.side = 'hi'),
named AS (SELECT *, CASE WHEN ci_lo > breakeven THEN 'inspect' WHEN ci_hi < breakeven THEN 'no_inspect' ELSE 'undecided' END AS regime FROM regimes)"""


@query(f"""
WITH RECURSIVE {LOTS}, {LONG}, {PSI}, counts AS (SELECT CASE WHEN row_id < (SELECT count(*) // 2 FROM lots) THEN 'ref' ELSE 'cur' END AS id, count(*) AS n, sum(fail) AS k FROM lots GROUP BY 1), {_REGIMES},
r AS (SELECT max(regime) FILTER (id = 'ref') AS a, max(regime) FILTER (id = 'cur') AS b FROM named),
i AS (SELECT count(psi) AS usable, count(*) FILTER (psi > 0.25) AS major, string_agg(feature, ',' ORDER BY psi DESC, feature) FILTER (psi IS NOT NULL) AS top FROM psi),
o AS (SELECT *, a <> 'undecided' AND b <> 'undecided' AND a <> b AS flipped, coalesce(major / nullif(usable, 0) > 0.1, false) AS drifted FROM r, i)
SELECT a AS reference_regime, b AS current_regime, usable AS psi_usable, major AS psi_major, major / nullif(usable, 0) AS psi_share_major, drifted AS input_drifted, top AS psi_top, flipped AS action_flipped, flipped OR drifted AS retrain FROM o""")
def retraining_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """psi_top names the features that drifted most, in order."""
    out = drift.retraining_trigger(*_halves(spark, sf_dir), drift.breakeven_prevalence(INSPECT, ESCAPE))
    return out.withColumn("psi_top", F.array_join(F.transform("psi_top", lambda x: x["feature"]), ","))


@query(f"""
WITH RECURSIVE w AS (SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS n, CAST(sum(CAST(event_type = 'error' AND value > 100 AS INTEGER)) AS BIGINT) AS k FROM events GROUP BY 1),
counts AS (SELECT week AS id, n, k FROM w), {_REGIMES}
SELECT id AS week, n, k AS n_fail, k / n AS prevalence, round(ci_lo * 1000000) / 1000000 AS ci_lo, round(ci_hi * 1000000) / 1000000 AS ci_hi, breakeven, regime FROM named""")
def prevalence_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekly_regimes(spark, sf_dir).withColumns({c: profile.rounded(F.col(c), 6) for c in ("ci_lo", "ci_hi")})


def _weekly_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = src.lots_events(spark, sf_dir, rare=True, numbered=False).groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n"), F.sum("fail").alias("n_fail"))
    return drift.prevalence_regime(weeks, drift.breakeven_prevalence(INSPECT, ESCAPE))


@query(f"""
WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS window, count(*) AS n, CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS n_fail FROM orders GROUP BY 1)
SELECT *, CASE WHEN n_fail > 0 THEN greatest(1.0, 1 / (n_fail / n * {ESCAPE // INSPECT})) ELSE CAST('inf' AS DOUBLE) END AS required_lift FROM w""")
def required_lift_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.required_lift_by_window(src.lots_orders(spark, sf_dir), ESCAPE // INSPECT, F.date_trunc("week", "ts"))


_Z = power._z(0.05, 0.8)


@query(f"""
WITH {LOTS}, {FOLDS}, c AS (SELECT fold, count(*) AS n, CAST(sum(fail) AS BIGINT) AS k FROM w WHERE role = 'eval' GROUP BY fold)
SELECT fold, n, k AS n_fail, CASE WHEN k > 0 AND k < n THEN 0.5 + {_Z!r} * sqrt((n + 1) / (12.0 * k * (n - k))) END AS min_auc, CAST({ESCAPE} AS DOUBLE) / n AS cost_resolution,
       CAST(ceil({_Z**2!r} / (k / n) / (12 * ((1 - k / n) / (k / n)) * CAST(0.0025 AS DOUBLE)) ) AS BIGINT) AS positives_for_055 FROM c""")
def min_detectable_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = backtest.fold_windows(src.lots_events(spark, sf_dir)).where("role = 'eval'").select("fold", "n", "n_fail")
    n, k = F.col("n"), F.col("n_fail")
    needed = power.required_positives(0.55, profile.ratio(k, n))
    return w.select("fold", "n", "n_fail", power.min_detectable_auc(k, n - k).alias("min_auc"), power.cost_resolution(n, ESCAPE).alias("cost_resolution"), F.ceil(needed).cast("long").alias("positives_for_055"))


@query(f"""
WITH {LOTS}, {LONG}, a AS (
  SELECT feature, count(*) AS n, count(*) - count(x) AS n_missing, avg(fail) FILTER (x IS NULL) AS rate_missing, avg(fail) FILTER (x IS NOT NULL) AS rate_present FROM long GROUP BY feature)
SELECT *, n_missing / n AS missing_frac, abs(rate_missing - rate_present) AS gap FROM a WHERE n_missing / n > 0.02 AND n_missing / n < 0.98 ORDER BY gap DESC, feature LIMIT 10""")
def missingness_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missingness_gap(src.lots_events(spark, sf_dir, numbered=False))


@query(f"""
WITH {LOTS}, {LONG}, a AS (
  SELECT feature, count(x) FILTER (fail = 1) AS n_fail, count(x) FILTER (fail = 0) AS n_pass, avg(x) FILTER (fail = 1) AS mean_fail, avg(x) FILTER (fail = 0) AS mean_pass,
         var_samp(x) FILTER (fail = 1) AS v1, var_samp(x) FILTER (fail = 0) AS v0 FROM long GROUP BY feature)
SELECT feature, n_fail, n_pass, mean_fail, mean_pass, round((mean_fail - mean_pass) / sqrt(v1 / n_fail + v0 / n_pass) * 10000) / 10000 + 0.0 AS t,
       round(pow(v1 / n_fail + v0 / n_pass, 2) / (pow(v1 / n_fail, 2) / (n_fail - 1) + pow(v0 / n_pass, 2) / (n_pass - 1)) * 10000) / 10000 AS df
FROM a WHERE n_fail > 20 AND n_pass > 20 AND (v1 > 0 OR v0 > 0)""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.welch_t(src.lots_events(spark, sf_dir, numbered=False), with_p=False)
    return out.withColumns({c: profile.rounded(F.col(c), 4) + 0.0 for c in ("t", "df")})


@query(f"""
WITH {LOTS}, {LONG}, a AS (
  SELECT feature, count(x) FILTER (fail = 1) AS n1, count(x) FILTER (fail = 0) AS n0, avg(x) FILTER (fail = 1) AS m1, avg(x) FILTER (fail = 0) AS m0,
         var_samp(x) FILTER (fail = 1) AS v1, var_samp(x) FILTER (fail = 0) AS v0 FROM long GROUP BY feature),
t AS (SELECT feature, abs(m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df
      FROM a WHERE n1 > 20 AND n0 > 20 AND (v1 > 0 OR v0 > 0)),
q AS (SELECT feature, 1 - 2 * (t / 4000 / 3) * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df)
             * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2))) AS p FROM t)
SELECT feature, round(p * 1000000) / 1000000 AS p, row_number() OVER (ORDER BY p, feature) AS place, count(*) FILTER (p < 0.01) OVER () AS n_below FROM q""")
def welch_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by the p-value of Welch's test, and how many are below 0.01; the SQL integrates the density. A p near 1 is known to about 1e-8."""
    tested = written(profile.welch_t(src.lots_events(spark, sf_dir, numbered=False)).select("feature", "p"), "tested")
    below = tested.agg(F.count_if(F.col("p") < 0.01).alias("n_below"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p", "feature"))  # a row a feature
    return tested.withColumn("place", place).crossJoin(F.broadcast(below)).withColumn("p", profile.rounded(F.col("p"), 6))


@query(f"""
WITH {LOTS}, {LONG}, {FOLDS}, a AS (SELECT feature, count(DISTINCT x) AS n_distinct, 1 - count(x) / count(*) AS missing_frac FROM long WHERE row_id < (SELECT a FROM f WHERE fold = 1) GROUP BY feature)
SELECT *, n_distinct <= 1 AS is_constant, missing_frac > 0.5 AS is_sparse, n_distinct > 1 AND missing_frac <= 0.5 AS kept FROM a""")
def drop_columns_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = written(src.lots_events(spark, sf_dir), "lots")
    return prep.column_verdicts(lots.where(F.col("row_id") < backtest.fold_bounds(lots.count())[0]["train"]))


@query("""
WITH l AS (SELECT l_quantity AS f000, l_extendedprice AS f001, l_discount AS f002, l_tax AS f003 FROM lineitem)
SELECT 'f000' AS a, 'f001' AS b, corr(f000, f001) AS r FROM l UNION ALL SELECT 'f000', 'f002', corr(f000, f002) FROM l UNION ALL SELECT 'f000', 'f003', corr(f000, f003) FROM l
UNION ALL SELECT 'f001', 'f002', corr(f001, f002) FROM l UNION ALL SELECT 'f001', 'f003', corr(f001, f003) FROM l UNION ALL SELECT 'f002', 'f003', corr(f002, f003) FROM l""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.correlations(src.lots_lineitem(spark, sf_dir), ["f000", "f001", "f002", "f003"])


@query(f"""
WITH {LOTS}, {LONG}, m AS (SELECT feature, quantile_cont(x, 0.5) AS median FROM long WHERE feature IN ('f000', 'f001', 'f002') GROUP BY feature)
SELECT feature, any_value(median) AS median, avg(coalesce(x, median)) AS mean, stddev_pop(coalesce(x, median)) AS spread FROM long JOIN m USING (feature) GROUP BY feature""")
def impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.impute_scale_params(src.lots_events(spark, sf_dir, numbered=False), ["f000", "f001", "f002"])


@query()
def bootstrap_cost_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = written(fitted_folds(spark, sf_dir), "folds")
    each = [
        inference.bootstrap_cost_ci(f.where(F.col("regime") == r), ["regime", "policy", "model"], action, INSPECT, ESCAPE, cap)
        for (r, cap), action in zip(CAPS.items(), ("inspect_all", "random_at_capacity"), strict=True)
    ]
    return each[0].unionByName(each[1])


@query()
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.permutation_test(fitted_folds(spark, sf_dir), ["regime", "policy", "model"])


#: Laws of what a random quota catches, of one fold (law1) to all four (l4), and what was caught (o).
LAWS = """
h AS (SELECT regime, policy, model, fold, n_eval AS n, n_fail_eval AS k, n_flagged AS m, caught FROM folds),
law1 AS (
  SELECT h.*, x, exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(n - k + 1) - lgamma(m - x + 1) - lgamma(n - k - m + x + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)) AS p
  FROM (SELECT *, unnest(range(greatest(0, m + k - n), least(m, k) + 1)) AS x FROM h) h),
l2 AS (SELECT a.regime, a.policy, a.model, a.x + b.x AS x, sum(a.p * b.p) AS p FROM law1 a JOIN law1 b USING (regime, policy, model) WHERE a.fold = 1 AND b.fold = 2 GROUP BY ALL),
l3 AS (SELECT a.regime, a.policy, a.model, a.x + b.x AS x, sum(a.p * b.p) AS p FROM l2 a JOIN law1 b USING (regime, policy, model) WHERE b.fold = 3 GROUP BY ALL),
l4 AS (SELECT a.regime, a.policy, a.model, a.x + b.x AS x, sum(a.p * b.p) AS p FROM l3 a JOIN law1 b USING (regime, policy, model) WHERE b.fold = 4 GROUP BY ALL),
o AS (SELECT regime, policy, model, sum(caught) AS seen, sum(m * k / n) AS expected FROM h GROUP BY ALL)"""


@query(f"""
WITH {LOTS}, {FOLDS}, {BACKTEST}, {LAWS}
SELECT regime, policy, model, CAST(seen AS BIGINT) AS caught, round(expected * 1000000) / 1000000 AS null_caught, round(coalesce(sum(p) FILTER (x >= seen), 0) * 10000000) / 10000000 AS exact_p
FROM l4 JOIN o USING (regime, policy, model) GROUP BY ALL""")
def permutation_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact one-sided p of catching as many failures by a random quota, without draws and without a fit."""
    laws = inference.permutation_law(folds(spark, sf_dir), ["regime", "policy", "model"])
    return laws.withColumns({"null_caught": profile.rounded(F.col("null_caught"), 6), "exact_p": profile.rounded(F.col("exact_p"), 7)})


@query()
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = written(src.lots_events(spark, sf_dir), "lots")
    scored = written(models.compare(lots, backtest.split_bounds(lots.count()), ("majority", "logreg")), "models")
    best = metrics.score_metrics(metrics.ladder(scored), scored)
    return best.join(metrics.top_shares(scored, (0.2,)).select("model", F.col("recall").alias("recall_at_20"), F.col("lift").alias("lift_at_20")), "model")


def _ranking(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lots = written(backtest.time_split(written(src.lots_events(spark, sf_dir), "lots")), "parts")
    train, val, test = (lots.where(F.col("part") == p).drop("part") for p in ("train", "val", "test"))
    return models.shapley_ranking(models.fit_one(name, train, val), test)


@query()
def feature_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Shapley values of the linear model's log-odds over the test lots."""
    return _ranking(spark, sf_dir, "logreg")


@query()
def tree_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of the boosted trees' log-odds over the test lots, along the trees' paths."""
    return _ranking(spark, sf_dir, "boosted")


@query(f"WITH {LOTS}, {FOLDS}, {BACKTEST} SELECT starts_with(baseline_action, 'inspect') AS kind, count(*) AS n_rows, string_agg(DISTINCT regime, ',' ORDER BY regime) AS regimes FROM folds GROUP BY 1")
def baselines_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.by_kind(folds(spark, sf_dir), "inspect")


@query(f"""
WITH {LOTS}, {FOLDS}, {BACKTEST}, {REFERENCE}, {SUMMARY}
SELECT DISTINCT s.model, s.policy FROM summary s JOIN refs r ON s.regime = r.regime AND is_best WHERE round(total_model - cost * eval_lots, 3) < 0""")
def winning_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.winners(written(folds(spark, sf_dir), "folds"), INSPECT, ESCAPE)


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = written(src.lots_events(spark, sf_dir), "lots")
    scored = written(models.compare(lots, backtest.split_bounds(lots.count()), ("boosted",)), "models")
    return metrics.score_metrics(metrics.ladder(scored), scored)

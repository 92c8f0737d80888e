"""Queries of report tables, on one backtest of all policies that need no fit, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldgate.functions import power
from yieldgate.operators import backtest, profile, report
from yieldgate.sources import lots as src

from .kept import kept
from .queries import CAPS, ESCAPE, FOLDS, INSPECT, LAWS, LOTS, POLICIES, REFERENCE, SUMMARY, bounds_sql, folds, query

RATIOS = (1, 2, 5, 10, 30, 100)
HEAD = f"WITH RECURSIVE {LOTS}, {FOLDS}, {POLICIES}"
_Z2 = power._z(0.05, 0.8) ** 2


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest, kept for all tables."""
    settings = {"version": 1, "caps": CAPS, "inspect": INSPECT, "escape": ESCAPE}
    return kept(spark, "policy-folds", settings, [src.table(spark, sf_dir, "events")], lambda: folds(spark, sf_dir, backtest.POLICIES))


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: profile.rounded(F.col(c), k) for c, k in places.items()})


@query(f"""
{HEAD}, {REFERENCE}, {SUMMARY},
fs AS (SELECT regime, policy, model, sum(n_flagged) AS flagged FROM folds GROUP BY ALL),
cf AS (SELECT s.*, action, cost, flagged / eval_lots AS share, round(total_model - cost * eval_lots, 3) < 0 AS better FROM summary s JOIN refs r ON s.regime = r.regime AND is_best JOIN fs ON fs.regime = s.regime AND fs.policy = s.policy AND fs.model = s.model),
g AS (
  SELECT regime, grouping(regime) = 1 AS whole, max(action) AS action, max(cost) AS cost, count(*) AS n_configs, count(*) FILTER (better) AS n_better,
         first(struct_pack(regime := regime, model := model, policy := policy, cost := cost_per_lot, share := share) ORDER BY total_model, regime, model, policy) AS c FROM cf GROUP BY GROUPING SETS ((regime), ())),
t AS (SELECT sum(k) / sum(n) AS p FROM (SELECT DISTINCT fold, n_eval AS n, n_fail_eval AS k FROM folds))
SELECT CASE WHEN whole THEN 'all' ELSE 'regime' END AS level, regime, CASE WHEN NOT whole THEN action END AS reference_action, CASE WHEN NOT whole THEN cost END AS reference_cost, n_configs, n_better,
       c.regime AS cheapest_regime, c.model AS cheapest_model, c.policy AS cheapest_policy, c.cost AS cheapest_cost, c.share AS cheapest_share, p AS prevalence, p * {ESCAPE / INSPECT} AS p_ratio,
       CASE WHEN p > 0 THEN greatest(1.0, 1 / (p * {ESCAPE / INSPECT})) ELSE CAST('inf' AS DOUBLE) END AS required_lift FROM g, t""")
def report_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.headline(_folds(spark, sf_dir), INSPECT, ESCAPE)


@query(f"""
{HEAD}
SELECT regime, policy, model, count(*) AS n_folds, min(target_flag_rate) AS rate_lo, quantile_cont(target_flag_rate, 0.5) AS rate_median, max(target_flag_rate) AS rate_hi, count(*) FILTER (target_flag_rate >= 0.8) AS folds_high_rate,
       round(min(escape_inflation) * 1000000) / 1000000 AS inflation_lo, round(max(escape_inflation) * 1000000) / 1000000 AS inflation_hi, count(*) FILTER (n_flagged = quota) AS folds_full_quota,
       count(*) FILTER (n_fail_eval = 0) AS folds_without_failures, count(*) FILTER (round(cost_baseline - cost_oracle_baseline, 9) > 0) AS baselines_wrong, count(*) FILTER (baseline_action = 'inspect_none') AS baselines_none
FROM folds GROUP BY regime, policy, model""")
def report_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.protocol(_folds(spark, sf_dir)), inflation_lo=6, inflation_hi=6)


_ASKED = "SELECT id * 2 AS id, 'lo' AS side, k - 1 AS j, n, CAST(0.975 AS DOUBLE) AS target FROM counted WHERE k > 0 UNION ALL SELECT id * 2 + 1, 'hi', k, n, CAST(0.025 AS DOUBLE) FROM counted WHERE k < n"


@query(f"""
WITH RECURSIVE {LOTS}, {FOLDS}, {POLICIES.replace('halves', 'halves1').replace('bound', 'bound1')},
g AS (
  SELECT CASE grouping_id(regime, policy, model) WHEN 0 THEN 'regime/policy/model' WHEN 1 THEN 'regime/policy' WHEN 2 THEN 'regime/model' WHEN 3 THEN 'regime' ELSE 'all' END AS level, regime, policy, model,
         count(*) AS n_rows, sum(total_model) / sum(n_eval) AS cost_per_lot, sum(cost_baseline * n_eval) / sum(n_eval) AS baseline_cost_per_lot, quantile_cont(saving, 0.5) AS saving_median, min(saving) AS saving_min,
         quantile_cont(roc_auc, 0.5) AS roc_auc_median, quantile_cont(lift_at_20, 0.5) AS lift_at_20_median, CAST(sum(n_flagged) AS BIGINT) AS total_flagged, CAST(sum(caught) AS BIGINT) AS total_caught,
         CAST(sum(missed) AS BIGINT) AS total_missed, count(*) FILTER (saving > 0) AS folds_profitable
  FROM folds GROUP BY GROUPING SETS ((regime, policy, model), (regime, policy), (regime, model), (regime), ())),
counted AS (SELECT row_number() OVER (ORDER BY k, n) AS id, k, n FROM (SELECT DISTINCT total_caught AS k, total_caught + total_missed AS n FROM g WHERE level = 'regime/policy/model')), {bounds_sql(_ASKED)},
ci AS (SELECT k, n, coalesce(max(p) FILTER (side = 'lo'), 0) AS lo, coalesce(max(p) FILTER (side = 'hi'), 1) AS hi FROM counted c LEFT JOIN bound b ON b.id // 2 = c.id GROUP BY k, n)
SELECT g.*, round(lo * 1000000) / 1000000 AS catch_lo, round(hi * 1000000) / 1000000 AS catch_hi FROM g LEFT JOIN ci ON level = 'regime/policy/model' AND k = total_caught AND n = total_caught + total_missed""")
def report_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.comparison(_folds(spark, sf_dir)), catch_lo=6, catch_hi=6)


@query(f"""
{HEAD}, {LAWS}, {SUMMARY},
law AS (SELECT regime, policy, model, CAST(seen AS BIGINT) AS caught, expected AS null_caught, coalesce(sum(p) FILTER (x >= seen), 0) AS exact_p FROM l4 JOIN o USING (regime, policy, model) GROUP BY ALL)
SELECT regime, policy, model, eval_lots, eval_fails, saving_median, saving_median * baseline_cost_per_lot AS gap_per_lot, CAST({ESCAPE} AS DOUBLE) / eval_lots AS cost_per_failure,
       round(saving_median * baseline_cost_per_lot / (CAST({ESCAPE} AS DOUBLE) / eval_lots) * 1000000) / 1000000 AS gap_failures, caught, round(null_caught * 1000000) / 1000000 AS null_caught, round(exact_p * 1000000) / 1000000 AS exact_p
FROM summary JOIN law USING (regime, policy, model)""")
def report_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.uncertainty(_folds(spark, sf_dir), ESCAPE), gap_failures=6, null_caught=6, exact_p=6)


@query(f"""
{HEAD},
t AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM (SELECT DISTINCT fold, n_eval AS n, n_fail_eval AS k FROM folds)),
r AS (SELECT n, k, a, (1 + (1 - k / n) / (k / n)) * {_Z2!r} / (12 * ((1 - k / n) / (k / n)) * pow(a - 0.5, 2)) AS needed FROM t, (SELECT unnest([CAST(0.65 AS DOUBLE), CAST(0.6 AS DOUBLE), CAST(0.55 AS DOUBLE)]) AS a))
SELECT a AS target_auc, n AS n_lots, k AS n_fail, 0.5 + {power._z(0.05, 0.8)!r} * sqrt((n + 1) / (12.0 * k * (n - k))) AS min_auc, CAST(ceil(needed) AS BIGINT) AS required_positives,
       CAST(ceil(needed / (k / n)) AS BIGINT) AS required_lots, ceil(needed) / k AS times_current FROM r""")
def report_detectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.detectable(_folds(spark, sf_dir))


@query(f"""
{HEAD},
one AS (SELECT DISTINCT model, fold, n_eval AS n, n_fail_eval AS k, lift_at_20 AS lift FROM folds),
g AS (SELECT model, fold, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, quantile_cont(lift, 0.5) AS lift FROM one GROUP BY GROUPING SETS ((model, fold), (model))),
r AS (SELECT *, k / n AS p FROM g, (SELECT unnest([{", ".join(f"CAST({x} AS DOUBLE)" for x in RATIOS)}]) AS r)),
bars AS (SELECT *, CASE WHEN p * r > 0 THEN greatest(1.0, 1 / (p * r)) ELSE CAST('inf' AS DOUBLE) END AS bar FROM r)
SELECT model, coalesce(fold, 0) AS fold, r AS cost_ratio, n AS n_lots, k AS n_fail, p AS prevalence, 1 / r AS breakeven, p * r >= 1 AS inspection_pays, bar AS required_lift, lift AS lift_at_20, lift > bar AS clears FROM bars""")
def report_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.feasibility(_folds(spark, sf_dir), RATIOS)

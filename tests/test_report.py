from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from yieldgate.functions import beta
from yieldgate.operators import backtest, report


@pytest.fixture(scope="module")
def quiet(spark):
    """A backtest whose evaluation windows have no failures."""
    rows = spark.range(200).select(F.col("id").alias("row_id"), F.expr("timestampadd(HOUR, cast(id as int), timestamp'2024-01-01 00:00:00')").alias("ts"), ((F.col("id") < 60) & (F.col("id") % 7 == 0)).cast("int").alias("fail"), F.col("id").cast("double").alias("f000"))
    scored = backtest.scored_folds(rows, {"x": F.col("f000") / 200}, backtest.fold_bounds(200, folds=2))
    return backtest.run_folds(scored, 2000, 60000, {"free": None, "capped": 0.2})


def _folds(spark, rows):
    """Folds of one regime: model, fold, n_eval, n_fail_eval, n_flagged, caught."""
    cols = "regime string, policy string, model string, fold int, n_eval long, n_fail_eval long, n_flagged long, caught long, quota long, capacity double"
    df = spark.createDataFrame([("free", "robust", *r, r[2], None) for r in rows], cols)
    model = F.col("n_flagged") * 2000 + (F.col("n_fail_eval") - F.col("caught")) * 60000
    return df.select("*", (F.col("n_fail_eval") - F.col("caught")).alias("missed"), model.alias("total_model"), F.lit(2000.0).alias("cost_baseline"), F.lit(1900.0).alias("cost_oracle_baseline"), (1 - model / (F.col("n_eval") * 2000)).alias("saving"), F.lit(0.5).alias("roc_auc"), F.lit(0.1).alias("pr_auc"), F.lit(1.5).alias("lift_at_20"), (F.col("caught") / F.col("n_fail_eval")).alias("catch_rate"), (F.col("n_flagged") / F.col("n_eval")).alias("flag_rate"), F.lit(0.9).alias("target_flag_rate"), F.lit(1.9).alias("escape_inflation"), F.lit("inspect_all").alias("baseline_action"))


@pytest.fixture(scope="module")
def published(spark):
    """Folds of a published backtest, and a model that flags all."""
    cells = [(176, 6, 151, 6), (176, 6, 49, 0), (176, 17, 172, 17), (178, 4, 169, 4)]
    return _folds(spark, [("lgbm", k, *c) for k, c in enumerate(cells)] + [("all", k, n, f, n, f) for k, (n, f, _, _) in enumerate(cells)])


def test_comparison(published):
    rows = {(r["level"], r["model"]): r for r in report.comparison(published).collect()}
    r = rows["regime/policy/model", "lgbm"]
    assert r["cost_per_lot"] == pytest.approx(2042.4929178470254) and (r["total_caught"], r["total_missed"], r["n_rows"]) == (27, 6, 4)
    assert (r["catch_lo"], r["catch_hi"]) == pytest.approx(beta.rate_interval(27, 33))
    assert rows["regime/policy/model", "all"]["catch_hi"] == 1.0
    total = rows["all", None]
    assert total["n_rows"] == 8 and total["catch_lo"] is None and total["cost_per_lot"] == pytest.approx((2042.4929178470254 + 2000) / 2)
    assert sorted(level for level, _ in rows) == ["all", "regime", "regime/model", "regime/model", "regime/policy", "regime/policy/model", "regime/policy/model"]


def test_headline(published):
    rows = {r["level"]: r for r in report.headline(published, 2000, 60000).collect()}
    r = rows["regime"]
    assert (r["reference_action"], r["n_configs"], r["n_better"], r["cheapest_model"], r["cheapest_share"]) == ("inspect_all", 2, 0, "all", 1.0)
    assert r["prevalence"] == pytest.approx(33 / 706) and r["p_ratio"] == pytest.approx(33 / 706 * 30) and r["required_lift"] == 1.0
    assert rows["all"]["reference_action"] is None and rows["all"]["n_configs"] == 2


def test_protocol(published):
    r = {x["model"]: x for x in report.protocol(published).collect()}["lgbm"]
    assert (r["folds_high_rate"], r["folds_full_quota"], r["baselines_wrong"], r["baselines_none"], r["inflation_hi"]) == (4, 0, 4, 0, 1.9)


def test_uncertainty(published):
    r = {x["model"]: x for x in report.uncertainty(published, 60000).collect()}
    assert r["lgbm"]["exact_p"] == pytest.approx(0.68949, abs=1e-5) and r["all"]["exact_p"] == pytest.approx(1.0)
    assert r["lgbm"]["cost_per_failure"] == pytest.approx(60000 / 706)
    assert r["lgbm"]["gap_failures"] == pytest.approx(r["lgbm"]["saving_median"] * 2000 / (60000 / 706))


def test_detectable(published):
    rows = {r["target_auc"]: r for r in report.detectable(published).collect()}
    assert rows[0.6]["n_fail"] == 33 and rows[0.6]["min_auc"] == pytest.approx(0.6445, abs=2e-3)
    assert rows[0.55]["required_positives"] > rows[0.6]["required_positives"] > rows[0.65]["required_positives"]
    assert rows[0.6]["times_current"] == rows[0.6]["required_positives"] / 33


def test_feasibility(published):
    rows = {(r["model"], r["fold"], r["cost_ratio"]): r for r in report.feasibility(published.withColumn("fold", F.col("fold") + 1), (10, 30)).collect()}
    assert len(rows) == 2 * 5 * 2
    r = rows["lgbm", 0, 10.0]
    assert not r["inspection_pays"] and r["required_lift"] == pytest.approx(706 / 330) and not r["clears"]
    assert rows["lgbm", 0, 30.0]["clears"] and rows["lgbm", 3, 30.0]["prevalence"] == pytest.approx(17 / 176)


def test_windows_without_failures(quiet):
    made = {k: v.collect() for k, v in report.tables(quiet, 2000, 60000).items()}
    assert all(made.values())
    assert {r["n_fail"] for r in made["detectable"]} == {0} and {r["required_positives"] for r in made["detectable"]} == {None}
    assert all(r["required_lift"] == float("inf") and not r["inspection_pays"] for r in made["feasibility"])
    assert {r["exact_p"] for r in made["uncertainty"]} == {1.0}
    assert all((r["catch_lo"], r["catch_hi"]) == (0.0, 1.0) for r in made["comparison"] if r["level"] == "regime/policy/model")
    assert {r["folds_without_failures"] for r in made["protocol"]} == {2} and len(made["headline"]) == 3


def test_no_folds(published):
    assert report.comparison(published.limit(0)).where("level <> 'all'").count() == 0 and report.protocol(published.limit(0)).count() == 0

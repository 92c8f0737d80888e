from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from yieldgate.functions import beta, power
from yieldgate.operators import drift, inference, prep, profile
from yieldgate.plans import queries
from yieldgate.streaming import monitor

#: Folds of a published backtest: n_eval, n_fail, n_flagged, caught.
GOLDEN = [(176, 6, 151, 6), (176, 6, 49, 0), (176, 17, 172, 17), (178, 4, 169, 4)]


def folds(spark, cells):
    rows = [("c", k, n, flagged, caught, failed - caught) for k, (n, failed, flagged, caught) in enumerate(cells)]
    return spark.createDataFrame(rows, "config string, fold int, n_eval long, n_flagged long, caught long, missed long")


def test_intervals_of_rates():
    assert beta.rate_interval(6, 176) == pytest.approx((0.012611639731919234, 0.07272172723499275), abs=1e-13)
    assert beta.rate_interval(65, 626) == pytest.approx((0.08105424707332, 0.13042711817368594), abs=1e-13)
    assert beta.rate_interval(0, 50)[0] == 0 and beta.rate_interval(50, 50)[1] == 1 and beta.upper_rate(0, 0) == 1
    assert beta.upper_rate(7, 235) > beta.upper_rate(700, 23500) > 7 / 235


def test_p_values():
    assert beta.welch_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert beta.normal_quantile(0.975) == pytest.approx(1.959963984540054)


def test_equal_readings_are_not_tested_however_tasks_deal_them(spark):
    # 49 of each class in a task: 1 / 49 * 49 is not 1 as a double, so merged means of a constant differ from it.
    lots = spark.range(0, 490, 1, 5).select(F.lit(0).alias("ts"), (F.col("id") % 2).cast("int").alias("fail"), (F.col("id") % 11).cast("double").alias("f000"), F.lit(1.0).alias("f003"))
    assert [r["feature"] for r in profile.welch_t(lots, with_p=False).collect()] == ["f000"]
    one_side = profile.welch_t(lots.withColumn("f000", F.when(F.col("fail") == 1, F.col("f000")).otherwise(1.0)), with_p=False).first()
    assert one_side["df"] == pytest.approx(244, abs=1e-9) and one_side["feature"] == "f000"
    assert {r["feature"]: r["spread"] > 0 for r in prep.impute_scale_params(lots).collect()} == {"f000": True, "f003": False}


def test_p_of_equal_readings_has_no_place(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, ("view", "error")[i % 2], float(i % 11), f'{{"k": {i % 13}}}') for i in range(784)]
    for k in range(8):
        spark.createDataFrame(rows[98 * k : 98 * k + 98], "ts timestamp, event_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert sorted(r["feature"] for r in queries.welch_p(spark, str(tmp_path)).collect()) == ["f000", "f001", "f002"]


def test_bootstrap(spark):
    row = inference.bootstrap_cost_ci(folds(spark, GOLDEN), ["config"], "inspect_all", 2000, 60000).first()
    assert (row["saving_lo"], row["saving_hi"]) == pytest.approx((-0.23512748, 0.15864023), abs=1e-6)
    assert row["share_cheaper"] == pytest.approx(0.436, abs=5e-4)  # published with three digits
    same = inference.bootstrap_cost_ci(folds(spark, [(100, 10, 100, 10)]), ["config"], "inspect_all", 2000, 60000, draws=500).first()
    assert (same["difference_lo"], same["difference_hi"], same["share_cheaper"]) == (0, 0, 0)


def test_permutation(spark):
    row = inference.permutation_test(folds(spark, GOLDEN), ["config"]).first()
    assert row["exact_p"] == pytest.approx(0.68949, abs=1e-5) and row["p_value"] == pytest.approx(0.687, abs=0.005)
    perfect = inference.permutation_test(folds(spark, [(100, 10, 10, 10)]), ["config"], draws=200).first()
    assert perfect["p_value"] == pytest.approx(1 / 201)


def test_permutation_law(spark):
    both = folds(spark, GOLDEN).unionByName(folds(spark, [(100, 10, 10, 10), (50, 5, 0, 0), (30, 0, 9, 0)]).withColumn("config", F.lit("d")))
    got = {r["config"]: r for r in inference.permutation_law(both, ["config"]).collect()}
    assert got["c"]["exact_p"] == pytest.approx(0.68949, abs=1e-5) and got["c"]["caught"] == 27
    assert got["c"]["null_caught"] == pytest.approx(sum(n_flag * k / n for n, k, n_flag, _ in GOLDEN))
    assert got["d"]["exact_p"] == pytest.approx(1 / math.comb(100, 10), rel=1e-9)


def test_laws_of_large_folds(spark):
    """Laws are as long as the square root of a fold's lots; before, exact_p asked for binomials of 67,500 lots and the tables for all pairs of catches."""
    for n, k, m in [(176, 6, 151), (178, 4, 169), (90, 30, 45), (50, 0, 9), (50, 50, 9), (50, 7, 0), (50, 7, 50), (1, 1, 1), (400, 80, 200)]:
        first, law = inference.hypergeometric(n, k, m)
        want = [math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(first, first + len(law))]
        assert law == pytest.approx(want, rel=1e-11) and sum(want) == pytest.approx(1, abs=1e-14)
    first, law = inference.hypergeometric(4_000_000, 800_000, 2_000_000)
    assert len(law) < 40_000 and law.sum() == pytest.approx(1) and float(law @ (first + np.arange(len(law)))) == pytest.approx(400_000, rel=1e-12)
    large = folds(spark, [(67_500, 13_500, 33_750, 6_750 + d) for d in (0, 20, 40, 10)])
    law, drawn = inference.permutation_law(large, ["config"]).first(), inference.permutation_test(large, ["config"], draws=500).first()
    # 70 catches above the mean, with a spread of sqrt(4 * 67500 * 0.2 * 0.8 * 0.25); half a catch for whole numbers
    normal = 0.5 * math.erfc(69.5 / math.sqrt(4 * 67_500**2 / 67_499 * 0.2 * 0.8 * 0.25 * 2))
    assert law["exact_p"] == pytest.approx(normal, rel=1e-3) and drawn["exact_p"] == law["exact_p"] and (law["caught"], law["null_caught"]) == (27_070, 27_000)


def test_cells_must_add_up(spark):
    with pytest.raises(Exception, match="do not add up"):
        inference.cells(folds(spark, [(100, 10, 3, 5)])).collect()
    with pytest.raises(ValueError, match="no such policy"):
        inference.bootstrap(pd.DataFrame([{"fold": 1, "n_eval": 10, "tp": 1, "fp": 1, "fn": 1, "tn": 7}]), "other", 1, 2, None, 10, 1, 0.95)


def test_power(spark):
    row = spark.range(1).select(
        power.min_detectable_auc(F.lit(33), F.lit(673)).alias("auc"), power.min_detectable_auc(F.lit(0), F.lit(5)).alias("none"),
        F.ceil(power.required_positives(0.65, F.lit(33 / 706))).alias("p65"), F.ceil(power.required_positives(0.55, F.lit(33 / 706))).alias("p55"),
        power.required_lift(F.lit(0.05), F.lit(30.0)).alias("l1"), power.required_lift(F.lit(0.01), F.lit(30.0)).alias("l2"), power.required_lift(F.lit(0.0), F.lit(30.0)).alias("l3"),
    ).first()
    assert round(row["auc"], 3) == 0.644 and row["none"] is None and (row["p65"], row["p55"]) == (31, 275)
    assert (row["l1"], row["l2"], row["l3"]) == (1.0, pytest.approx(1 / 0.3), math.inf)


def test_regimes(spark):
    df = spark.createDataFrame([(235, 6), (1000, 200), (2000, 2), (0, 0), (50, 0), (50, 50)], "n long, n_fail long")
    got = {(r["n"], r["n_fail"]): r for r in drift.prevalence_regime(df, 1 / 30).collect()}
    want = {(235, 6): "undecided", (1000, 200): "inspect", (2000, 2): "no_inspect", (0, 0): "undecided", (50, 50): "inspect"}
    assert {k: got[k]["regime"] for k in want} == want and got[(50, 0)]["ci_lo"] == 0 and got[(50, 50)]["ci_hi"] == 1


def test_psi(spark):
    base = spark.range(2000).select(F.randn(1).alias("f000"), F.randn(2).alias("f001"), F.randn(3).alias("f002"), F.lit(None).cast("double").alias("f003"), F.lit(1.0).alias("f004"))
    now = base.select("f000", (F.col("f001") + 2.5).alias("f001"), F.when(F.rand(4) < 0.5, F.col("f002")).alias("f002"), "f003", "f004")
    psi = {r["feature"]: r["psi"] for r in drift.feature_psi(base, now).collect()}
    assert psi["f000"] == 0 and psi["f001"] > 0.25 and psi["f002"] > 0.25 and psi["f003"] is None and psi["f004"] is None
    trigger = drift.retraining_trigger(base.withColumn("fail", F.lit(1)), now.withColumn("fail", F.lit(0)), 1 / 30).first()
    assert trigger["action_flipped"] and trigger["input_drifted"] and trigger["retrain"] and trigger["psi_usable"] == 3


def test_stream_of_weeks(spark, tmp_path):
    days = spark.range(40).selectExpr("timestampadd(DAY, cast(id as int), timestamp'2024-01-01 00:00:00') as ts", "cast(id % 5 = 0 as int) as fail")
    days.coalesce(1).write.parquet(str(tmp_path / "in"))
    rates = monitor.weekly_rates(monitor.read_lots(spark, str(tmp_path / "in")), "1 days")
    monitor.run_available(rates, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {str(r["week"])[:10]: (r["n"], r["n_fail"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {str(r["week"])[:10]: (r["n"], r["k"]) for r in days.groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n"), F.sum("fail").alias("k")).collect()}
    assert got and all(want[w] == v for w, v in got.items())


def test_standing_of_lines_with_late_lots(spark, tmp_path):
    """Three runs of one stream: a late week changes the average, standing action and flips behind it."""
    def week(k, n, failed, line="a"):
        return [(line, dt.datetime(2024, 1, 1) + dt.timedelta(weeks=k, minutes=i), int(i < failed)) for i in range(n)]

    arrivals = [
        [*week(0, 400, 100), *week(2, 400, 1), *week(3, 9, 1), *week(5, 300, 90), *week(0, 50, 2, "b"), (None, dt.datetime(2024, 1, 1), 1), ("a", None, 1), ("b", dt.datetime(2024, 1, 2), None)],
        [*week(1, 500, 0), *week(4, 7, 0)],  # late
        [*week(0, 4000, 0), *week(6, 1, 1, "b"), *week(7, 0, 0)],  # the first flip goes
    ]
    told = str(tmp_path / "told")
    schema = "line string, ts timestamp, fail int"
    for k, rows in enumerate(arrivals):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        monitor.run_events(monitor.standing_events(monitor.read_lots(spark, str(tmp_path / "in"), schema), 1 / 30), told, str(tmp_path / "check"))
        events = spark.read.schema(monitor.EVENT).parquet(told)
        got = sorted(map(tuple, monitor.current_events(events).collect()))
        want = sorted(map(tuple, monitor.batch_events(spark.createDataFrame([r for part in arrivals[: k + 1] for r in part], schema), 1 / 30).collect()))
        assert len(got) == len(want) and all(a == pytest.approx(b) if isinstance(a, float) else a == b for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
    assert events.where("line = 'a' AND week = '2024-01-15' AND flipped").count() == 1  # told at first, then taken back
    assert [(str(r["week"])[:10], r["standing"]) for r in monitor.current_events(events).where("flipped").collect()] == [("2024-02-05", "inspect")]
    assert spark.conf.get(monitor.STORE) != monitor.ROCKSDB

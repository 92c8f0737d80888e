from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldgate.operators import backtest, history, prep, profile, windows
from yieldgate.plans.shared import running_sums, with_row_id
from yieldgate.sources import lots as src

START = dt.datetime(2024, 1, 1)


def lots(spark, n, fail=lambda k: 0, x=float):
    rows = [(k, START + dt.timedelta(hours=k), fail(k), x(k)) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, ts timestamp, fail int, f000 double")


def test_split_parts_all():
    parts = backtest.split_bounds(1567)
    assert parts == {"train": (0, 940), "val": (940, 1253), "test": (1253, 1567)}


def test_folds_follow_each_other():
    folds = backtest.fold_bounds(1567)
    assert [(b["train"], b["cal"] - b["train"], b["eval"] - b["cal"]) for b in folds] == [(626, 235, 176), (802, 235, 176), (978, 235, 176), (1154, 235, 178)]
    with pytest.raises(ValueError, match="too few"):
        backtest.fold_bounds(200)


def test_windows_without_failures(spark):
    df = lots(spark, 200, lambda k: int(k < 60 and k % 7 == 0))
    bounds = backtest.fold_bounds(200, folds=2)
    scored = backtest.scored_folds(df, {"x": F.col("f000") / 200}, bounds)
    rows = backtest.run_folds(scored, 2000, 60000, {"free": None, "capped": 0.2}).collect()
    assert len(rows) == 2 * 3 * 2 * 2
    assert {r["n_fail_eval"] for r in rows} == {0} and sum(r["n_eval"] for r in rows if (r["regime"], r["policy"], r["model"]) == ("free", "quantile", "x")) == 90
    assert all(r["cost_model"] is not None and r["roc_auc"] is None for r in rows)
    assert all(r["flag_rate"] <= 0.2 for r in rows if r["regime"] == "capped")


def test_the_future_does_not_matter(spark):
    df = lots(spark, 30)
    later = df.withColumn("f000", F.when(F.col("row_id") >= 20, 999.0).otherwise(F.col("f000")))
    a, b = ({r["row_id"]: r["deviation"] for r in history.history_deviation(x).collect()} for x in (df, later))
    assert all(a[k] == b[k] for k in range(20)) and a[0] is None and a[20] == 10.5


def test_history_in_strides(spark):
    df = lots(spark, 95, x=lambda k: None if k % 9 == 4 else float(k * k % 17))
    whole, cut = (sorted(map(tuple, history.history_deviation(df, 20, stride=s).collect())) for s in (1 << 20, 25))
    assert str(whole) == str(cut) and len(cut) == 95


def test_augmented_columns(spark):
    df = lots(spark, 30).withColumn("f003", F.lit(1.0))
    out = history.augmented(df)
    assert src.feature_cols(out) == ["f000", "f003", "f900", "f901", "f902", "f903"]
    row = out.where("row_id = 20").first()
    assert row["f900"] == 10.5 and row["f902"] == 0 and row["f903"] is None


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id * 7 % 1000 as v")
    out = running_sums(df, [F.desc("v")], {"s": F.col("v")}, ["g"]).collect()
    for g in range(3):
        total = 0
        for r in sorted((r for r in out if r["g"] == g), key=lambda r: -r["v"]):
            total += r["v"]
            assert r["s"] == total
    ids = with_row_id(df, "v").collect()
    assert [r["row_id"] for r in sorted(ids, key=lambda r: r["v"])] == list(range(1000))


def test_profiles(spark):
    df = lots(spark, 100, lambda k: int(k % 10 == 0), lambda k: None if k < 60 else float(k)).withColumn("f001", F.lit(3.0)).withColumn("f002", F.lit(None).cast("double"))
    s = profile.sensor_profile(df).first()
    assert (s["n_features"], s["constant_cols"], s["mostly_missing_cols"], s["missing_cells"], s["span_days"]) == (3, 2, 2, 160, 4)
    p = profile.lots_profile(df).first()
    assert (p["n_lots"], p["n_fail"], p["fail_rate"], p["imbalance"], p["span_days"]) == (100, 10, 0.1, 9.0, 4)


def test_half_months(spark):
    days = ["2024-01-14", "2024-01-15", "2024-01-30", "2024-01-31", "2024-04-01"]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(d), 1) for d in days], "ts timestamp, fail int")
    got = {str(r["half"])[:10]: r["n_lots"] for r in profile.semi_monthly(df).collect()}
    assert got == {"2023-12-31": 1, "2024-01-15": 2, "2024-01-31": 1, "2024-02-15": 0, "2024-02-29": 0, "2024-03-15": 0, "2024-03-31": 1}


def test_features_are_named_by_number(spark):
    df = spark.createDataFrame([(1,) * 5], "fail int, f000 int, f1234 int, f12 int, feature int")
    assert src.feature_cols(df) == ["f000", "f1234"]


def test_correlated_columns(spark):
    df = spark.range(200).select(F.col("id").alias("row_id"), F.rand(1).alias("f000"), F.rand(2).alias("f002")).withColumn("f001", F.col("f000") * 2 + F.rand(3) / 1000)
    df = df.select("row_id", "f000", "f001", "f002")
    assert prep.correlated_cols(df, ["f000", "f001", "f002"], 0.95) == ["f001"]
    assert prep.correlated_cols(df, ["f000", "f001", "f002"], None) == []


def test_fit_looks_at_training_only(spark):
    df = lots(spark, 40, x=lambda k: None if k == 3 else float(k)).withColumn("f001", F.lit(1.0)).withColumn("f002", F.when(F.col("row_id") < 30, F.lit(None)).otherwise(F.col("f000")))
    train = df.where("row_id < 30")
    poisoned = df.withColumn("f000", F.when(F.col("row_id") >= 30, 1e9).otherwise(F.col("f000"))).where("row_id < 30")
    a, b = prep.fit(train), prep.fit(poisoned)
    assert a == b and a.cols == ["f000"] and a.dropped == {"constant": 2, "missing": 0, "correlated": 0}
    whole = {r["row_id"]: r["f000"] for r in a.transform(df).collect()}
    assert a.transform(df.where("row_id = 3")).first()["f000"] == whole[3] and a.describe() == "constant -2, missing -0, correlated -0"


def test_raw_files(spark, tmp_path):
    (tmp_path / "s").write_text("1.5 NaN\n2 3\nNaN 4\n")
    (tmp_path / "l").write_text('-1 "02/01/2008 00:00:00"\n1 "01/01/2008 00:00:00"\n-1 "02/01/2008 00:00:00"\n')
    df = src.read_raw_lots(spark, str(tmp_path / "s"), str(tmp_path / "l"), 2).orderBy("row_id").collect()
    assert [(r["fail"], r["f000"], r["f001"]) for r in df] == [(1, 2.0, 3.0), (0, 1.5, None), (0, None, 4.0)]


def test_documents_hold_no_nan():
    assert src.document({1: float("nan"), "a": [float("inf"), 2.0]}) == '{\n  "1": null,\n  "a": [\n    null,\n    2.0\n  ]\n}'
    assert "<" not in src.page_payload("</script>")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("val", 0, 1, 0.123456789012), ("val", 1, 0, float("nan"))], "window string, row_id long, y int, p double")
    src.write_scored(df.where("row_id = 0"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first()["p"] == 0.12345679
    src.write_json(df, str(tmp_path / "j"))
    assert src.read_json(spark, str(tmp_path / "j")).where("row_id = 1").first()["p"] is None
    src.write_csv(df, str(tmp_path / "c"))
    assert src.read_csv(spark, str(tmp_path / "c"), df.schema.simpleString()[7:-1].replace(":", " ")).count() == 2


def test_wide_history_is_the_long_one(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 40)), 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7], x[:, 8] = 0.1, np.nan
    cols = [f"f{k:03d}" for k in range(40)]
    rows = [(k, "x", int(k % 9 == 0), *(None if v != v else float(v) for v in r)) for k, r in enumerate(x)]
    lots = spark.createDataFrame(rows, f"row_id long, lot string, fail int, {', '.join(f'{c} double' for c in cols)}").repartition(3)
    wide, names = history.augmented_rows(lots, stride=64)
    got = {(r["row_id"], c): v for r in wide.collect() for c, v in zip(names, r["x"], strict=True)}
    want = history.history_deviation(lots).collect()
    assert len(got) == 300 * 120 and len(want) == 300 * 40
    same = lambda a, b: a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-9
    for r in want:
        k = int(r["feature"][1:])
        assert same(got[r["row_id"], r["feature"]], r["x"]) and same(got[r["row_id"], f"f{900 + 2 * k}"], r["deviation"])
        if k != 7:  # a constant sensor has no spread, whatever the rounding of its mean
            assert same(got[r["row_id"], f"f{901 + 2 * k}"], r["standardised"])
        else:
            assert got[r["row_id"], f"f{901 + 2 * k}"] is None
    assert len(history.augmented(lots).columns) == 3 + 120
    with pytest.raises(ValueError):
        history.augmented_rows(lots, rows=70, stride=64)


def test_plans_do_not_grow_with_sensors(spark, tmp_path):
    sizes = []
    for n in (5, 590):
        path = str(tmp_path / str(n).zfill(3))
        spark.range(10).select(F.col("id").alias("row_id"), F.lit(0).alias("y"), F.array_repeat(F.rand(), n).alias("x")).write.parquet(path)
        members = windows.dealt(spark.read.parquet(path), [("a", "train", 0, 5), ("b", "train", 0, 10)])
        plan = members.select("key", F.posexplode("x"))._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan.split()))
        assert members.count() == 15
    assert sizes[0] == sizes[1]

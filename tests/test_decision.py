from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from yieldgate.operators import decision, envelope, metrics


def table(spark, y, p):
    return spark.createDataFrame([("m", k, int(a), float(b)) for k, (a, b) in enumerate(zip(y, p, strict=True))], "model string, row_id long, y int, p double")


def steps(spark, y, p):
    return metrics.ladder(table(spark, y, p))


@pytest.fixture(scope="module")
def noisy():
    rng = random.Random(7)
    y = [int(rng.random() < 0.1) for _ in range(300)]
    return y, [round(min(0.999, 0.2 * a + rng.random() * 0.8), 2) for a in y]


def brute_curve(y, p, inspect, escape):
    out = {}
    for t in sorted({0.0, *p, metrics.ABOVE}):
        flagged = sum(x >= t for x in p)
        missed = sum(a and x < t for a, x in zip(y, p, strict=True))
        out[t] = (flagged, missed, flagged * inspect + missed * escape)
    return out


def test_curve(spark, noisy):
    want = brute_curve(*noisy, 10, 300)
    got = metrics.cost_curve(steps(spark, *noisy), 10, 300).collect()
    assert {r["threshold"]: (r["n_flagged"], r["missed"], r["total_cost"]) for r in got} == want


def test_ends_of_the_curve(spark):
    y, p = [0, 1, 0, 1, 0, 0, 1, 0, 0, 0], [0.1, 0.9, 0.2, 0.8, 0.3, 0.1, 0.4, 0.2, 0.3, 0.1]
    rows = {r["threshold"]: r for r in metrics.cost_curve(steps(spark, y, p), 10, 300).collect()}
    assert rows[metrics.ABOVE]["total_cost"] == 3 * 300 and rows[0.0]["n_flagged"] == 10


def test_threshold_within_the_cap(spark, noisy):
    curve = brute_curve(*noisy, 10, 300)
    for cap in (None, 0.15):
        fits = {t: c for t, (f, _, c) in curve.items() if cap is None or f / 300 <= cap}
        best = min(fits, key=lambda t: (fits[t], t))
        got = decision.optimal_threshold(steps(spark, *noisy), 10, 300, cap).first()
        assert (got["threshold"], got["total_cost"]) == (best, fits[best])


def test_ties_at_the_boundary_stay_out(spark):
    cuts = {r["rate"]: r for r in decision.rate_cuts(steps(spark, [1, 0] * 5, [0.2] * 10), [0.0, 0.2, 1.0]).collect()}
    assert cuts[0.2]["n_flagged"] == 0 and cuts[0.0]["above"] == math.inf and cuts[1.0]["n_flagged"] == 10


def test_rates_against_sorting(spark, noisy):
    y, p = noisy
    ordered = sorted(p, reverse=True)
    for r in decision.rate_cuts(steps(spark, y, p), decision.grid_rates(0.37)).collect():
        count = math.floor(300 * r["rate"] + 1e-10)
        kth = math.inf if r["rate"] <= 0 else ordered[count]
        assert r["n_flagged"] == sum(x > kth for x in p)


def test_no_failures_no_inspection_or_all(spark):
    ladder = steps(spark, [0] * 10, [k / 10 for k in range(10)])
    assert decision.optimal_flag_rate(ladder, 1, 30).first()["target_flag_rate"] == 0
    assert decision.robust_flag_rate(ladder, 1, 30).first()["target_flag_rate"] == 1
    assert decision.robust_flag_rate(ladder, 1, 30, 0.2).first()["target_flag_rate"] == pytest.approx(0.2)


def test_robust_inflates(spark):
    rng = random.Random(1)
    y = [1] * 6 + [0] * 229
    row = decision.robust_flag_rate(steps(spark, y, [rng.random() for _ in y]), 2000, 60000).first()
    assert row["escape_inflation"] == pytest.approx(1.9492615657078647, abs=1e-12)


def test_threshold_comes_from_the_first_window(spark):
    select, test = steps(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), steps(spark, [0, 1, 0, 1], [0.9, 0.1, 0.2, 0.85])
    rows = {r["policy"]: r for r in decision.policy_table(select, test, 1, 3).collect()}
    assert rows["model"]["threshold"] == 0.8 and rows["model"]["n_flagged"] == 2 and rows["model"]["total_cost"] == 2 + 3


def test_quota_is_whole(spark):
    y = [1] * 7 + [0] * 0
    rows = {r["policy"]: r for r in decision.policy_table(steps(spark, y, [0.5] * 7), steps(spark, y, [0.5] * 7), 1, 30, 0.2).collect()}
    assert rows["random_at_capacity"]["n_flagged"] == 1 and rows["random_at_capacity"]["total_cost"] == pytest.approx(181)
    assert not rows["inspect_all"]["feasible"]


def test_sensitivity_needs_no_order_of_ratios(spark, noisy):
    ladder = steps(spark, *noisy)
    rows = {r["cost_ratio"]: r for r in decision.cost_sensitivity(ladder, ladder, (1, 30)).collect()}
    assert rows[30]["cost_model"] == min(c for _, _, c in brute_curve(*noisy, 1, 30).values())
    assert rows[1]["cost_none"] == sum(noisy[0])


def test_metrics(spark):
    y, p = [0, 1, 1, 0, 1], [0.1, 0.4, 0.4, 0.4, 0.9]
    scored = table(spark, y, p)
    m = metrics.score_metrics(metrics.ladder(scored), scored).first()
    wins = sum((a > b) + (a == b) / 2 for a, s in zip(p, y, strict=True) if s for b, t in zip(p, y, strict=True) if not t)
    assert m["roc_auc"] == pytest.approx(wins / 6) and m["pr_auc"] == pytest.approx((1 * 1 + 2 * 3 / 4) / 3)
    top = {r["share"]: r for r in metrics.top_shares(scored, (0.05, 0.4)).collect()}
    assert top[0.05]["quota"] == 1 and top[0.4]["caught"] == 2
    at = metrics.at_thresholds(scored, (2.0,)).first()
    assert (at["precision"], at["recall"], at["f1"]) == (0, 0, 0)


def test_one_class(spark):
    scored = table(spark, [0, 0], [0.1, 0.2])
    m = metrics.score_metrics(metrics.ladder(scored), scored).first()
    assert m["roc_auc"] is None and m["pr_auc"] is None and m["n_fail"] == 0
    assert metrics.top_shares(scored).first()["lift"] is None


def test_keys_do_not_mix(spark, noisy):
    one = table(spark, *noisy)
    both = one.unionByName(one.withColumns({"model": F.lit("n"), "p": 1 - F.col("p")}))
    got = {r["model"]: r["roc_auc"] for r in metrics.score_metrics(metrics.ladder(both), both).collect()}
    assert got["m"] == pytest.approx(1 - got["n"])


def test_envelope_answers_every_ratio_and_cap(spark):
    rng = random.Random(11)
    rows = [(m, round(rng.random() ** 2, 2), int(rng.random() < 0.15)) for m in ("a", "b") for _ in range(400)] + [("none", 0.3, 0)] * 5
    steps = metrics.ladder(spark.createDataFrame(rows, "model string, p double, y int").repartition(4))
    pairs = [(1.0, r) for r in (0.0, 0.5, 1.0, 2.0, 3.5, 7.0, 20.0, 1000.0)] + [(2000.0, 60000.0), (3.0, 0.1)]
    points = [r.asDict() for r in steps.collect()]
    for cap in (None, 0.3):
        corners = envelope.cost_envelope(steps, cap)
        table = [r.asDict() for r in corners.collect()]
        assert all(r["to_ratio"] is None or r["from_ratio"] < r["to_ratio"] for r in table)
        ratios = [(float(r["less_k"]), float(r["less_n"])) for r in table if r["less_n"] is not None]  # at the corners themselves
        got = {(r["model"], r["inspect"], r["escape"]): (r["threshold"], r["total_cost"]) for r in envelope.what_if(corners, [*pairs, *ratios]).collect()}
        assert len(got) == 3 * len({*pairs, *ratios})
        for (model, a, b), found in got.items():
            mine = [(x["cum_n"] * a + (x["total_k"] - x["cum_k"]) * b, x["p"]) for x in points if x["model"] == model and (cap is None or x["cum_n"] <= cap * x["total_n"])]
            cost, threshold = min(mine)
            assert found == (threshold, pytest.approx(cost))


def test_hull_of_hulls():
    rng = random.Random(3)
    points = sorted({(rng.random(), rng.randint(0, 60), rng.randint(0, 25)) for _ in range(300)})
    whole = envelope.hull(points)
    assert envelope.hull([*envelope.hull(points[:100]), *envelope.hull(points[100:])]) == whole == envelope.hull(whole)
    slopes = [(b[2] - a[2]) / (b[1] - a[1]) for a, b in zip(whole, whole[1:])]
    assert slopes == sorted(slopes, reverse=True) and len(set(slopes)) == len(slopes)


def test_break_even(spark):
    rows = envelope.break_even(spark.createDataFrame([(100, 5), (10, 0)], "n long, n_fail long"), [10.0, 30.0]).collect()
    assert [(r["n"], r["cost_ratio"], r["pays"], r["required_lift"]) for r in rows] == [(100, 10.0, False, 2.0), (100, 30.0, True, 1.0), (10, 10.0, False, float("inf")), (10, 30.0, False, float("inf"))]

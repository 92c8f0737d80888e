"""Chronological splits and walk-forward backtests.

Positions (row_id) are time. A fold trains on all lots before a point, calibrates on the window behind it, and is judged
on the next window only. Scores live in one long table (role, model, fold, row_id, y, p); everything after it is
relational and runs for all models and folds at once.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldgate.plans.shared import written

from .decision import inspects, optimal_flag_rate, optimal_threshold, quota, rate_cuts, robust_flag_rate
from .metrics import ladder, score_metrics, top_shares
from .profile import ratio

KEYS = ["model", "fold"]
POLICIES = ("threshold", "quantile", "robust")
LEAST_FOLD = 30


def split_bounds(n: int, train: float = 0.6, val: float = 0.2) -> dict[str, tuple[int, int]]:
    """Positions of train, val and test; the rest is test."""
    a = int(n * train)
    b = a + int(n * val)
    return {"train": (0, a), "val": (a, b), "test": (b, n)}


def fold_bounds(n: int, folds: int = 4, min_train: float = 0.4, cal: float = 0.15) -> list[dict[str, int]]:
    """Ends of the train, calibration and evaluation windows of each fold; the last one takes the remainder."""
    n_cal, start = max(int(n * cal), 1), int(n * min_train)
    room = n - start - n_cal
    if room < folds * LEAST_FOLD:
        raise ValueError(f"{n} lots are too few for {folds} folds: {room} are left to evaluate")
    step = room // folds
    ends = [start + k * step for k in range(folds)]
    return [{"fold": k + 1, "train": e, "cal": e + n_cal, "eval": n if k == folds - 1 else e + n_cal + step} for k, e in enumerate(ends)]


def with_ranges(lots: DataFrame, ranges: list[tuple[tuple, int, int]], names: list[str]) -> DataFrame:
    """Each lot once for every range [low, high) of positions that holds it, with the range's labels."""
    each = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(names, labels, strict=True)), F.lit(a).alias("_a"), F.lit(b).alias("_b")) for labels, a, b in ranges))
    held = lots.withColumn("_r", F.explode(F.filter(each, lambda r: (F.col("row_id") >= r["_a"]) & (F.col("row_id") < r["_b"]))))
    return held.select(*lots.columns, *(F.col(f"_r.{c}").alias(c) for c in names))


def time_split(lots: DataFrame, n: int | None = None) -> DataFrame:
    """lots with their part: train, val or test."""
    n = lots.count() if n is None else n
    return with_ranges(lots, [((part,), a, b) for part, (a, b) in split_bounds(n).items()], ["part"])


def until(lots: DataFrame, end: datetime) -> DataFrame:
    """Lots up to a time, all lots of that time too (unlike a range of positions)."""
    return lots.where(F.col("ts") <= F.lit(end))


def between(lots: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Lots of a span of time, both ends included."""
    return lots.where(F.col("ts").between(F.lit(start), F.lit(end)))


def split_summary(lots: DataFrame) -> DataFrame:
    """Size, failures and times of each part."""
    a = time_split(lots).groupBy("part").agg(F.count("*").alias("n"), F.sum("fail").alias("n_fail"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return a.select("part", "n", "n_fail", ratio(F.col("n_fail"), F.col("n")).alias("fail_rate"), "first_ts", "last_ts")


def fold_rows(lots: DataFrame, bounds: list[dict[str, int]]) -> DataFrame:
    """lots with fold and role: train, cal or eval."""
    ranges = [((b["fold"], role), low, high) for b in bounds for role, low, high in (("train", 0, b["train"]), ("cal", b["train"], b["cal"]), ("eval", b["cal"], b["eval"]))]
    return with_ranges(lots, ranges, ["fold", "role"])


def fold_windows(lots: DataFrame, bounds: list[dict[str, int]] | None = None) -> DataFrame:
    """Size, failures and times of each window."""
    rows = fold_rows(lots, bounds or fold_bounds(lots.count()))
    return rows.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("fail").alias("n_fail"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def scored_folds(lots: DataFrame, models: dict[str, Column], bounds: list[dict[str, int]] | None = None) -> DataFrame:
    """The long table for score columns that need no training, and for `majority`, a fold's failure rate in training."""
    rows = fold_rows(lots, bounds or fold_bounds(lots.count()))
    rates = rows.where("role = 'train'").groupBy("fold").agg(F.avg("fail").alias("rate"))
    rows = rows.where("role <> 'train'").join(F.broadcast(rates), "fold")
    each = F.array(*(F.struct(F.lit(name).alias("model"), p.cast("double").alias("p")) for name, p in {"majority": F.col("rate"), **models}.items()))
    return rows.withColumn("s", F.explode(each)).select("role", "s.model", "fold", "row_id", F.col("fail").alias("y"), "s.p")


def run_folds(scored: DataFrame, inspect: float, escape: float, caps: dict[str, float | None], policies: tuple[str, ...] = POLICIES, stored: bool = False) -> DataFrame:
    """A row for each regime, policy, model and fold: what was chosen in calibration and what it cost in evaluation; stored: scored is a table.

    Thresholds, rates and baselines come from the calibration window alone; under a cap the flags of the evaluation
    window are held to its quota.
    """
    scored = scored if stored else written(scored, "scored")
    cal = written(ladder(scored.where("role = 'cal'"), KEYS), "cal")
    held = scored.where("role = 'eval'")
    late = written(ladder(held, KEYS), "eval")
    known = cal.groupBy(*KEYS).agg(F.first("total_n").alias("n_cal"), F.first("total_k").alias("n_fail_cal"))
    quality = score_metrics(late, held, KEYS).select(*KEYS, "pr_auc", "roc_auc")
    top = top_shares(held, (0.2,), KEYS).select(*KEYS, F.col("recall").alias("recall_at_20"), F.col("lift").alias("lift_at_20"))
    none = F.lit(None).cast("double")
    wanted, limits = [], []
    for regime, cap in caps.items():
        limits.append(rate_cuts(late, [1.0 if cap is None else cap], KEYS).select(F.lit(regime).alias("regime"), *KEYS, F.col("above").alias("limit")))
        for policy in policies:
            if policy == "threshold":
                best = optimal_threshold(cal, inspect, escape, cap, KEYS).select(*KEYS, "threshold", none.alias("target_flag_rate"), none.alias("escape_inflation"))
            else:
                best = optimal_flag_rate(cal, inspect, escape, cap, KEYS) if policy == "quantile" else robust_flag_rate(cal, inspect, escape, cap, KEYS)
                inflation = F.col("escape_inflation") if policy == "robust" else none
                best = best.select(*KEYS, none.alias("threshold"), "target_flag_rate", inflation.alias("escape_inflation"))
            wanted.append(best.select(F.lit(regime).alias("regime"), F.lit(policy).alias("policy"), "*"))
    chosen = written(reduce(DataFrame.unionByName, wanted), "chosen")  # a row a regime, policy, model and fold
    out = _judge(late, _cut_at(late, chosen).join(reduce(DataFrame.unionByName, limits), ["regime", *KEYS]))
    rows = out.join(known, KEYS).join(quality, KEYS).join(top, KEYS)
    n, k, q = F.col("n_eval"), F.col("n_fail_eval"), F.col("n_eval")
    capped = F.lit(None).cast("double")
    for regime, cap in caps.items():
        if cap is not None:
            q = F.when(F.col("regime") == regime, quota(n, cap)).otherwise(q)
            capped = F.when(F.col("regime") == regime, F.lit(cap)).otherwise(capped)
    takes = F.lit(False)
    for regime, cap in caps.items():
        takes = takes | ((F.col("regime") == regime) & inspects(F.col("n_fail_cal"), F.col("n_cal"), inspect, escape, cap))
    nothing, alternative = k * escape, q * inspect + (n - q) * escape * ratio(k, n)
    baseline = F.when(takes, alternative).otherwise(nothing.cast("double"))
    model = F.col("n_flagged") * inspect + F.col("missed") * escape
    action = F.when(~takes, "inspect_none").when(q == n, "inspect_all").otherwise("random_at_capacity")
    return rows.select(
        "regime", "policy", *KEYS, "n_cal", "n_fail_cal", "n_eval", "n_fail_eval", "threshold", "target_flag_rate", "escape_inflation", "n_flagged", "caught", "missed",
        ratio(F.col("n_flagged"), n).alias("flag_rate"), ratio(F.col("caught"), k).alias("catch_rate"), "pr_auc", "roc_auc", "recall_at_20", "lift_at_20",
        model.alias("total_model"), ratio(model, n).alias("cost_model"), ratio(nothing, n).alias("cost_none"), F.lit(float(inspect)).alias("cost_all"),
        ratio(baseline, n).alias("cost_baseline"), action.alias("baseline_action"), ratio(F.least(nothing.cast("double"), alternative), n).alias("cost_oracle_baseline"),
        ratio(baseline - model, baseline).alias("saving"), q.alias("quota"), capped.alias("capacity"),
    )


def _cut_at(steps: DataFrame, best: DataFrame) -> DataFrame:
    """best (keys, target_flag_rate) with the score above which its rate flags in steps; NULL: all, infinite: none. A row without a rate gets NULL."""
    at = steps.join(F.broadcast(best), KEYS)
    count = quota(F.col("total_n"), F.col("target_flag_rate"))
    here = (F.col("cum_n") - F.col("n") <= count) & (count < F.col("cum_n"))
    rest = [c for c in best.columns if c not in KEYS]
    found = at.groupBy(*KEYS, *rest).agg(F.max(F.when(here, F.col("p"))).alias("kth"))
    rate = F.col("target_flag_rate")
    return found.withColumn("above", F.when(rate <= 0, F.lit(float("inf"))).when(rate < 1, F.col("kth")))


def _judge(late: DataFrame, chosen: DataFrame) -> DataFrame:
    """What each chosen row (regime, policy, keys, threshold, above, limit) flags and catches, all in one pass over the ladder."""
    at = late.join(F.broadcast(chosen), KEYS)
    over = lambda c: F.col(c).isNull() | (F.col("p") > F.col(c))
    flag = (F.col("threshold").isNull() | (F.col("p") >= F.col("threshold"))) & over("above") & over("limit")
    total = lambda c: F.coalesce(F.sum(F.when(flag, F.col(c))), F.lit(0)).cast("long")
    cols = ["regime", "policy", "threshold", "target_flag_rate", "escape_inflation"]
    a = at.groupBy(*KEYS, *cols).agg(F.first("total_n").alias("n_eval"), F.first("total_k").alias("n_fail_eval"), total("n").alias("n_flagged"), total("k").alias("caught"))
    return a.withColumn("missed", F.col("n_fail_eval") - F.col("caught"))


def reference_costs(folds: DataFrame, inspect: float, escape: float) -> DataFrame:
    """regime, action, cost, feasible, best: policies that need no model, over all evaluation windows."""
    one = folds.groupBy("regime", "fold").agg(F.first("n_eval").alias("n"), F.first("n_fail_eval").alias("k"), F.first("quota").alias("q"), F.first("capacity").alias("capacity"))
    rand = F.col("q") * inspect + (F.col("n") - F.col("q")) * escape * ratio(F.col("k"), F.col("n"))
    a = one.groupBy("regime", "capacity").agg(ratio(F.sum(F.col("k") * escape), F.sum("n")).alias("none"), ratio(F.sum(rand), F.sum("n")).alias("random"))
    capped = F.col("capacity").isNotNull()
    row = lambda k, name, cost, ok: F.struct(F.lit(k).alias("place"), F.lit(name).alias("action"), cost.alias("cost"), ok.alias("feasible"))
    rows = F.filter(F.array(row(0, "inspect_none", F.col("none"), F.lit(True)), row(1, "inspect_all", F.lit(float(inspect)), ~capped), row(2, "random_at_capacity", F.col("random"), capped)), lambda r: capped | (r["place"] < 2))
    best = F.array_min(F.transform(F.filter(rows, lambda r: r["feasible"]), lambda r: F.struct(r["cost"], r["place"])))
    out = a.select("regime", F.explode(rows).alias("r"), best.alias("b"))
    return out.select("regime", "r.action", "r.cost", "r.feasible", (F.col("r.place") == F.col("b.place")).alias("is_best"))


def by_kind(folds: DataFrame, prefix: str) -> DataFrame:
    """kind (whether the baseline's action begins with prefix), n_rows and the regimes it occurs in, as text."""
    kind = F.col("baseline_action").startswith(prefix)
    regimes = F.array_join(F.array_sort(F.collect_set("regime")), ",")
    return folds.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_rows"), regimes.alias("regimes"))


def winners(folds: DataFrame, inspect: float, escape: float) -> DataFrame:
    """model, policy of every configuration that some regime finds cheaper than all policies without a model."""
    return better_configs(folds, inspect, escape).where("better").select("model", "policy").distinct()


def better_configs(folds: DataFrame, inspect: float, escape: float) -> DataFrame:
    """fold_summary with the reference's action and cost, and `better`: totals are compared, as an average could win by its last bit."""
    best = reference_costs(folds, inspect, escape).where("is_best").select("regime", F.col("action").alias("reference_action"), F.col("cost").alias("reference_cost"))
    rows = fold_summary(folds).join(F.broadcast(best), "regime")
    return rows.withColumn("better", F.round(F.col("total_model") - F.col("reference_cost") * F.col("eval_lots"), 3) < 0)


def fold_summary(folds: DataFrame) -> DataFrame:
    """For each configuration: spread of savings over folds, medians, pooled costs and catches."""
    s = F.col("saving")
    at = lambda c, q: F.percentile(c, F.lit(q))
    pooled = lambda c: ratio(F.sum(F.col(c) * F.col("n_eval")), F.sum("n_eval"))
    return folds.groupBy("regime", "policy", "model").agg(
        F.count("*").alias("n_folds"), at(s, 0.5).alias("saving_median"), at(s, 0.25).alias("saving_q25"), at(s, 0.75).alias("saving_q75"),
        F.min(s).alias("saving_min"), F.max(s).alias("saving_max"), F.count_if(s > 0).alias("folds_profitable"),
        at("roc_auc", 0.5).alias("roc_auc_median"), at("pr_auc", 0.5).alias("pr_auc_median"), at("lift_at_20", 0.5).alias("lift_at_20_median"),
        at("catch_rate", 0.5).alias("catch_rate_median"), at("flag_rate", 0.5).alias("flag_rate_median"),
        F.sum("n_eval").alias("eval_lots"), F.sum("n_fail_eval").alias("eval_fails"), F.sum("total_model").alias("total_model"),
        ratio(F.sum("total_model"), F.sum("n_eval")).alias("cost_per_lot"), pooled("cost_baseline").alias("baseline_cost_per_lot"),
        F.sum("caught").alias("total_caught"), F.sum("missed").alias("total_missed"), ratio(F.sum("caught"), F.sum("n_fail_eval")).alias("catch_rate_pooled"),
    )


def dominance(folds: DataFrame, inspect: float, escape: float) -> DataFrame:
    """regime, n_configs, n_better (cheaper than every feasible policy without a model), the cheapest one and its cost."""
    rows, better = better_configs(folds, inspect, escape), F.col("better")
    cheapest = F.min(F.struct("total_model", "model", "policy", "cost_per_lot"))
    a = rows.groupBy("regime", "reference_action", "reference_cost").agg(F.count("*").alias("n_configs"), F.count_if(better).alias("n_better"), cheapest.alias("c"))
    return a.select("regime", "reference_action", "reference_cost", "n_configs", "n_better", F.col("c.model").alias("cheapest_model"), F.col("c.policy").alias("cheapest_policy"), F.col("c.cost_per_lot").alias("cheapest_cost"))

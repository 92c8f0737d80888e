"""The tables of a backtest's report, from its rows (backtest.run_folds): one a configuration and fold, a handful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldgate.functions import power
from yieldgate.functions.beta import rate_interval_udf
from yieldgate.plans.shared import written

from .backtest import better_configs, fold_summary
from .inference import permutation_law
from .profile import ratio

KEYS = ["regime", "policy", "model"]
#: A rate from which a policy is close to inspecting everything.
HIGH_RATE = 0.8
TARGETS = (0.65, 0.60, 0.55)


def _level(names: list[str]) -> Column:
    """What a row of grouping sets stands for: the keys it has, or all."""
    return F.coalesce(F.nullif(F.concat_ws("/", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in names)), F.lit("")), F.lit("all"))


def _windows(folds: DataFrame) -> DataFrame:
    """One row: lots and failures of all evaluation windows, each counted once."""
    one = folds.groupBy("fold").agg(F.first("n_eval").alias("n"), F.first("n_fail_eval").alias("k"))
    return one.agg(F.sum("n").alias("n_lots"), F.sum("k").alias("n_fail"))


def comparison(folds: DataFrame) -> DataFrame:
    """level, keys and results of every configuration, of both kinds of pairs, of regimes and of all, in one pass.

    catch_lo and catch_hi bound the pooled catch rate of a configuration (95 %, Clopper-Pearson); totals over several
    configurations judge the same lots repeatedly and have none.
    """
    s = F.col("saving")
    sets = [[F.col(c) for c in names] for names in (KEYS, KEYS[:2], [KEYS[0], KEYS[2]], KEYS[:1], [])]
    a = folds.groupingSets(sets, *KEYS).agg(
        _level(KEYS).alias("level"), F.count("*").alias("n_rows"), ratio(F.sum("total_model"), F.sum("n_eval")).alias("cost_per_lot"),
        ratio(F.sum(F.col("cost_baseline") * F.col("n_eval")), F.sum("n_eval")).alias("baseline_cost_per_lot"), F.median(s).alias("saving_median"), F.min(s).alias("saving_min"),
        F.median("roc_auc").alias("roc_auc_median"), F.median("lift_at_20").alias("lift_at_20_median"), F.sum("n_flagged").alias("total_flagged"), F.sum("caught").alias("total_caught"),
        F.sum("missed").alias("total_missed"), F.count_if(s > 0).alias("folds_profitable"),
    )
    failed = F.when(F.col("level") == "/".join(KEYS), F.col("total_caught") + F.col("total_missed"))
    bound = a.withColumn("_n", F.coalesce(failed, F.lit(0))).withColumn("_ci", rate_interval_udf("total_caught", "_n"))
    end = lambda side: F.when(failed.isNotNull(), F.col(f"_ci.{side}"))
    return bound.select("level", *KEYS, *(c for c in a.columns if c not in ("level", *KEYS)), end("low").alias("catch_lo"), end("high").alias("catch_hi"))


def headline(folds: DataFrame, inspect: float, escape: float) -> DataFrame:
    """A row a regime and one for all: how many configurations are cheaper than the best policy without a model, and the bar.

    cheapest_share is the share of lots that the cheapest configuration flags: at 1 it is full inspection by another name.
    p_ratio is prevalence times cost ratio; from 1 on inspecting pays on average and required_lift is 1.
    """
    flagged = folds.groupBy(*KEYS).agg(F.sum("n_flagged").alias("flagged"))
    rows = better_configs(folds, inspect, escape).join(F.broadcast(flagged), KEYS)
    cheapest = F.min(F.struct("total_model", "regime", "model", "policy", "cost_per_lot", ratio(F.col("flagged"), F.col("eval_lots")).alias("share")))
    own = lambda c: F.when(F.grouping("regime") == 0, F.max(c))
    a = rows.groupingSets([[F.col("regime")], []], "regime").agg(
        _level(["regime"]).alias("level"), own("reference_action").alias("reference_action"), own("reference_cost").alias("reference_cost"),
        F.count("*").alias("n_configs"), F.count_if("better").alias("n_better"), cheapest.alias("c"),
    )
    known = a.crossJoin(F.broadcast(_windows(folds)))  # one row
    p = ratio(F.col("n_fail"), F.col("n_lots"))
    bar = power.required_lift(p, F.lit(escape / inspect))
    return known.select(
        "level", "regime", "reference_action", "reference_cost", "n_configs", "n_better", F.col("c.regime").alias("cheapest_regime"), F.col("c.model").alias("cheapest_model"),
        F.col("c.policy").alias("cheapest_policy"), F.col("c.cost_per_lot").alias("cheapest_cost"), F.col("c.share").alias("cheapest_share"),
        p.alias("prevalence"), (p * (escape / inspect)).alias("p_ratio"), bar.alias("required_lift"),
    )


def protocol(folds: DataFrame) -> DataFrame:
    """How each configuration behaved: rates it chose, inflation of the escape cost, and baselines that were chosen wrongly."""
    rate, inflation = F.col("target_flag_rate"), F.col("escape_inflation")
    wrong = F.round(F.col("cost_baseline") - F.col("cost_oracle_baseline"), 9) > 0
    return folds.groupBy(*KEYS).agg(
        F.count("*").alias("n_folds"), F.min(rate).alias("rate_lo"), F.median(rate).alias("rate_median"), F.max(rate).alias("rate_hi"), F.count_if(rate >= HIGH_RATE).alias("folds_high_rate"),
        F.min(inflation).alias("inflation_lo"), F.max(inflation).alias("inflation_hi"), F.count_if(F.col("n_flagged") == F.col("quota")).alias("folds_full_quota"),
        F.count_if(F.col("n_fail_eval") == 0).alias("folds_without_failures"), F.count_if(wrong).alias("baselines_wrong"), F.count_if(F.col("baseline_action") == "inspect_none").alias("baselines_none"),
    )


def detectable(folds: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """target_auc with the failures and lots it takes to see it, and how many times today's failures that is."""
    w = _windows(folds)
    n, k = F.col("n_lots"), F.col("n_fail")
    p = ratio(k, n)
    each = F.array(*(F.struct(F.lit(t).alias("target_auc"), power.required_positives(t, p).alias("needed")) for t in targets))
    rows = w.select("*", power.min_detectable_auc(k, n - k).alias("min_auc"), F.explode(each).alias("t"))
    needed = F.ceil("t.needed").cast("long")
    return rows.select("t.target_auc", "n_lots", "n_fail", "min_auc", needed.alias("required_positives"), F.ceil(F.col("t.needed") / p).cast("long").alias("required_lots"), ratio(needed, k).alias("times_current"))


def uncertainty(folds: DataFrame, escape: float) -> DataFrame:
    """For each configuration: what its median saving is in failures, and whether a random quota catches as many."""
    rows = fold_summary(folds).select(*KEYS, "eval_lots", "eval_fails", "saving_median", (F.col("saving_median") * F.col("baseline_cost_per_lot")).alias("gap_per_lot"))
    one = power.cost_resolution(F.col("eval_lots"), escape)
    rows = rows.withColumns({"cost_per_failure": one, "gap_failures": F.col("gap_per_lot") / one})
    return rows.join(F.broadcast(permutation_law(folds, KEYS)), KEYS)


def feasibility(folds: DataFrame, ratios: tuple[float, ...]) -> DataFrame:
    """Lift that each model reached in each window against the lift that a cost ratio asks for; fold 0 is all windows.

    inspection_pays tells the side of break-even (prevalence times ratio of at least 1).
    """
    one = folds.groupBy("model", "fold").agg(F.first("n_eval").alias("n"), F.first("n_fail_eval").alias("k"), F.first("lift_at_20").alias("lift"))
    a = one.groupingSets([[F.col("model"), F.col("fold")], [F.col("model")]], "model", "fold").agg(F.sum("n").alias("n_lots"), F.sum("k").alias("n_fail"), F.median("lift").alias("lift_at_20"))
    r, p = F.col("cost_ratio"), ratio(F.col("n_fail"), F.col("n_lots"))
    rows = a.withColumn("cost_ratio", F.explode(F.array(*(F.lit(float(x)) for x in ratios))))
    bar = power.required_lift(p, r)
    return rows.select("model", F.coalesce("fold", F.lit(0)).alias("fold"), "cost_ratio", "n_lots", "n_fail", p.alias("prevalence"), (1 / r).alias("breakeven"), (p * r >= 1).alias("inspection_pays"), bar.alias("required_lift"), "lift_at_20", (F.col("lift_at_20") > bar).alias("clears"))


def tables(folds: DataFrame, inspect: float, escape: float) -> dict[str, DataFrame]:
    """All of them from one reading of the backtest."""
    folds = written(folds, "folds")
    return {
        "headline": headline(folds, inspect, escape), "protocol": protocol(folds), "comparison": comparison(folds), "detectable": detectable(folds),
        "uncertainty": uncertainty(folds, escape), "feasibility": feasibility(folds, (escape / inspect,)),
    }

"""Ranking metrics over scored lots: columns of `keys`, row_id, y (0 or 1) and p.

Nearly all of them come from one table, the ladder: a row for each different score with counts at it and above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldgate.plans.shared import running_sums

from .profile import exact_quantiles, ratio

ABOVE = 1.0 + 1e-9
KEYS = ["model"]


def ladder(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, p, n, k (lots and failures with this score), cum_n, cum_k (with this or a higher one), total_n, total_k.

    Scores 0 and just above 1, at which everything and nothing is flagged, are there for every key.
    """
    keys = keys or KEYS
    steps = scored.select(*keys, "p", F.lit(1).alias("n"), F.col("y").alias("k"))
    ends = scored.select(*keys).distinct().select(*keys, F.explode(F.array(F.lit(0.0), F.lit(ABOVE))).alias("p"), F.lit(0).alias("n"), F.lit(0).alias("k"))
    steps = steps.unionByName(ends).groupBy(*keys, "p").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    out = running_sums(steps, [F.desc("p")], {"cum_n": F.col("n"), "cum_k": F.col("k")}, keys)
    totals = out.groupBy(*keys).agg(F.sum("n").alias("total_n"), F.sum("k").alias("total_k"))
    return out.join(F.broadcast(totals), keys)


def costs(flagged: Column, caught: Column, n: Column, k: Column, inspect: Column | float, escape: Column | float) -> dict[str, Column]:
    """The cost columns of a policy that flags so many lots and catches so many failures."""
    inspect, escape = (x if isinstance(x, Column) else F.lit(x) for x in (inspect, escape))
    total = flagged * inspect + (k - caught) * escape
    return {
        "n": n, "n_flagged": flagged, "flag_rate": ratio(flagged, n), "caught": caught, "missed": k - caught, "catch_rate": ratio(caught, k),
        "inspect_cost": flagged * inspect, "escape_cost": (k - caught) * escape, "total_cost": total, "cost_per_lot": ratio(total, n),
    }


def cost_curve(steps: DataFrame, inspect: float, escape: float, keys: list[str] | None = None) -> DataFrame:
    """Costs at every threshold of a ladder."""
    c = costs(F.col("cum_n"), F.col("cum_k"), F.col("total_n"), F.col("total_k"), inspect, escape)
    return steps.select(*(keys or KEYS), F.col("p").alias("threshold"), *(v.alias(name) for name, v in c.items()))


def score_metrics(steps: DataFrame, scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """n, n_fail, prevalence, average precision and its ratio to the prevalence, ROC AUC with mid-ranks, Brier score."""
    keys = keys or KEYS
    n, k, up_n, up_k = (F.col(c) for c in ("n", "k", "cum_n", "cum_k"))
    all_n, all_k = F.first("total_n"), F.first("total_k")
    below = F.col("total_n") - F.col("total_k") - (up_n - up_k)
    a = steps.groupBy(*keys).agg(
        all_n.alias("n"), all_k.alias("n_fail"),
        F.sum(F.try_divide(k * up_k.cast("double"), up_n)).alias("ap"), F.sum(k * (below + (n - k) / 2)).alias("wins"),
    )
    brier = scored.groupBy(*keys).agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    share, ap = ratio(F.col("n_fail"), F.col("n")), ratio(F.col("ap"), F.col("n_fail"))
    auc = ratio(F.col("wins"), F.col("n_fail") * (F.col("n") - F.col("n_fail")))
    return a.join(brier, keys).select(*keys, "n", "n_fail", share.alias("prevalence"), ap.alias("pr_auc"), ratio(ap, share).alias("pr_auc_over_floor"), auc.alias("roc_auc"), "brier")


def top_shares(scored: DataFrame, shares: tuple[float, ...] = (0.05, 0.1, 0.2), keys: list[str] | None = None) -> DataFrame:
    """Recall and lift of the highest ceil(n * share) lots, one at least; ties go by row_id."""
    keys = keys or KEYS
    ranked = running_sums(scored, [F.desc("p"), F.col("row_id")], {"rank": F.lit(1), "cum_k": F.col("y")}, keys)
    totals = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("n_fail"))
    quotas = totals.withColumn("share", F.explode(F.array(*(F.lit(s) for s in shares))))
    quotas = quotas.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("share"))).cast("long"))
    at = ranked.join(F.broadcast(quotas), [*keys, "rank"])
    caught = F.col("cum_k")
    return at.select(*keys, "share", F.col("rank").alias("quota"), caught.alias("caught"), ratio(caught, F.col("n_fail")).alias("recall"), ratio(ratio(caught, F.col("rank")), ratio(F.col("n_fail"), F.col("n"))).alias("lift"))


def at_thresholds(scored: DataFrame, thresholds: tuple[float, ...], keys: list[str] | None = None) -> DataFrame:
    """Confusion counts, precision, recall and F1 (0 where undefined) for flags p >= t."""
    keys = keys or KEYS
    rows = scored.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))
    flag, bad = F.col("p") >= F.col("threshold"), F.col("y") == 1
    a = rows.groupBy(*keys, "threshold").agg(F.count_if(flag & bad).alias("tp"), F.count_if(flag & ~bad).alias("fp"), F.count_if(~flag & bad).alias("fn"), F.count_if(~flag & ~bad).alias("tn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return a.select(
        *keys, "threshold", "tp", "fp", "fn", "tn", zero(ratio(tp, tp + fp)).alias("precision"), zero(ratio(tp, tp + fn)).alias("recall"),
        zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), ratio(tp + fp, tp + fp + fn + tn).alias("flag_rate"),
    )


def pr_curve(steps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """threshold, precision, recall at every score that occurs, and the end at threshold 1: precision 1, recall 0."""
    keys = keys or KEYS
    points = steps.where("n > 0").select(*keys, F.col("p").alias("threshold"), ratio(F.col("cum_k"), F.col("cum_n")).alias("precision"), ratio(F.col("cum_k"), F.col("total_k")).alias("recall"), F.lit(False).alias("is_end"))
    end = steps.select(*keys).distinct().select(*keys, F.lit(1.0).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(True).alias("is_end"))
    return points.unionByName(end)


def calibration_curve(scored: DataFrame, bins: int = 8, keys: list[str] | None = None) -> DataFrame:
    """Mean score and observed rate in bins between exact quantiles of the scores (first edge in, others belong below)."""
    keys = keys or KEYS
    edges = exact_quantiles(scored, keys, "p", [i / bins for i in range(bins + 1)]).withColumnRenamed("quantiles", "edges")
    inner = F.slice(F.col("edges"), 2, bins - 1)
    rows = scored.join(F.broadcast(edges), keys).withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("p"))))
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("observed"))


def linear_importance(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """feature, importance: mean absolute Shapley value, which for a linear score is weight * (value - mean).

    A missing reading stands at the mean.
    """
    means = rows.agg(*(F.avg(c).alias(f"_mean_{c}") for c in weights))
    parts = rows.crossJoin(F.broadcast(means)).agg(*(F.avg(F.abs(F.lit(w) * F.coalesce(F.col(c) - F.col(f"_mean_{c}"), F.lit(0.0)))).alias(c) for c, w in weights.items()))
    return parts.unpivot([], list(weights), "feature", "importance")


def top_features(ranking: DataFrame, n: int = 15) -> DataFrame:
    """The n features with the largest importance; of equals the first by name."""
    return ranking.orderBy(F.desc("importance"), "feature").limit(n)

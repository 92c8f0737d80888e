"""Has the world changed? Failure rates against break-even, and the population stability of every feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldgate.functions.beta import rate_interval_udf
from yieldgate.sources.lots import long_features

from .profile import exact_quantiles, ratio

MAJOR, MAJOR_SHARE, FLOOR = 0.25, 0.10, 1e-6


def prevalence_regime(counts: DataFrame, breakeven: float) -> DataFrame:
    """counts (.., n, n_fail) with prevalence, ci_lo, ci_hi and regime: inspect, no_inspect or undecided."""
    ci = counts.withColumn("_ci", rate_interval_udf("n_fail", "n"))
    low, high = F.col("_ci.low"), F.col("_ci.high")
    regime = F.when(F.col("n") <= 0, "undecided").when(low > breakeven, "inspect").when(high < breakeven, "no_inspect").otherwise("undecided")
    return ci.select(*counts.columns, ratio(F.col("n_fail"), F.col("n")).alias("prevalence"), low.alias("ci_lo"), high.alias("ci_hi"), F.lit(breakeven).alias("breakeven"), regime.alias("regime"))


def feature_psi(reference: DataFrame, current: DataFrame, bins: int = 10, cols: list[str] | None = None) -> DataFrame:
    """feature and psi for all features at once; NULL where the reference has no two different quantiles.

    Bins are those of the reference's different quantiles, open at both ends, and one for missing readings.
    """
    ref, cur = (long_features(x, cols, keep=()).withColumn("is_ref", F.lit(r)) for x, r in ((reference, True), (current, False)))
    found = exact_quantiles(ref, ["feature"], "x", [i / bins for i in range(bins + 1)])
    edges = found.select("feature", F.array_sort(F.array_distinct(F.array_compact("quantiles"))).alias("edges"))
    rows = ref.unionByName(cur).join(F.broadcast(edges), "feature")
    inner = F.slice(F.col("edges"), F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    place = F.when(F.col("x").isNull(), -1).otherwise(F.size(F.filter(inner, lambda e: e <= F.col("x"))))
    usable = F.size("edges") >= 2
    cells = rows.where(usable).groupBy("feature", place.alias("bin")).agg(F.count_if("is_ref").alias("e"), F.count_if(~F.col("is_ref")).alias("a"))
    totals = cells.groupBy("feature").agg(F.sum("e").alias("all_e"), F.sum("a").alias("all_a"))
    share = lambda c: F.greatest(F.coalesce(ratio(F.col(c), F.col(f"all_{c}")), F.lit(0.0)), F.lit(FLOOR))
    term = (share("a") - share("e")) * F.ln(share("a") / share("e"))
    psi = cells.join(F.broadcast(totals), "feature").groupBy("feature").agg(F.sum(term).alias("psi"))
    return edges.select("feature").join(psi, "feature", "left")


def retraining_trigger(reference: DataFrame, current: DataFrame, breakeven: float, cols: list[str] | None = None, top: int = 10) -> DataFrame:
    """One row: regimes of both windows, whether the best action flipped, whether inputs drifted, the widest drifts."""
    count = lambda df, w: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("fail"), F.lit(0)).alias("n_fail")).withColumn("w", F.lit(w))
    regimes = prevalence_regime(count(reference, "ref").unionByName(count(current, "cur")), breakeven)
    pick = lambda w: F.max(F.when(F.col("w") == w, F.col("regime")))
    regimes = regimes.agg(pick("ref").alias("reference_regime"), pick("cur").alias("current_regime"))
    psi = input_drift(feature_psi(reference, current, cols=cols), top)
    both = regimes.crossJoin(psi)  # one row each
    a, b = F.col("reference_regime"), F.col("current_regime")
    flipped = (a != "undecided") & (b != "undecided") & (a != b)
    return both.withColumn("action_flipped", flipped).withColumn("retrain", F.col("action_flipped") | F.col("input_drifted"))


def input_drift(psi: DataFrame, top: int = 10) -> DataFrame:
    """One row: usable features, those with major drift, their share, and the widest ones."""
    major = F.count_if(F.col("psi") > MAJOR)
    share = ratio(major, F.count("psi"))
    widest = F.slice(F.sort_array(F.collect_list(F.when(F.col("psi").isNotNull(), F.struct((-F.col("psi")).alias("o"), "feature", "psi")))), 1, top)
    a = psi.agg(F.count("psi").alias("psi_usable"), major.alias("psi_major"), share.alias("psi_share_major"), widest.alias("w"))
    return a.select("psi_usable", "psi_major", "psi_share_major", F.coalesce(F.col("psi_share_major") > MAJOR_SHARE, F.lit(False)).alias("input_drifted"), F.transform("w", lambda x: F.struct(x["feature"], x["psi"])).alias("psi_top"))


def breakeven_prevalence(inspect: float, escape: float) -> float:
    return inspect / escape


def required_lift_by_window(lots: DataFrame, escape_ratio: float, window: Column) -> DataFrame:
    """window, n, n_fail and the lift that ranking needs there."""
    from yieldgate.functions.power import required_lift

    a = lots.groupBy(window.alias("window")).agg(F.count("*").alias("n"), F.sum("fail").alias("n_fail"))
    return a.select("window", "n", "n_fail", required_lift(ratio(F.col("n_fail"), F.col("n")), F.lit(float(escape_ratio))).alias("required_lift"))

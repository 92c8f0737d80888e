"""Thresholds, inspection rates and policies under costs of inspection and of escape.

Costs are compared as totals, never as averages, so that ties are ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldgate.functions.beta import upper_rate_udf

from .metrics import ABOVE, KEYS, cost_curve, costs
from .profile import ratio

#: Guards a product of a count and a rate against falling just below a whole number.
EPS = 1e-10
GRID = 101
RATIOS = (1, 2, 5, 10, 20, 30, 50, 100, 200)


def quota(n: Column, rate: Column | float) -> Column:
    """The most lots that a rate allows."""
    return F.floor(n * (rate if isinstance(rate, Column) else F.lit(rate)) + F.lit(EPS)).cast("long")


def optimal_threshold(steps: DataFrame, inspect: float, escape: float, cap: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """The cheapest threshold whose flags stay within the cap; of equals the lowest."""
    keys = keys or KEYS
    curve = cost_curve(steps, inspect, escape, keys)
    if cap is not None:
        curve = curve.where(F.col("flag_rate") <= cap)
    rest = [c for c in curve.columns if c not in keys]
    best = curve.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("total_cost", "threshold")).alias("best"))
    return best.select(*keys, "best.*")


def rate_cuts(steps: DataFrame, rates: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, i, rate, above, n_flagged, caught: whom a rate flags.

    At most floor(n * rate) lots with the highest scores; lots tied at the boundary stay out together. Flagged are those
    with p > above; rate 1 flags all (above NULL), rate 0 none (above infinite).
    """
    keys = keys or KEYS
    listed = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(r)).alias("rate")) for i, r in enumerate(rates)))
    before = F.col("cum_n") - F.col("n")

    def holds(x: Column) -> Column:
        count = quota(F.col("total_n"), x["rate"])
        return (x["rate"] > 0) & (x["rate"] < 1) & (count >= before) & (count < F.col("cum_n"))

    inside = steps.withColumn("r", F.explode(F.filter(listed, holds)))
    inside = inside.select(*keys, "r.i", "r.rate", F.col("p").alias("above"), before.alias("n_flagged"), (F.col("cum_k") - F.col("k")).alias("caught"), "total_n", "total_k")
    ends = steps.groupBy(*keys).agg(F.first("total_n").alias("total_n"), F.first("total_k").alias("total_k"))
    ends = ends.withColumn("r", F.explode(F.filter(listed, lambda x: (x["rate"] <= 0) | (x["rate"] >= 1)))).withColumn("all", F.col("r.rate") >= 1)
    zero = F.lit(0).cast("long")
    ends = ends.select(
        *keys, "r.i", "r.rate", F.when(~F.col("all"), F.lit(float("inf"))).alias("above"),
        F.when(F.col("all"), F.col("total_n")).otherwise(zero).alias("n_flagged"), F.when(F.col("all"), F.col("total_k")).otherwise(zero).alias("caught"),
        "total_n", "total_k",
    )
    return inside.unionByName(ends)


def grid_rates(cap: float | None = None, grid: int = GRID) -> list[float]:
    return [i * ((cap if cap is not None else 1.0) / (grid - 1)) for i in range(grid)]


def optimal_flag_rate(steps: DataFrame, inspect: float, escape: Column | float, cap: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """The cheapest rate of an even grid up to the cap; of equals the lowest."""
    keys = keys or KEYS
    cuts = rate_cuts(steps, grid_rates(cap), keys)
    c = costs(F.col("n_flagged"), F.col("caught"), F.col("total_n"), F.col("total_k"), inspect, escape)
    rows = cuts.select(*keys, F.col("rate").alias("target_flag_rate"), "above", *(v.alias(name) for name, v in c.items()))
    rest = [x for x in rows.columns if x not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("total_cost", "target_flag_rate")).alias("best"))
    return best.select(*keys, "best.*")


def robust_flag_rate(steps: DataFrame, inspect: float, escape: float, cap: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """optimal_flag_rate with the escape cost inflated by upper bound over observed rate.

    Without a failure the upper bound decides between the cap and no inspection. Costs contain the inflation.
    """
    keys = keys or KEYS
    rates = steps.groupBy(*keys).agg(F.first("total_n").alias("b_n"), F.first("total_k").alias("b_k"))
    rates = rates.withColumn("base_rate_upper", upper_rate_udf("b_k", "b_n")).withColumn("base_rate_observed", ratio(F.col("b_k"), F.col("b_n")))
    rates = rates.withColumn("escape_inflation", F.when(F.col("b_k") > 0, F.col("base_rate_upper") / F.col("base_rate_observed")).otherwise(F.lit(1.0)))
    extra = ["base_rate_observed", "base_rate_upper", "escape_inflation"]
    cuts = rate_cuts(steps, grid_rates(cap), keys).join(F.broadcast(rates), keys)
    high = F.col("base_rate_upper") * escape > inspect
    c = costs(F.col("n_flagged"), F.col("caught"), F.col("total_n"), F.col("total_k"), inspect, F.lit(float(escape)) * F.col("escape_inflation"))
    rows = cuts.select(*keys, F.col("rate").alias("target_flag_rate"), "above", *(v.alias(name) for name, v in c.items()), *extra, "b_k", high.alias("high"))
    # Without failures only the ends of the grid are in question.
    order = F.when(F.col("b_k") > 0, F.col("total_cost")).when(F.col("high"), -F.col("target_flag_rate")).otherwise(F.col("target_flag_rate"))
    rest = [x for x in rows.columns if x not in (*keys, "b_k", "high")]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order, F.col("target_flag_rate"))).alias("best"))
    return best.select(*keys, "best.*")


def inspects(k: Column, n: Column, inspect: Column | float, escape: Column | float, cap: float | None) -> Column:
    """Whether inspecting (all lots, or a random quota under a cap) is expected to be cheaper than not inspecting."""
    inspect, escape = (x if isinstance(x, Column) else F.lit(x) for x in (inspect, escape))
    q = n if cap is None else quota(n, cap)
    # q/n c_i + (1 - q/n) k/n c_e < k/n c_e, without fractions
    return (q * inspect * n + (n - q) * k * escape) < (k * escape * n)


def policy_table(select: DataFrame, test: DataFrame, inspect: float, escape: float, cap: float | None = None) -> DataFrame:
    """Costs on `test` of no inspection, full inspection, the model and, under a cap, a random quota.

    select and test are ladders with one key, the same; threshold and baseline come from `select` alone.
    """
    keys = KEYS
    chosen = optimal_threshold(select, inspect, escape, cap, keys).select(*keys, "threshold")
    known = select.groupBy(*keys).agg(F.first("total_n").alias("s_n"), F.first("total_k").alias("s_k"))
    at = test.join(F.broadcast(chosen.join(known, keys)), keys)
    met = F.when(F.col("p") >= F.col("threshold"), F.col("n")), F.when(F.col("p") >= F.col("threshold"), F.col("k"))
    one = at.groupBy(*keys, "threshold", "s_n", "s_k").agg(F.first("total_n").alias("t_n"), F.first("total_k").alias("t_k"), *(F.coalesce(F.sum(x), F.lit(0)).alias(a) for x, a in zip(met, ("m_n", "m_k"), strict=True)))
    n, k = F.col("t_n"), F.col("t_k")
    q = n if cap is None else quota(n, cap)
    none = F.lit(None).cast("double")

    def row(name: str, threshold: Column, flagged: Column, caught: Column, feasible: Column) -> Column:
        c = costs(flagged.cast("double"), caught.cast("double"), n, k, inspect, escape)
        return F.struct(F.lit(name).alias("policy"), threshold.alias("threshold"), *(v.cast("double").alias(x) for x, v in c.items()), feasible.alias("feasible"))

    fits = lambda flagged: flagged <= q
    rows = [
        row("inspect_none", F.lit(ABOVE), F.lit(0), F.lit(0), F.lit(True)),
        row("inspect_all", F.lit(0.0), n, k, fits(n)),
        row("model", F.col("threshold"), F.col("m_n"), F.col("m_k"), fits(F.col("m_n"))),
    ]
    if cap is not None:
        rows.append(row("random_at_capacity", none, q, k * ratio(q, n), F.lit(True)))
    alternative = F.lit("inspect_all") if cap is None else F.when(q == n, "inspect_all").otherwise("random_at_capacity")
    baseline = F.when(inspects(F.col("s_k"), F.col("s_n"), inspect, escape, cap), alternative).otherwise("inspect_none")
    table = one.select(*keys, baseline.alias("baseline"), F.array(*rows).alias("rows"))
    table = table.withColumn("base", F.filter("rows", lambda r: r["policy"] == F.col("baseline"))[0]["total_cost"])
    out = table.select(*keys, "baseline", "base", F.explode("rows").alias("r"))
    return out.select(*keys, "r.*", "baseline", (F.col("r.total_cost") - F.col("base")).alias("vs_baseline"), ratio(F.col("base") - F.col("r.total_cost"), F.col("base")).alias("saving"))


def cost_sensitivity(select: DataFrame, test: DataFrame, ratios: tuple[int, ...] = RATIOS, cap: float | None = None) -> DataFrame:
    """For each ratio of escape to inspection cost: threshold chosen on `select`, costs of model and baseline on `test`."""
    keys = [*KEYS, "cost_ratio"]
    each = lambda steps: steps.withColumn("cost_ratio", F.explode(F.array(*(F.lit(r) for r in ratios))))
    curve = each(select)
    flag_rate = ratio(F.col("cum_n"), F.col("total_n"))
    curve = curve.withColumn("total_cost", F.col("cum_n") + (F.col("total_k") - F.col("cum_k")) * F.col("cost_ratio"))
    if cap is not None:
        curve = curve.where(flag_rate <= cap)
    chosen = curve.groupBy(*keys).agg(F.min_by("p", F.struct("total_cost", "p")).alias("threshold"), F.first("total_n").alias("s_n"), F.first("total_k").alias("s_k"))
    if cap is not None:
        limit = rate_cuts(test, [cap]).select(*KEYS, "above")
        chosen = chosen.join(F.broadcast(limit), KEYS)
    else:
        chosen = chosen.withColumn("above", F.lit(None).cast("double"))
    at = each(test).join(F.broadcast(chosen), keys)
    flag = (F.col("p") >= F.col("threshold")) & (F.col("above").isNull() | (F.col("p") > F.col("above")))
    total = lambda c: F.coalesce(F.sum(F.when(flag, F.col(c))), F.lit(0)).cast("long")
    one = at.groupBy(*keys, "threshold", "s_n", "s_k").agg(F.first("total_n").alias("n"), F.first("total_k").alias("k"), total("n").alias("n_flagged"), total("k").alias("caught"))
    r, n, k = F.col("cost_ratio"), F.col("n"), F.col("k")
    q = n if cap is None else quota(n, cap)
    model = F.col("n_flagged") + (k - F.col("caught")) * r
    alternative = q + (n - q) * r * ratio(k, n)
    baseline = F.when(inspects(F.col("s_k"), F.col("s_n"), F.lit(1), r, cap), alternative).otherwise((k * r).cast("double"))
    return one.select(
        *keys, "threshold", "n_flagged", ratio(F.col("n_flagged"), n).alias("flag_rate"), ratio(F.col("caught"), k).alias("catch_rate"),
        (k * r).alias("cost_none"), n.alias("cost_all"), model.alias("cost_model"), baseline.alias("cost_baseline"),
        ratio(baseline - model, baseline).alias("saving"), (model < baseline).alias("model_wins"),
    )

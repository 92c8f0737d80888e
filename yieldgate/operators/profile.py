"""Profiles of lots, their drift over time, and screens of single features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldgate.functions.beta import welch_p_udf
from yieldgate.plans.shared import running_sums
from yieldgate.sources.lots import long_features


def rounded(x: Column, places: int) -> Column:
    """Rounds the scaled double, as engines do that do not round its shortest decimal."""
    return F.round(x * 10**places, 0) / 10**places


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def unless_equal(x: Column, spread: Column) -> Column:
    """A variance or spread of x, 0 where all values are equal: Spark merges the sums of tasks with rounding, which leaves a rest."""
    return F.when(F.min(x) < F.max(x), spread).when(F.count(x) > 0, 0.0)


def lots_profile(lots: DataFrame) -> DataFrame:
    """One row: counts, failure rate, imbalance, first and last time, days between by the calendar."""
    a = lots.agg(F.count("*").alias("n_lots"), F.sum("fail").alias("n_fail"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    n, k = F.col("n_lots"), F.col("n_fail")
    return a.select(
        "n_lots", "n_fail", (n - k).alias("n_pass"), rounded(ratio(k, n), 6).alias("fail_rate"), rounded(ratio(n - k, k), 2).alias("imbalance"),
        "first_ts", "last_ts", F.datediff("last_ts", "first_ts").alias("span_days"),
    )


def column_profile(lots: DataFrame) -> DataFrame:
    """feature, n, n_missing, missing_frac, n_distinct (missing ones left out)."""
    long = long_features(lots, keep=())
    a = long.groupBy("feature").agg(F.count("*").alias("n"), F.count("x").alias("n_present"), F.count_distinct("x").alias("n_distinct"))
    return a.select("feature", "n", (F.col("n") - F.col("n_present")).alias("n_missing"), (1 - ratio(F.col("n_present"), F.col("n"))).alias("missing_frac"), "n_distinct")


def sensor_profile(lots: DataFrame) -> DataFrame:
    """One row over all features: missing cells, constant and mostly missing columns, elapsed whole days."""
    c = column_profile(lots).agg(
        F.count("*").alias("n_features"), F.sum("n_missing").alias("missing_cells"), ratio(F.sum("n_missing"), F.sum("n")).alias("missing_frac"),
        F.count_if(F.col("n_distinct") <= 1).alias("constant_cols"), F.count_if(F.col("missing_frac") > 0.5).alias("mostly_missing_cols"),
    )
    whole = lots.agg(F.count("*").alias("n_lots"), F.sum("fail").alias("n_fail"), F.expr("timestampdiff(DAY, min(ts), max(ts))").alias("span_days"))
    return whole.crossJoin(c)  # one row each


def weekly_drift(lots: DataFrame) -> DataFrame:
    """week (from Monday), n_lots, n_fail, fail_rate, vs_overall, mean rate of the last four weeks with lots."""
    weeks = lots.groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n_lots"), F.sum("fail").alias("n_fail"))
    weeks = weeks.withColumn("rate", ratio(F.col("n_fail"), F.col("n_lots")))
    overall = weeks.agg(ratio(F.sum("n_fail"), F.sum("n_lots")).alias("overall"))  # of the weeks: the lots are read once
    recent = Window.orderBy("week").rowsBetween(-3, 0)  # one row a week
    return weeks.crossJoin(F.broadcast(overall)).select(
        "week", "n_lots", "n_fail", rounded(F.col("rate"), 6).alias("fail_rate"),
        rounded(ratio(F.col("rate"), F.col("overall")), 4).alias("vs_overall"), rounded(F.avg("rate").over(recent), 6).alias("fail_rate_ma4"),
    )


def semi_monthly(lots: DataFrame) -> DataFrame:
    """Half months labelled by their first day, the 15th or the end of the month before it is over; empty ones too."""
    day = F.to_date("ts")
    last = F.last_day(day)
    label = F.when(day == last, last).when(F.dayofmonth(day) >= 15, F.date_add(F.trunc(day, "month"), 14)).otherwise(F.date_sub(F.trunc(day, "month"), 1))
    halves = lots.groupBy(label.alias("half")).agg(F.count("*").alias("n_lots"), F.sum("fail").alias("n_fail"))
    ends = halves.agg(F.min("half").alias("a"), F.max("half").alias("b"))
    months = ends.select(F.explode(F.expr("sequence(trunc(a, 'month'), trunc(b, 'month'), interval 1 month)")).alias("m"), "a", "b")
    every = months.select(F.explode(F.array(F.date_add("m", 14), F.last_day("m"))).alias("half"), "a", "b").where("half between a and b").select("half")
    out = every.join(halves, "half", "left").na.fill(0, ["n_lots", "n_fail"])
    return out.select(F.col("half").cast("timestamp").alias("half"), "n_lots", "n_fail", ratio(F.col("n_fail"), F.col("n_lots")).alias("fail_rate"))


def missingness_gap(lots: DataFrame, low: float = 0.02, high: float = 0.98, top: int = 10) -> DataFrame:
    """Features whose missing readings go with failures: the widest gaps between failure rates."""
    absent = F.col("x").isNull()
    a = long_features(lots, keep=("fail",)).groupBy("feature").agg(
        F.count("*").alias("n"), F.count_if(absent).alias("n_missing"),
        F.avg(F.when(absent, F.col("fail"))).alias("rate_missing"), F.avg(F.when(~absent, F.col("fail"))).alias("rate_present"),
    )
    a = a.withColumns({"missing_frac": ratio(F.col("n_missing"), F.col("n")), "gap": F.abs(F.col("rate_missing") - F.col("rate_present"))})
    return a.where((F.col("missing_frac") > low) & (F.col("missing_frac") < high)).orderBy(F.desc("gap"), "feature").limit(top)


def welch_t(lots: DataFrame, least: int = 20, with_p: bool = True) -> DataFrame:
    """Welch's t between failed and passed lots for each feature with more than `least` readings on each side."""
    failed, passed = F.col("fail") == 1, F.col("fail") == 0
    side = lambda cond, f: f(F.when(cond, F.col("x")))
    a = long_features(lots, keep=("fail",)).groupBy("feature").agg(*(side(c, f).alias(f"{n}_{s}") for s, c in (("fail", failed), ("pass", passed)) for n, f in (("n", F.count), ("mean", F.avg), ("var", lambda x: unless_equal(x, F.var_samp(x))))))
    a = a.where((F.col("n_fail") > least) & (F.col("n_pass") > least) & ((F.col("var_fail") > 0) | (F.col("var_pass") > 0)))
    u, v = F.col("var_fail") / F.col("n_fail"), F.col("var_pass") / F.col("n_pass")
    t = (F.col("mean_fail") - F.col("mean_pass")) / F.sqrt(u + v)
    free = (u + v) ** 2 / (u**2 / (F.col("n_fail") - 1) + v**2 / (F.col("n_pass") - 1))
    out = a.select("feature", "n_fail", "n_pass", "mean_fail", "mean_pass", t.alias("t"), free.alias("df"))
    return out.withColumn("p", welch_p_udf("t", "df")).orderBy("p", "feature") if with_p else out


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys and `quantiles`, an array with a value for each share: exact, between neighbours by straight lines.

    Different values are counted and ranked by running sums over ranges, so no task holds a key's values; keys without
    a value have an array of nulls.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running_sums(counts, [F.col("_v")], {"_to": F.col("_n")}, keys)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    listed = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(shares)))
    at = lambda q: (F.col("_all") - 1) * q
    here = lambda place: (F.col("_to") - F.col("_n") <= place) & (place < F.col("_to"))
    low, high = (lambda q: F.floor(at(q))), (lambda q: F.ceil(at(q)))
    met = ranked.join(F.broadcast(totals), keys).withColumn("_q", F.explode(F.filter(listed, lambda x: here(low(x["q"])) | here(high(x["q"])))))
    q = F.col("_q.q")
    pick = lambda place: F.max(F.when(here(place), F.col("_v")))
    ends = met.groupBy(*keys, "_q").agg(pick(low(q)).alias("_a"), pick(high(q)).alias("_b"), F.first("_all").alias("_all"))
    between = F.when(low(q) == high(q), F.col("_a")).otherwise((high(q) - at(q)) * F.col("_a") + (at(q) - low(q)) * F.col("_b"))
    found = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_q.i").alias("i"), between.alias("v")))).alias("_all_q"))
    nothing = F.array(*(F.lit(None).cast("double") for _ in shares))
    out = rows.select(*keys).distinct().join(found, keys, "left")
    return out.select(*keys, F.coalesce(F.transform("_all_q", lambda x: x["v"]), nothing).alias("quantiles"))

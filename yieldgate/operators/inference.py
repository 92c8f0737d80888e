"""How sure is a backtest? Resampling of its 2x2 cells, all draws of a configuration in one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Draws, seed and confidence, fixed values of the published intervals.
DRAWS, PERMUTATIONS, SEED, CONF = 10_000, 20_000, 42, 0.95


def cells(folds: DataFrame) -> DataFrame:
    """folds (.., n_eval, n_flagged, caught, missed) with tp, fp, fn, tn; a negative cell is an error."""
    tp, fn = F.col("caught"), F.col("missed")
    fp = F.col("n_flagged") - tp
    tn = F.col("n_eval") - tp - fn - fp
    out = folds.withColumns({"tp": tp, "fp": fp, "fn": fn, "tn": tn})
    bad = F.least("tp", "fp", "fn", "tn") < 0
    message = F.concat(F.lit("cells of a fold do not add up: "), F.to_json(F.struct("tp", "fp", "fn", "tn")))
    return out.withColumn("tn", F.when(bad, F.raise_error(message).cast("long")).otherwise(F.col("tn")))


def _quota(n: np.ndarray, cap: float) -> np.ndarray:
    return np.floor(n * cap + 1e-10)


def _reference_total(action: str, n: np.ndarray, failed: np.ndarray, q: np.ndarray, inspect: float, escape: float) -> np.ndarray:
    """Cost of a policy without a model over windows of n lots with so many failures."""
    ways = {"inspect_none": failed * escape, "inspect_all": np.broadcast_to(n * inspect, failed.shape), "random_at_capacity": q * inspect + (1 - q / n) * failed * escape}
    if action not in ways:
        raise ValueError(f"no such policy: {action}")
    return ways[action]


def bootstrap(rows: pd.DataFrame, action: str, inspect: float, escape: float, cap: float | None, draws: int, seed: int, conf: float) -> dict:
    """Percentile intervals of costs a lot, drawn within folds; the policy compared with sees the same draws."""
    rows = rows.sort_values("fold")
    n = rows["n_eval"].to_numpy(np.int64)
    shares = rows[["tp", "fp", "fn", "tn"]].to_numpy(float) / n[:, None]
    rng = np.random.default_rng(seed)  # one generator, folds in order: draws can be repeated bit by bit
    drawn = np.array([rng.multinomial(int(k), p, size=draws) for k, p in zip(n, shares, strict=True)])
    caught, false, missed = drawn[..., 0], drawn[..., 1], drawn[..., 2]
    size = n[:, None].astype(float)
    q = _quota(size, cap) if cap is not None else size
    model = (caught + false) * inspect + missed * escape
    other = _reference_total(action, size, caught + missed, q, inspect, escape)
    model_lot, other_lot = model.sum(0) / n.sum(), other.sum(0) / n.sum()
    difference = np.round(other.sum(0) - model.sum(0), 6)
    with np.errstate(divide="ignore", invalid="ignore"):
        saving = np.where(other_lot > 0, (other_lot - model_lot) / other_lot, np.nan)
    cuts = [50 * (1 - conf), 50 * (1 + conf)]
    out = {}
    for name, x in (("model", model_lot), ("reference", other_lot), ("difference", difference / n.sum()), ("saving", saving)):
        out[f"{name}_lo"], out[f"{name}_hi"] = (float(v) for v in np.nanpercentile(x, cuts))
    return out | {"share_cheaper": float((difference > 0).mean())}


def permutation(rows: pd.DataFrame, draws: int, seed: int) -> dict:
    """One-sided p that a random quota catches as many failures; counts are compared, so ties count as ties."""
    rows = rows.sort_values("fold")
    rng = np.random.default_rng(seed)
    total = np.zeros(draws, np.int64)
    for tp, fp, fn, n in rows[["tp", "fp", "fn", "n_eval"]].itertuples(index=False):
        if tp + fp > 0 and tp + fn > 0:
            total += rng.hypergeometric(int(tp + fn), int(n - tp - fn), int(tp + fp), size=draws)
    return {"p_value": float((1 + (total >= rows["tp"].sum()).sum()) / (1 + draws)), "null_caught": float(total.mean())}


#: Logarithm below which a share of a law's largest probability is 0 as a double.
LEAST_LOG = -760.0


def _logs(ratio: Callable[[np.ndarray], np.ndarray], steps: int, width: int) -> np.ndarray:
    """Logarithms of a law's probabilities after 1, 2, .. steps from its mode, measured by the mode's, until they are 0 as doubles."""
    out, last = [np.zeros(0)], 0.0
    for a in range(0, steps, width):
        out.append(last + np.cumsum(np.log(ratio(np.arange(a, min(a + width, steps), dtype=float)))))
        last = out[-1][-1]
        if last < LEAST_LOG:
            break
    return np.concatenate(out)


def hypergeometric(n: int, k: int, m: int) -> tuple[int, np.ndarray]:
    """The law of how many of k failures are among m of n lots: the first number and probabilities from there on.

    It is built from its mode by ratios of neighbours and adds up to 1. Numbers whose probability is 0 as a double are left
    out, so its length grows with the square root of n.
    """
    low, high = max(0, m + k - n), min(m, k)
    mode = min(max((m + 1) * (k + 1) // (n + 2), low), high)
    width = 64 + int(40 * np.sqrt(m / max(n, 1) * k * (1 - m / max(n, 1)) * (1 - k / max(n, 1))))
    up = _logs(lambda i: (k - mode - i) / (mode + i + 1) * ((m - mode - i) / (n - k - m + mode + i + 1)), high - mode, width)
    down = _logs(lambda i: (mode - i) / (k - mode + i + 1) * ((n - k - m + mode - i) / (m - mode + i + 1)), mode - low, width)
    law = np.exp(np.concatenate([down[::-1], [0.0], up]))
    return mode - len(down), law / law.sum()


def exact_p(rows: pd.DataFrame) -> float:
    """The same p without draws: the caught failures' distributions under a random quota, convolved."""
    first, law = 0, np.ones(1)
    for tp, fp, fn, n in rows[["tp", "fp", "fn", "n_eval"]].astype(int).itertuples(index=False):
        low, one = hypergeometric(n, tp + fn, tp + fp)
        law = np.convolve(law, one)
        there = np.flatnonzero(law)  # products that are 0 as doubles go
        first, law = first + low + int(there[0]), law[there[0] : there[-1] + 1]
    return min(1.0, float(law[max(0, int(rows["tp"].sum()) - first) :].sum()))


def bootstrap_cost_ci(folds: DataFrame, keys: list[str], action: str, inspect: float, escape: float, cap: float | None = None, draws: int = DRAWS, seed: int = SEED, conf: float = CONF) -> DataFrame:
    """keys and intervals for each configuration: its folds, a handful of rows, are one group."""
    names = [f"{a}_{b}" for a in ("model", "reference", "difference", "saving") for b in ("lo", "hi")] + ["share_cheaper"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | bootstrap(rows, action, inspect, escape, cap, draws, seed, conf)])

    x = cells(folds).select(*keys, "fold", "n_eval", "tp", "fp", "fn", "tn")
    return x.groupBy(*keys).applyInPandas(run, ", ".join([f"{k} {x.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} double" for c in names]))


def permutation_test(folds: DataFrame, keys: list[str], draws: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """keys, p_value, null_caught, exact_p for each configuration."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | permutation(rows, draws, seed) | {"exact_p": exact_p(rows)}])

    x = cells(folds).select(*keys, "fold", "n_eval", "tp", "fp", "fn", "tn")
    return x.groupBy(*keys).applyInPandas(run, ", ".join([f"{k} {x.schema[k].dataType.simpleString()}" for k in keys] + ["p_value double", "null_caught double", "exact_p double"]))


def permutation_law(folds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, caught, null_caught (its mean under a random quota) and exact_p.

    A fold's catches under a random quota are hypergeometric; a configuration's folds, a handful of rows, are one group, whose
    laws are convolved. They are as long as the square root of the folds' sizes (see hypergeometric).
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | {"caught": rows["tp"].sum(), "null_caught": rows["expected"].sum(), "exact_p": exact_p(rows)}])

    expected = (F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) / F.col("n_eval")
    x = cells(folds).select(*keys, "fold", "n_eval", "tp", "fp", "fn", "tn", expected.alias("expected"))
    return x.groupBy(*keys).applyInPandas(run, ", ".join([f"{k} {x.schema[k].dataType.simpleString()}" for k in keys] + ["caught long", "null_caught double", "exact_p double"]))

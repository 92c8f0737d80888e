"""How much data a conclusion needs; columns of counts in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .beta import normal_quantile


def _z(alpha: float, power: float) -> float:
    return normal_quantile(1 - alpha / 2) + normal_quantile(power)


def min_detectable_auc(n_pos: Column, n_neg: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Least AUC that a window of so many failures and passes tells from 0.5; NULL if either is missing."""
    spread = F.sqrt((n_pos + n_neg + 1) / F.nullif(F.lit(12.0) * n_pos * n_neg, F.lit(0.0)))
    return F.when((n_pos > 0) & (n_neg > 0), F.lit(0.5) + F.lit(_z(alpha, power)) * spread)


def required_positives(auc: float, prevalence: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Failures that are needed to see an AUC."""
    k = (1 - prevalence) / prevalence
    n = (1 + k) * F.lit(_z(alpha, power) ** 2) / (F.lit(12.0) * k * F.lit((auc - 0.5) ** 2))
    return F.when((prevalence > 0) & (prevalence < 1) & F.lit(auc > 0.5), n)


def cost_resolution(n_lots: Column, c_escape: float) -> Column:
    """What one failure more or less changes in the cost of a lot."""
    return F.when(n_lots > 0, F.lit(float(c_escape)) / n_lots)


def required_lift(prevalence: Column, ratio: Column) -> Column:
    """Lift at which ranking beats the cheapest policy without a model; infinite where no inspection pays."""
    pr = prevalence * ratio
    return F.when(pr > 0, F.greatest(F.lit(1.0), F.try_divide(F.lit(1.0), pr))).otherwise(F.lit(float("inf")))

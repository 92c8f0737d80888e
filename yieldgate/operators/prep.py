"""Preprocessing that is fitted on training lots only and applied as a projection, row by row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldgate.sources.lots import feature_cols, long_features

from .profile import column_profile, exact_quantiles, ratio, unless_equal


def column_verdicts(train: DataFrame, max_missing: float = 0.5) -> DataFrame:
    """feature, n_distinct, missing_frac, is_constant, is_sparse, kept."""
    c = column_profile(train)
    constant, sparse = F.col("n_distinct") <= 1, F.col("missing_frac") > max_missing
    return c.select("feature", "n_distinct", "missing_frac", constant.alias("is_constant"), sparse.alias("is_sparse"), (~constant & ~sparse).alias("kept"))


def _products(batches: Iterator[pa.RecordBatch], means: list[float]) -> Iterator[pa.RecordBatch]:
    """A task's sums over pairs of columns: a row for each first column, with arrays over the second."""
    total = None
    for batch in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], 1) - np.array(means)
        there = ~np.isnan(x)
        x, m = np.where(there, x, 0.0), there.astype(np.float64)
        part = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, m.T @ x, m.T @ (x * x), x.T @ x])
        total = part if total is None else total + part
    if total is not None:
        columns = [pa.array(np.arange(len(means)), pa.int32()), *(pa.array(list(t), pa.list_(pa.float64())) for t in total)]
        yield pa.RecordBatch.from_arrays(columns, names=["a", *SUMS])


#: Sums over lots that have both readings: their number, of the first and its square, of the second and its square, of products.
SUMS = ("n", "x", "xx", "y", "yy", "xy")


def correlations(train: DataFrame, cols: list[str]) -> DataFrame:
    """a, b (a before b in cols), r: Pearson over lots that have both readings; all pairs in one pass.

    Every task multiplies its lots' matrix of readings by itself, so what is shuffled grows with tasks and columns, not
    with lots. Readings are taken from their columns' means, so that sums stay exact.
    """
    spark = train.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "a string, b string, r double")
    means = [m or 0.0 for m in train.agg(*(F.avg(c) for c in cols)).first()]
    kinds = "a int, " + ", ".join(f"{k} array<double>" for k in SUMS)
    sums = train.select(*(F.col(c).cast("double").alias(c) for c in cols)).mapInArrow(partial(_products, means=means), kinds)
    pairs = sums.select("a", F.posexplode(F.arrays_zip(*SUMS)).alias("b", "s")).where("b > a").groupBy("a", "b").agg(*(F.sum(f"s.{k}").alias(k) for k in SUMS))
    n, x, xx, y, yy, xy = (F.col(k) for k in SUMS)
    r = F.try_divide(xy - x * y / n, F.sqrt((xx - x * x / n) * (yy - y * y / n)))
    names = F.array(*(F.lit(c) for c in cols))
    return pairs.where("n > 0").select(F.get(names, "a").alias("a"), F.get(names, "b").alias("b"), r.alias("r"))


def correlated_cols(train: DataFrame, cols: list[str], threshold: float | None) -> list[str]:
    """Later columns of pairs with |r| above the threshold, even where the earlier one goes too; None drops none."""
    if threshold is None:
        return []
    return sorted({r[0] for r in correlations(train, cols).where(F.abs("r") > threshold).select("b").distinct().collect()}, key=cols.index)


@dataclass
class Prep:
    """Fitted steps: columns kept, their medians, and means and spreads after filling; as long as there are features."""

    cols: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    spreads: dict[str, float] = field(default_factory=dict)
    dropped: dict[str, int] = field(default_factory=dict)

    def value(self, c: str) -> Column:
        """A column as the model sees it."""
        if not self.medians:
            return F.col(c)
        return (F.coalesce(F.col(c), F.lit(self.medians[c])) - self.means[c]) / (self.spreads[c] or 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.value(c) for c in self.cols})

    def describe(self) -> str:
        return ", ".join(f"{k} -{n}" for k, n in self.dropped.items())


def impute_scale_params(train: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """feature, median (exact midpoint), mean and population spread after filling with it."""
    long = long_features(train, cols, keep=())
    medians = exact_quantiles(long, ["feature"], "x", [0.5]).select("feature", F.get("quantiles", F.lit(0)).alias("median"))
    filled = long.join(F.broadcast(medians), "feature").withColumn("v", F.coalesce("x", "median"))
    return filled.groupBy("feature").agg(F.first("median").alias("median"), F.avg("v").alias("mean"), unless_equal(F.col("v"), F.stddev_pop("v")).alias("spread"))


def fit(train: DataFrame, max_missing: float = 0.5, max_correlation: float | None = None, impute: bool = True) -> Prep:
    """Constant, sparse and correlated columns go, in this order; then, if asked for, medians fill and columns scale."""
    names = feature_cols(train)
    verdict = {r["feature"]: r for r in column_verdicts(train, max_missing).collect()}  # a row a feature
    varied = [c for c in names if not verdict[c]["is_constant"]]
    full = [c for c in varied if not verdict[c]["is_sparse"]]
    gone = set(correlated_cols(train, full, max_correlation))
    prep = Prep([c for c in full if c not in gone], dropped={"constant": len(names) - len(varied), "missing": len(varied) - len(full), "correlated": len(gone)})
    if impute and prep.cols:
        for r in impute_scale_params(train, prep.cols).collect():
            prep.medians[r["feature"]], prep.means[r["feature"]], prep.spreads[r["feature"]] = r["median"], r["mean"], r["spread"]
    return prep


def missing_share(df: DataFrame, c: str) -> Column:
    return 1 - ratio(F.count(c), F.count("*"))

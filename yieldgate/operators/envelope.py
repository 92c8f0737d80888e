"""The best threshold for every cost ratio at once: the lower envelope of a ladder's cost lines.

With escapes that cost R inspections, a threshold that flags n lots and catches k of K failures costs n + (K - k) R: a
line in R. The thresholds that are cheapest for some R are the corners of the upper convex hull of the points (n, k), and
neighbouring corners change places where their lines cross. Each task keeps the hull of its range of the ladder; hulls
are a small part of the points, and the hull of all of them is that of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import KEYS, costs

_POINT = ("p", "cum_n", "cum_k")


def hull(points: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Corners (p, n, k) from few flags to many, by strictly falling catches a flag; of equal points the lowest p."""
    best: dict[int, tuple[float, int, int]] = {}
    for p, n, k in points:
        if n not in best or (k, -p) > (best[n][2], -best[n][0]):
            best[n] = (p, n, k)
    out: list[tuple[float, int, int]] = []
    for n in sorted(best):
        new = best[n]
        if out and new[2] <= out[-1][2]:
            continue
        while len(out) > 1 and (out[-1][2] - out[-2][2]) * (new[1] - out[-1][1]) <= (new[2] - out[-1][2]) * (out[-1][1] - out[-2][1]):
            out.pop()
        out.append(new)
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corners of each key's points in a task, folded batch by batch; key is one text."""
    held: dict[str, list[tuple[float, int, int]]] = {}
    for batch in batches:
        rows: dict[str, list[tuple[float, int, int]]] = {}
        for key, *point in zip(*(batch.column(c).to_pylist() for c in ("key", *_POINT)), strict=True):
            rows.setdefault(key, []).append(tuple(point))
        for key, points in rows.items():
            held[key] = hull(held.get(key, []) + points)
    for key, points in held.items():
        columns = list(zip(*points, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(points)), pa.array(columns[0], pa.float64()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["key", *_POINT])


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corners with the steps to their neighbours: more flags and more catches, null at the ends."""
    names = ["key", *_POINT, "less_n", "less_k", "more_n", "more_k"]
    for batch in _kept(batches):
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        steps = [(None, None), *((b[2] - a[2], b[3] - a[3]) for a, b in zip(rows, rows[1:], strict=False)), (None, None)]
        made = [(*r, *steps[i], *steps[i + 1]) for i, r in enumerate(rows)]
        kinds = [pa.string(), pa.float64(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)


def cost_envelope(steps: DataFrame, cap: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, threshold, n_flagged, caught, from_ratio, to_ratio, total_n, total_k and the steps that make the ratios.

    A threshold is the cheapest one for ratios of escape to inspection cost from from_ratio on (there the lowest of the
    cheapest ones) to below to_ratio (null: without end). steps is a ladder; a cap leaves out thresholds that flag more.
    """
    keys = keys or KEYS
    if cap is not None:
        steps = steps.where(F.col("cum_n") <= F.col("total_n") * F.lit(cap))
    key = F.to_json(F.struct(*keys))
    kinds = "key string, p double, cum_n long, cum_k long"
    near = steps.select(key.alias("key"), *(F.col(c).cast("double" if c == "p" else "long").alias(c) for c in _POINT)).mapInArrow(_kept, kinds)
    corners = near.repartition("key").mapInArrow(_intervals, f"{kinds}, less_n long, less_k long, more_n long, more_k long")
    totals = steps.groupBy(*keys).agg(F.first("total_n").alias("total_n"), F.first("total_k").alias("total_k")).withColumn("key", key)
    ratio = lambda a, b: F.col(a) / F.col(b)
    return corners.join(F.broadcast(totals), "key").select(
        *keys, F.col("p").alias("threshold"), F.col("cum_n").alias("n_flagged"), F.col("cum_k").alias("caught"),
        F.coalesce(ratio("less_n", "less_k"), F.lit(0.0)).alias("from_ratio"), ratio("more_n", "more_k").alias("to_ratio"), "total_n", "total_k", "less_n", "less_k", "more_n", "more_k",
    )


def what_if(envelope: DataFrame, scenarios: list[tuple[float, float]], keys: list[str] | None = None) -> DataFrame:
    """keys, inspect, escape, threshold and costs: the cheapest threshold under each pair of costs (inspection above 0).

    Ratios are compared without dividing, so that a pair at a corner's own ratio takes the lower threshold.
    """
    keys = keys or KEYS
    listed = F.array(*(F.struct(F.lit(float(a)).alias("inspect"), F.lit(float(b)).alias("escape")) for a, b in scenarios))
    rows = envelope.withColumn("s", F.explode(listed)).select("*", "s.inspect", "s.escape")
    since = F.col("less_n").isNull() | (F.col("escape") * F.col("less_k") >= F.col("inspect") * F.col("less_n"))
    until = F.col("more_n").isNull() | (F.col("escape") * F.col("more_k") < F.col("inspect") * F.col("more_n"))
    c = costs(F.col("n_flagged"), F.col("caught"), F.col("total_n"), F.col("total_k"), F.col("inspect"), F.col("escape"))
    return rows.where(since & until).select(*keys, "inspect", "escape", "threshold", *(v.alias(name) for name, v in c.items()))


def break_even(totals: DataFrame, ratios: list[float]) -> DataFrame:
    """Columns of totals (n, n_fail) with cost_ratio, prevalence, break_even (the failure rate from which inspecting all pays),
    required_lift (how much richer flagged lots must be than all lots) and pays (whether inspecting all does)."""
    rows = totals.withColumn("cost_ratio", F.explode(F.array(*(F.lit(float(r)) for r in ratios))))
    share = F.try_divide(F.col("n_fail"), F.col("n"))
    return rows.withColumns({
        "prevalence": share, "break_even": 1 / F.col("cost_ratio"), "required_lift": F.when(F.col("n_fail") > 0, F.greatest(F.lit(1.0), 1 / (share * F.col("cost_ratio")))).otherwise(F.lit(float("inf"))),
        "pays": F.col("n_fail") * F.col("cost_ratio") > F.col("n"),
    })

"""Weekly failure rates of a stream of lots, the regime they are in, and flips of the best action, corrected by late lots."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from yieldgate.functions.beta import rate_interval
from yieldgate.operators.drift import prevalence_regime

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Weeks of the moving average.
AVERAGED = 4
EVENT = "line string, version long, week timestamp, n long, n_fail long, fail_rate double, fail_rate_ma4 double, ci_lo double, ci_hi double, regime string, standing string, flipped boolean"


def read_lots(spark: SparkSession, path: str, schema: str = "ts timestamp, fail int", per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files with ts and fail."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def weekly_rates(lots: DataFrame, late: str = "7 days") -> DataFrame:
    """week (from Monday), n, n_fail; a week leaves when the watermark has passed it."""
    weeks = F.window("ts", "7 days", "7 days", "4 days")  # the epoch was a Thursday
    a = lots.withWatermark("ts", late).groupBy(weeks.alias("w")).agg(F.count("*").alias("n"), F.sum("fail").alias("n_fail"))
    return a.select(F.col("w.start").alias("week"), "n", "n_fail")


def weekly_regimes(lots: DataFrame, breakeven: float, late: str = "7 days") -> DataFrame:
    return prevalence_regime(weekly_rates(lots, late), breakeven)


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, as Parquet."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by line and week of each batch, so that a busy line sends few rows to its state."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["line", "week"]).aggregate([("fail", "count"), ("fail", "sum")])
        counts = (t.column(c).cast(pa.int64()).combine_chunks() for c in ("fail_count", "fail_sum"))
        yield pa.RecordBatch.from_arrays([t.column("line").combine_chunks(), t.column("week").combine_chunks(), *counts], names=["line", "week", "n", "n_fail"])


class Standing(StatefulProcessor):
    """Keeps every week's counts and last event of a line (52 small rows a year) and tells the weeks whose event has changed.

    A week that a late lot changes is told again, with the weeks behind it whose average, standing action or flip hang on it.
    """

    def __init__(self, breakeven: float):
        self.breakeven = breakeven

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weeks = handle.getMapState("weeks", "week timestamp", "n long, n_fail long, ci_lo double, ci_hi double, told string")
        self.version = handle.getValueState("version", "version long")

    def _regime(self, low: float, high: float) -> str:
        return "inspect" if low > self.breakeven else "no_inspect" if high < self.breakeven else "undecided"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        added: dict[pd.Timestamp, list[int]] = {}
        for part in rows:
            for week, n, k in part[["week", "n", "n_fail"]].itertuples(index=False):
                sums = added.setdefault(pd.Timestamp(week), [0, 0])
                sums[0], sums[1] = sums[0] + int(n), sums[1] + int(k)
        known = {pd.Timestamp(w): list(v) for (w,), v in self.weeks.iterator()}
        for week, (n, k) in added.items():
            old = known.get(week, [0, 0, 0.0, 1.0, None])
            n, k = n + old[0], k + old[1]
            known[week] = [n, k, *rate_interval(k, n), old[4]]
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        out, rates, standing = [], [], None
        for week in sorted(known):
            n, k, low, high, told = known[week]
            rates = [*rates, k / n][-AVERAGED:]
            regime = self._regime(low, high)
            flipped = regime != "undecided" and standing is not None and regime != standing
            standing = standing if regime == "undecided" else regime
            event = (n, k, k / n, float(np.mean(rates)), low, high, regime, standing, flipped)
            if week in added or repr(event) != told:
                self.weeks.updateValue((week.to_pydatetime(),), (n, k, low, high, repr(event)))
                if repr(event) != told:
                    out.append((key[0], version, week, *event))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])


def standing_events(lots: DataFrame, breakeven: float) -> DataFrame:
    """Events of a stream of lots (line, ts, fail): a row whenever a week's event is new or corrected.

    Needs the RocksDB state store (run_events sets it). Lots without a line or time are no events; a null fail counts as a pass.
    """
    week = F.date_trunc("week", "ts").alias("week")
    slim = lots.where("line IS NOT NULL AND ts IS NOT NULL").select("line", week, F.coalesce("fail", F.lit(0)).cast("long").alias("fail"))
    counts = slim.mapInArrow(_partial_counts, "line string, week timestamp, n long, n_fail long")
    return counts.groupBy("line").transformWithStateInPandas(Standing(breakeven), EVENT, "Append", "None")


def run_events(events: DataFrame, path: str, checkpoint: str) -> None:
    """run_available with the state store that the events need; the session's own setting comes back."""
    spark = events.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        run_available(events, path, checkpoint)
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def current_events(events: DataFrame) -> DataFrame:
    """The last word on every week of a line."""
    rest = [c for c in events.columns if c not in ("line", "week", "version")]
    last = events.groupBy("line", "week").agg(F.max_by(F.struct(*rest), "version").alias("e"))
    return last.select("line", "week", "e.*")


def batch_events(lots: DataFrame, breakeven: float) -> DataFrame:
    """current_events of a table of lots, without a stream."""
    known = lots.where("line IS NOT NULL AND ts IS NOT NULL")
    weeks = known.groupBy("line", F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n"), F.sum(F.coalesce("fail", F.lit(0))).cast("long").alias("n_fail"))
    by_week = Window.partitionBy("line").orderBy("week")
    decided = F.when(F.col("regime") != "undecided", F.col("regime"))
    before = F.last(decided, ignorenulls=True).over(by_week.rowsBetween(Window.unboundedPreceding, -1))
    rows = prevalence_regime(weeks, breakeven).withColumn("fail_rate", F.col("n_fail") / F.col("n"))
    flipped = F.coalesce(decided != before, F.lit(False))
    return rows.select("line", "week", "n", "n_fail", "fail_rate", F.avg("fail_rate").over(by_week.rowsBetween(1 - AVERAGED, 0)).alias("fail_rate_ma4"), "ci_lo", "ci_hi", "regime", F.coalesce(decided, before).alias("standing"), flipped.alias("flipped"))

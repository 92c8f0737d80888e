"""Queries that write a table with one of the sinks, read it again and return what came back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldgate.operators import backtest, metrics, models, profile
from yieldgate.sources import lots as src
from yieldgate.streaming import monitor

from .queries import LONG, LOTS, PARTS, bounds_sql, query
from .shared import shared_dir, written


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query(f"WITH {LOTS} SELECT row_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, fail, f000, f001, f002 FROM lots")
def raw_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor and label files, side by side by position, in time order again."""
    lots = written(src.lots_events(spark, sf_dir).repartitionByRange(4, "row_id").sortWithinPartitions("row_id"), "lots")
    sensors, labels = _folder(spark, "sensors"), _folder(spark, "labels")
    src.write_raw_lots(lots, sensors, labels, ["f000", "f001", "f002"])
    return src.read_raw_lots(spark, sensors, labels, 3).withColumn("fail", F.col("fail").cast("int"))


@query(f"WITH {LOTS} SELECT row_id, CASE WHEN row_id % 5 > 1 THEN f000 END AS x, CAST(ts AS VARCHAR) IS NOT NULL AS dated FROM lots")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, in which what is no number is null."""
    lots = src.lots_events(spark, sf_dir)
    odd = F.pmod("row_id", F.lit(5))
    x = F.when(odd == 0, F.lit(float("nan"))).when(odd == 1, F.lit(float("-inf"))).otherwise(F.col("f000"))
    path = _folder(spark, "json")
    src.write_json(lots.select("row_id", x.alias("x"), F.col("ts").isNotNull().alias("dated")), path)
    return src.read_json(spark, path, "row_id long, x double, dated boolean")


@query(f"WITH {LOTS} SELECT count(*) AS n, CAST(sum(fail) AS BIGINT) AS n_fail, max(row_id) AS last_row, avg(f000) AS mean_value FROM lots WHERE fail = 1 OR row_id % 2 = 0")
def lots_view_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet table of lots and SQL over its view."""
    path = _folder(spark, "lots")
    src.write_lots(src.lots_events(spark, sf_dir), path)
    src.read_lots(spark, path, "lots_of_the_view")
    return spark.sql("SELECT count(*) AS n, sum(fail) AS n_fail, max(row_id) AS last_row, avg(f000) AS mean_value FROM lots_of_the_view WHERE fail = 1 OR row_id % 2 = 0")


@query(f"""
WITH {LOTS}, n AS (SELECT count(*) AS n FROM lots),
b AS (SELECT CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) + CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS b FROM n)
SELECT CASE WHEN row_id < b THEN 'val' ELSE 'test' END AS "window", row_id, fail AS y, round(f000 / 1000.0, 8) AS p FROM lots, b WHERE row_id >= a""")
def scored_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the windows behind training, as they are kept for reports."""
    parts = backtest.time_split(written(src.lots_events(spark, sf_dir), "lots")).where("part <> 'train'")
    path = _folder(spark, "scored")
    src.write_scored(parts.select(F.col("part").alias("window"), "row_id", F.col("fail").alias("y"), (F.col("f000") / 1000.0).alias("p")), path)
    return spark.read.parquet(path)


@query(f"""
WITH {LOTS}, m AS (SELECT avg(f000) AS a, avg(f001) AS b, avg(f002) AS c FROM lots),
c AS (SELECT unnest(['f000', 'f001', 'f002']) AS feature, unnest([0.002 * (f000 - a), -0.05 * (f001 - b), 0.001 * coalesce(f002 - c, 0)]) AS x FROM lots, m)
SELECT feature, round(avg(abs(x)) * 1000000) / 1000000 AS importance FROM c GROUP BY feature ORDER BY importance DESC, feature LIMIT 2""")
def importance_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that a linear score leans on most, as a CSV table keeps them."""
    lots = src.lots_events(spark, sf_dir)
    ranked = metrics.top_features(metrics.linear_importance(lots, {"f000": 0.002, "f001": -0.05, "f002": 0.001}), 2)
    path = _folder(spark, "ranking")
    src.write_csv(ranked.withColumn("importance", profile.rounded(F.col("importance"), 6)), path)
    return src.read_csv(spark, path, "feature string, importance double")


@query(f"""
WITH {LOTS}, n AS (SELECT count(*) AS n FROM lots), e AS (SELECT max(ts) AS t FROM lots, n WHERE row_id < floor(n * CAST(0.6 AS DOUBLE))),
v AS (SELECT min(ts) AS a, max(ts) AS b FROM lots, n WHERE row_id >= floor(n * CAST(0.6 AS DOUBLE)) AND row_id < floor(n * CAST(0.6 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)))
SELECT 'until train_end' AS slice, count(*) AS n, CAST(sum(fail) AS BIGINT) AS n_fail FROM lots, e WHERE ts <= t
UNION ALL SELECT 'between val_start and val_end', count(*), CAST(sum(fail) AS BIGINT) FROM lots, v WHERE ts BETWEEN a AND b""")
def time_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots by time instead of position: later lots of the same second belong to a slice too."""
    lots = written(src.lots_events(spark, sf_dir), "lots")
    ends = {r["part"]: (r["first_ts"], r["last_ts"]) for r in backtest.split_summary(lots).collect()}  # three rows
    count = lambda df, name: df.agg(F.lit(name).alias("slice"), F.count("*").alias("n"), F.sum("fail").alias("n_fail"))
    return count(backtest.until(lots, ends["train"][1]), "until train_end").unionByName(count(backtest.between(lots, *ends["val"]), "between val_start and val_end"))


@query(f"""
WITH {LOTS}, w AS (SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS n, CAST(sum(fail) AS BIGINT) AS n_fail FROM lots GROUP BY 1)
SELECT * FROM w WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) FROM lots) - INTERVAL 7 DAY""")
def stream_weekly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly rates of a stream of lots, of the weeks that its watermark has passed."""
    lots, rates, checkpoint = (_folder(spark, x) for x in ("stream", "rates", "stream-checkpoint"))
    src.lots_events(spark, sf_dir, numbered=False).select("ts", "fail").coalesce(4).write.parquet(lots)
    monitor.run_available(monitor.weekly_rates(monitor.read_lots(spark, lots)), rates, checkpoint)
    return spark.read.schema("week timestamp, n long, n_fail long").parquet(rates)


STREAM_BREAKEVEN = 1 / 3


@query(f"""
WITH RECURSIVE v AS (
  SELECT o_orderpriority AS line, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS week, count(*) AS n, CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS k FROM orders GROUP BY ALL),
counts AS (SELECT row_number() OVER (ORDER BY n, k) AS id, n, k FROM (SELECT DISTINCT n, k FROM v)),
{bounds_sql("SELECT id, 'lo' AS side, k - 1 AS j, n, CAST(0.975 AS DOUBLE) AS target FROM counts WHERE k > 0 UNION ALL SELECT id, 'hi', k, n, CAST(0.025 AS DOUBLE) FROM counts WHERE k < n")},
ci AS (SELECT n, k, coalesce(max(p) FILTER (side = 'lo'), 0) AS lo, coalesce(max(p) FILTER (side = 'hi'), 1) AS hi FROM counts LEFT JOIN bound USING (id) GROUP BY n, k),
r AS (SELECT line, week, n, k, k / n AS rate, lo, hi, CASE WHEN lo > {STREAM_BREAKEVEN!r} THEN 'inspect' WHEN hi < {STREAM_BREAKEVEN!r} THEN 'no_inspect' ELSE 'undecided' END AS regime FROM v JOIN ci USING (n, k)),
s AS (SELECT *, last_value(CASE WHEN regime <> 'undecided' THEN regime END IGNORE NULLS) OVER (PARTITION BY line ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT line, week, n, k AS n_fail, rate AS fail_rate, round(avg(rate) OVER (PARTITION BY line ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) * 1000000) / 1000000 AS fail_rate_ma4,
       round(lo * 1000000) / 1000000 AS ci_lo, round(hi * 1000000) / 1000000 AS ci_hi, regime, CASE WHEN regime <> 'undecided' THEN regime ELSE before END AS standing,
       coalesce(regime <> 'undecided' AND regime <> before, false) AS flipped FROM s""")
def stream_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of orders in shuffled arrival has told last of every week of each priority, in three micro-batches."""
    lots, told, checkpoint = (_folder(spark, x) for x in ("stream", "told", "stream-checkpoint"))
    o = src.table(spark, sf_dir, "orders")
    arrivals = o.select(F.col("o_orderpriority").alias("line"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "F").cast("int").alias("fail"), F.xxhash64("o_orderkey").alias("h"))
    arrivals.repartition(6, "h").drop("h").write.parquet(lots)
    stream = monitor.read_lots(spark, lots, "line string, ts timestamp, fail int", 2)
    monitor.run_events(monitor.standing_events(stream, STREAM_BREAKEVEN), told, checkpoint)
    return _rounded(monitor.current_events(spark.read.schema(monitor.EVENT).parquet(told)))


def _rounded(events: DataFrame) -> DataFrame:
    return events.withColumns({c: profile.rounded(F.col(c), 6) for c in ("fail_rate_ma4", "ci_lo", "ci_hi")})


@query(f"""
WITH {LOTS}, n AS (SELECT count(*) AS n FROM lots), b AS (SELECT CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) + CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS b FROM n)
SELECT row_id, fail AS y, (SELECT avg(fail) FROM lots, b WHERE row_id < a) AS p FROM lots, b WHERE row_id >= b""")
def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the test lots by the constant model, kept and loaded again."""
    parts = written(backtest.time_split(written(src.lots_events(spark, sf_dir), "lots")), "parts")
    train, val, test = (parts.where(F.col("part") == p) for p in ("train", "val", "test"))
    path = _folder(spark, "model")
    models.fit_one("majority", train, val).save(spark, path)
    return models.Fitted.load(spark, path).score(test)


#: Balanced ridge regression of the training lots by plain descent (ws: weights), as f000 to f002 are the features that stay.
_LOGREG = f"""
{LOTS}, {LONG}, {PARTS},
t AS (SELECT feature, quantile_cont(x, 0.5) AS median FROM long, b WHERE row_id < a GROUP BY feature HAVING count(DISTINCT x) > 1 AND 1 - count(x) / count(*) <= 0.5),
m AS (SELECT feature, any_value(median) AS median, avg(coalesce(x, median)) AS mean, stddev_pop(coalesce(x, median)) AS spread FROM long JOIN t USING (feature), b WHERE row_id < a GROUP BY feature),
z AS (
  SELECT row_id, any_value(fail) AS y, max(z) FILTER (feature = 'f000') AS z0, max(z) FILTER (feature = 'f001') AS z1, max(z) FILTER (feature = 'f002') AS z2
  FROM (SELECT row_id, fail, feature, (coalesce(x, median) - mean) / spread AS z FROM long JOIN m USING (feature)) GROUP BY row_id),
train AS (SELECT z.*, CASE y WHEN 1 THEN n / (2 * k) ELSE n / (2 * (n - k)) END AS w, n FROM z, b, (SELECT count(*) AS n, sum(y) AS k FROM z, b WHERE row_id < a) WHERE row_id < a),
g AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2, CAST(0 AS DOUBLE) AS c
  UNION ALL
  SELECT step + 1, w0 - (g0 + 20 * w0) / r, w1 - (g1 + 20 * w1) / r, w2 - (g2 + 20 * w2) / r, c - gc / r FROM (
    SELECT step, w0, w1, w2, c, sum(e * z0) AS g0, sum(e * z1) AS g1, sum(e * z2) AS g2, sum(e) AS gc, 0.6 * any_value(n) + 20 AS r
    FROM (SELECT g.*, z0, z1, z2, n, w * (1 / (1 + exp(-(w0 * z0 + w1 * z1 + w2 * z2 + c))) - y) AS e FROM g, train WHERE step < 700) GROUP BY step, w0, w1, w2, c)),
ws AS (SELECT * FROM g WHERE step = 700)"""


def _trained(spark: SparkSession, sf_dir: str) -> tuple[models.Fitted, DataFrame]:
    """The logistic model of the training lots, kept and loaded again, and the test lots."""
    parts = written(backtest.time_split(written(src.lots_events(spark, sf_dir), "lots")), "parts")
    train, val, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "val", "test"))
    path = _folder(spark, "model")
    models.fit_one("logreg", train, val).save(spark, path)
    return models.Fitted.load(spark, path), test


@query(f"""
WITH RECURSIVE {_LOGREG}
SELECT unnest(['f000', 'f001', 'f002', 'constant']) AS feature, unnest([round(w0 * 1000000) / 1000000 + 0.0, round(w1 * 1000000) / 1000000 + 0.0, round(w2 * 1000000) / 1000000 + 0.0, round(c * 1000000) / 1000000 + 0.0]) AS weight FROM ws""")
def logreg_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the logistic model, for features measured in spreads; the SQL goes down to the same minimum on another way."""
    fitted, _ = _trained(spark, sf_dir)
    names = [*(fitted.cols[k] for k in fitted.model.scaling.kept), "constant"]
    rows = zip(names, [*fitted.model.curve.weights.tolist(), fitted.model.curve.constant], strict=True)
    return spark.createDataFrame(list(rows), "feature string, weight double").withColumn("weight", profile.rounded(F.col("weight"), 6) + 0.0)


@query(f"""
WITH RECURSIVE {_LOGREG},
sc AS (SELECT row_id, y, 1 / (1 + exp(-(w0 * z0 + w1 * z1 + w2 * z2 + c))) AS p FROM z, ws),
v AS (SELECT y, ln(q / (1 - q)) AS l FROM (SELECT y, greatest(CAST(1e-6 AS DOUBLE), least(1 - CAST(1e-6 AS DOUBLE), p)) AS q FROM sc, b WHERE row_id >= a AND row_id < b.v)),
n AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS slope, CAST(0 AS DOUBLE) AS const
  UNION ALL
  SELECT step + 1, slope - (hbb * gs - hsb * gb) / (hss * hbb - hsb * hsb), const - (hss * gb - hsb * gs) / (hss * hbb - hsb * hsb) FROM (
    SELECT step, slope, const, sum((p - y) * l) + CAST(1e-6 AS DOUBLE) * slope AS gs, sum(p - y) AS gb, sum(p * (1 - p) * l * l) + CAST(1e-6 AS DOUBLE) AS hss, sum(p * (1 - p) * l) AS hsb, sum(p * (1 - p)) AS hbb
    FROM (SELECT step, slope, const, y, l, 1 / (1 + exp(-(slope * l + const))) AS p FROM n, v WHERE step < 25) GROUP BY step, slope, const))
SELECT row_id, y, round(10000 / (1 + exp(-(slope * ln(p / (1 - p)) + const)))) / 10000 AS p FROM sc, b, n WHERE step = 25 AND row_id >= b.v""")
def logreg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated scores of the test lots by the model as loaded; four places, as the slope of a weak score is known to fewer than the score's."""
    fitted, test = _trained(spark, sf_dir)
    return fitted.score(test).withColumn("p", profile.rounded(F.col("p"), 4))

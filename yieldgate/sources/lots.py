"""Sources and sinks: time-ordered tables of lots with a rare failure label and sensor columns.

Feature columns are those whose names are `f` and three or four digits; nothing else is ever taken for a feature.
Missing readings are NULL, never NaN.
"""

from __future__ import annotations

import json
import math
import platform
import re
from importlib import metadata
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldgate.plans.shared import with_row_id

FEATURE = re.compile(r"^f\d{3,4}$")


def feature_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if FEATURE.match(c)]


def raw_feature_cols(df: DataFrame, below: int = 900) -> list[str]:
    """Features that were measured, not derived."""
    return [c for c in feature_cols(df) if int(c[1:]) < below]


def read_sensors(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Space-delimited readings without a header; the literal NaN is missing."""
    schema = T.StructType([T.StructField(f"f{k:03d}", T.DoubleType()) for k in range(n_features)])
    return spark.read.csv(path, sep=" ", schema=schema, nullValue="NaN")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines `label "dd/MM/yyyy HH:mm:ss"`: ts and fail (1 for label 1)."""
    raw = spark.read.csv(path, sep=" ", quote='"', schema="label int, ts string")
    return raw.select(F.to_timestamp("ts", "dd/MM/yyyy HH:mm:ss").alias("ts"), (F.col("label") == 1).cast("tinyint").alias("fail"))


def numbered_lines(df: DataFrame) -> DataFrame:
    """A table read from files with `_line`, the place of each row: files by name, their blocks and lines in order."""
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return with_row_id(placed, "_file", "_block", "_at", name="_line").drop("_file", "_block", "_at")


def zip_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both side by side, by position in their files."""
    return numbered_lines(a).join(numbered_lines(b), "_line")


def write_raw_lots(lots: DataFrame, sensors: str, labels: str, cols: list[str]) -> None:
    """Space-delimited readings (NaN if missing) and labels with times to the second, a line each, in the rows' order."""
    lots.select(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in cols))).write.mode("overwrite").text(sensors)
    label = F.when(F.col("fail") == 1, "1").otherwise("-1")
    lots.select(F.concat(label, F.lit(' "'), F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), F.lit('"'))).write.mode("overwrite").text(labels)


def read_raw_lots(spark: SparkSession, sensors: str, labels: str, n_features: int) -> DataFrame:
    """row_id, ts, fail and features, in time order; lots of one time keep the order of their lines."""
    both = zip_lines(read_labels(spark, labels), read_sensors(spark, sensors, n_features))
    return with_row_id(both, "ts", "_line").drop("_line")


def write_lots(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_lots(spark: SparkSession, path: str, view: str | None = "lots") -> DataFrame:
    """A Parquet table of lots, also as a view for SQL."""
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def clean(value: Any) -> Any:
    """Something that JSON can hold: NaN and infinities are null, keys and dates text."""
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; NaN and infinities are null."""
    doubles = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    df.withColumns(doubles).write.mode("overwrite").json(path, ignoreNullFields=False)


def document(value: Any) -> str:
    """A small result document as text."""
    return json.dumps(clean(value), ensure_ascii=False, indent=2)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_scored(scored: DataFrame, path: str) -> None:
    """window, row_id, y, p with p rounded to 8 places."""
    scored.select("window", "row_id", "y", F.round("p", 8).alias("p")).write.mode("overwrite").parquet(path)


def environment(packages: tuple[str, ...] = ("pyspark", "pandas", "numpy", "pyarrow")) -> dict[str, str]:
    """Versions that a result was made with."""
    return {"python": platform.python_version(), "platform": platform.system(), **{p: metadata.version(p) for p in packages}}


def lock() -> list[str]:
    """Every installed package with its version, as a requirements file pins them."""
    return sorted({f"{d.name}=={d.version}" for d in metadata.distributions() if d.name}, key=str.lower)


def write_environment(spark: SparkSession, path: str) -> None:
    """The record of versions (environment) and the lock file (lock) beside a result, in the shared folder."""
    for name, lines in (("environment", [json.dumps(environment() | {"spark": spark.version}, sort_keys=True)]), ("lock", lock())):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def lock_changes(spark: SparkSession, path: str) -> DataFrame:
    """package, locked, now: packages whose version is not the one that was locked."""
    pins = spark.read.text(f"{path}/lock").select(F.split("value", "==").alias("v"))
    now = spark.createDataFrame([tuple(x.split("==", 1)) for x in lock()], "package string, now string")
    both = pins.select(F.get("v", F.lit(0)).alias("package"), F.get("v", F.lit(1)).alias("locked")).join(now, "package", "full")
    return both.where(~F.col("locked").eqNullSafe(F.col("now")))


def relation(spark: SparkSession, frame: DataFrame | pd.DataFrame, name: str) -> DataFrame:
    """A DataFrame, or a pandas frame in memory, under a name that SQL knows; NaN of a pandas frame is null."""
    if not isinstance(frame, DataFrame):
        made = spark.createDataFrame(frame)
        frame = made.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in made.dtypes if t in ("double", "float")})
    frame.createOrReplaceTempView(name)
    return frame


def page_payload(value: Any) -> str:
    """A document that may stand in a script element of a page."""
    return document(value).replace("<", "\\u003c")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lots_events(spark: SparkSession, sf_dir: str, rare: bool = False, numbered: bool = True) -> DataFrame:
    """Events as lots: errors fail (if rare, only those above 100); f003 is constant and f004 never read.

    Numbering sorts and writes the whole table; what asks for no positions does without.
    """
    e = table(spark, sf_dir, "events")
    failed = (F.col("event_type") == "error") & (F.col("value") > 100 if rare else F.lit(True))
    lots = e.select(
        "ts", "event_id", failed.cast("int").alias("fail"), F.col("value").alias("f000"),
        F.regexp_extract("props", r"-?[0-9]+", 0).cast("double").alias("f001"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("f002"), F.lit(1.0).alias("f003"), F.lit(None).cast("double").alias("f004"),
    )
    return (with_row_id(lots, "ts", "event_id") if numbered else lots).drop("event_id")


def lots_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lots without a position: F orders fail."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") == "F").cast("int").alias("fail"), F.col("o_totalprice").alias("f000"))


def lots_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as lots without a position: returned ones fail, four features, heavy ties."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_shipdate").alias("ts"), (F.col("l_returnflag") == "R").cast("int").alias("fail"), F.col("l_quantity").alias("f000"), F.col("l_extendedprice").alias("f001"), F.col("l_discount").alias("f002"), F.col("l_tax").alias("f003"))


def long_features(df: DataFrame, cols: list[str] | None = None, keep: tuple[str, ...] = ("row_id", "ts", "fail")) -> DataFrame:
    """keep, feature, x: one row for each reading, missing ones too."""
    cols = cols or feature_cols(df)
    return df.select(*keep, *(F.col(c).cast("double").alias(c) for c in cols)).unpivot(list(keep), cols, "feature", "x")

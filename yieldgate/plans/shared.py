"""Tables in the shared folder, and running sums and row numbers that no single task computes alone."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set and all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='yieldgate-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def side_by_side(makes: list[Callable[[], Any]]) -> list[Any]:
    """What each of a few makers gives, their Spark jobs running at the same time."""
    with ThreadPoolExecutor(max(1, len(makes))) as pool:
        return [f.result() for f in [pool.submit(make) for make in makes]]


def once(make: Callable[[], Any]) -> Callable[[], Any]:
    """A maker whose result is made when it is first asked for, and the same for all who ask, in whatever thread."""
    made, lock = [], Lock()

    def get() -> Any:
        with lock:
            if not made:
                made.append(make())
            return made[0]

    return get


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe when executors go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """df with running sums (the row itself included) in `order`, within `keys`.

    Rows are dealt out by ranges of the order and written; every range sums its own rows, and the totals of the ranges
    before it, a table as long as there are ranges, are added. Ties must be broken by `order`.
    """
    keys = keys or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({f"_{k}": e for k, e in sums.items()})
    dealt = written(dealt.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("_part", *keys).agg(*(F.sum(f"_{k}").alias(f"_t_{k}") for k in sums))
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *keys, *(F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums))
    out = dealt.withColumns({k: F.sum(f"_{k}").over(within) for k in sums}).join(F.broadcast(offsets), ["_part", *keys])
    return out.select(*df.columns, *((F.col(k) + F.col(f"_o_{k}")).alias(k) for k in sums))


def with_row_id(df: DataFrame, *order: str, name: str = "row_id") -> DataFrame:
    """df with its rows numbered from 0 in `order`, which must tell rows apart."""
    numbered = running_sums(df, [F.col(c) for c in order], {name: F.lit(1).cast("long")})
    return numbered.withColumn(name, F.col(name) - 1)

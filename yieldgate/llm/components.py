"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Nodes that may be broadcast as hubs (16 bytes each), and the least number of edges of a hub.
HUBS, HUB_EDGES = 100_000, 256


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges (a, b) with m of least (a, m, n_edges); n is the number of all rows of edges.

    A hub's edges do not go to one task: hubs are nodes with more than 1 / HUBS of the edges, so HUBS of them at most,
    and these are broadcast.
    """
    hub = F.col("n_edges") > max(HUB_EDGES, n // HUBS)
    hubs = F.broadcast(least.where(hub).select("a", F.col("m").alias("hub_m")))
    marked = edges.join(hubs, "a", "left")
    others = marked.where("hub_m IS NULL").select("a", "b").join(least.where(~hub).select("a", "m"), "a")
    return marked.where("hub_m IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")).unionByName(others)


def _large(e: DataFrame, n: int) -> DataFrame:
    """Every node's larger neighbours now hang on the least node it knows."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n_edges"))
    return _with_least(both.where("b > a"), least, 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours now hang on the least of these."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_edges"))
    moved = _with_least(down, least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b: long); logarithmic rounds, each one written.

    Raises if edges still change after so many rounds, which 2 ** 60 nodes would not need.
    """
    total = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now = total(e)
    for _ in range(rounds):
        hung = written(_large(e, now[0]), "hung")
        after = written(_small(hung, hung.count()), "edges")
        forget(e, hung)
        e, before, now = after, now, total(after)
        if now == before:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out.written_to = e.written_to  # for forget()
    return out

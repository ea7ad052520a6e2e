"""Connected components of an undirected link table, by alternating large and small stars.

Each round is two aggregations and two joins of the links; a hot centre (a component with very
many members) is pre-aggregated before its shuffle, and its join is one that Spark splits. Rounds grow with
the logarithm of a component's size. Links are written to the shared folder after every round, so that a
lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, what: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: equal types); component is its smallest node. Null ends and loops don't count."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), what)
    mark = _mark(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), what)
        discard(old)
        before, mark = mark, _mark(e)
        if mark == before:
            break
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

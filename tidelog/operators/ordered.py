"""Global order without one task: ranks, running maxima and neighbours over range buckets.

``bucketed`` gives every row the number of its range, from bounds that a bounded sample of the keys sets once and that then are
literals of the plan, so every later use agrees. A range holds a share of the rows whatever their keys are (a hot key is split by the
columns after it). What a row needs from the ranges before its own comes from one row per range; rows and ranges share one exchange, so
the input is computed for the sample and once more.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, MOST = 20, 20_000  # keys sampled for each range, and in all


def _ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sample(df: DataFrame, keys: list[Column], ranges: int) -> list:
    """Key structs of rows picked at random, SAMPLE for each range: one pass that keeps the least random numbers."""
    k = df.select(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(keys))).alias("k"))
    return [r.k for r in k.orderBy(F.rand(11)).limit(min(SAMPLE * ranges, MOST)).collect()]


def skewed(df: DataFrame, key: str) -> bool:
    """Whether some key holds more rows than two even partitions would, by a sample: then its rows must be split."""
    ranges = _ranges(df)
    found = Counter(tuple(k) for k in _sample(df, [F.col(key)], ranges))
    return bool(found) and max(found.values()) > max(4, 2 * sum(found.values()) / max(ranges, 4))


def bounds(df: DataFrame, keys: list[Column], ranges: int | None = None) -> list:
    """Up to ``ranges`` - 1 key structs that cut the rows into even parts."""
    ranges = ranges or _ranges(df)
    if ranges < 2:
        return []
    found = sorted(_sample(df, keys, ranges), key=tuple)
    cuts = [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []
    return [c for i, c in enumerate(cuts) if not i or tuple(c) != tuple(cuts[i - 1])]


def _literal(value) -> Column:
    return F.lit(bytearray(value)) if isinstance(value, (bytes, bytearray)) else F.lit(value)


def _at_least(own: list[str], cut: list[Column]) -> Column:
    """own >= cut, column by column."""
    out = F.lit(True)
    for name, c in reversed(list(zip(own, cut, strict=True))):
        out = (F.col(name) > c) | ((F.col(name) == c) & out)
    return out


def bucketed(df: DataFrame, keys: list[Column], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_p``, the range of its keys (no nulls among them); ranges follow the order of the keys. A binary search within code generation."""
    cuts = bounds(df, keys, ranges)
    if not cuts:
        return df.withColumn("_p", F.lit(0))
    types, names = df.select(*keys).schema, [f"_range_k{i}" for i in range(len(keys))]
    lits = [[_literal(v).cast(t.dataType) for v, t in zip(c, types, strict=True)] for c in cuts]

    def search(low: int, high: int) -> Column:
        """The number of cuts at or below a row, which lies in [low, high]."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(_at_least(names, lits[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    x = df.withColumns(dict(zip(names, keys, strict=True)))
    return x.withColumn("_p", search(0, len(cuts))).drop(*names)


def _shared(x: DataFrame, *aggregates: Column) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by range, and aggregates of each range from the same exchange (a hash that reads every column keeps the two plans alike)."""
    dealt = x.repartition("_p")
    return dealt, dealt.groupBy("_p").agg(*aggregates, F.max(F.xxhash64(*(c for c, t in dealt.dtypes if not t.startswith("map")))).alias("_range_h"))


def _by_range(df: DataFrame, before: DataFrame) -> DataFrame:
    """Rows with what stands before their range: a row for each range at most is broadcast."""
    return df.join(F.broadcast(before), "_p", "left")


def _nothing() -> Column:
    """Zero, by way of the hash of ``_shared``."""
    return F.when(F.col("_range_h").isNull(), 1).otherwise(0)


def ranked(df: DataFrame, keys: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with its dense rank from 0 in the order of the keys; ties in any order."""
    x, sizes = _shared(bucketed(df, keys, ranges), F.count("*").alias("_range_n"))
    n = F.col("_range_n") + _nothing()
    before = sizes.select("_p", F.coalesce(F.sum(n).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_range_base"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*keys))
    return _by_range(x.withColumn("_in_range", own), before).withColumn(name, (F.col("_range_base") + F.col("_in_range") - 1).cast("long")).drop("_p", "_in_range", "_range_base")


def running_max(df: DataFrame, keys: list[Column], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the maximum of ``value`` over all rows before it in the order of the keys (null if there is none)."""
    x, tops = _shared(bucketed(df.withColumn("_range_v", value), keys, ranges), F.max("_range_v").alias("_range_top"))
    top = F.when(_nothing() == 0, F.col("_range_top"))
    before = tops.select("_p", F.max(top).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_in_earlier"))
    own = F.max("_range_v").over(Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    return _by_range(x.withColumn("_in_range", own), before).withColumn(name, F.greatest("_in_range", "_in_earlier")).drop("_p", "_range_v", "_in_range", "_in_earlier")


def with_previous(df: DataFrame, keys: list[Column], kept: Column, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``kept`` of the row just before it in the order of the keys (null at the start)."""
    marked = bucketed(df.withColumn("_range_v", F.struct(kept.alias("x"))), keys, ranges)
    x, last = _shared(marked, F.max_by("_range_v", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(keys)))).alias("_range_last"))
    before = last.select("_p", F.lag(F.when(_nothing() == 0, F.col("_range_last"))).over(Window.orderBy("_p")).alias("_in_earlier"))
    own = F.lag("_range_v").over(Window.partitionBy("_p").orderBy(*keys))
    return _by_range(x.withColumn("_in_range", own), before).withColumn(name, F.coalesce("_in_range", "_in_earlier")["x"]).drop("_p", "_range_v", "_in_range", "_in_earlier")

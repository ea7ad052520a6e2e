"""Latency histograms: mergeable bucket counts and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds in microseconds; what is above goes to one overflow bucket that reports the last bound.
BOUNDS = (5, 10, 25, 50, 100, 250, 500, 1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000)


def observe(samples: DataFrame, column: str) -> DataFrame:
    """(bound, n): partial counts that add up over any split of the samples."""
    bound = F.lit(BOUNDS[-1])
    for b in reversed(BOUNDS):
        bound = F.when(F.col(column) <= b, b).otherwise(bound)
    return samples.groupBy(bound.cast("long").alias("bound")).agg(F.count("*").alias("n"))


def merge(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("bound").agg(F.sum("n").alias("n"))


def percentiles(histogram: DataFrame, ranks: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Least bound that covers rank ceil(p * n / 100), one at least; 0 for an empty histogram. At most 17 rows are put in order."""
    upto = F.sum("n").over(Window.orderBy("bound").rowsBetween(Window.unboundedPreceding, 0))
    x = histogram.select("bound", upto.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return x.agg(*(F.coalesce(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * p / 100)), F.col("bound"))), F.lit(0)).cast("long").alias(f"p{p}") for p in ranks))


def bound_of(us: float) -> int:
    """The bucket of one latency."""
    return next((b for b in BOUNDS if us <= b), BOUNDS[-1])


def rank_of(counts: dict[int, int], rank: int) -> int:
    """A percentile of counts by bound, as ``percentiles`` gives it."""
    total, upto = sum(counts.values()), 0
    for b in sorted(counts):
        upto += counts[b]
        if upto >= max(1, -(-total * rank // 100)):
            return b
    return 0


def throughput(ops: int, bytes_: int, wall_s: float, thread_s: float) -> dict[str, float]:
    return {"ops_per_s": ops / wall_s if wall_s else 0.0, "mb_per_s": bytes_ / (1 << 20) / wall_s if wall_s else 0.0, "avg_us": thread_s / ops * 1e6 if ops else 0.0}

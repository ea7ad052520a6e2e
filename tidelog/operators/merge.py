"""Merging sorted runs: bag union in internal order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def internal_order(backward: bool = False) -> list[Column]:
    """Keys up, newest first; or the exact reverse."""
    up, down = F.col("user_key").asc(), F.col("user_key").desc()
    return [down, F.col("seq").asc(), F.col("kind").asc()] if backward else [up, F.col("seq").desc(), F.col("kind").desc()]


def merge_runs(runs: list[DataFrame], backward: bool = False) -> DataFrame:
    """All rows of all runs, duplicates kept, by a range-partitioned sort."""
    return reduce(lambda a, b: a.unionByName(b), runs).orderBy(*internal_order(backward))

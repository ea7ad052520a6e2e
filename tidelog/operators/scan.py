"""Ordered access to a visible view: seeks, ranges and pages in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forward(view: DataFrame) -> DataFrame:
    return view.orderBy("user_key")


def reverse(view: DataFrame) -> DataFrame:
    return view.orderBy(F.col("user_key").desc())


def seek(view: DataFrame, target) -> DataFrame:
    """First visible key >= target; no row past the end."""
    return view.where(F.col("user_key") >= F.lit(target)).orderBy("user_key").limit(1)


def seek_last(view: DataFrame) -> DataFrame:
    return reverse(view).limit(1)


def range_scan(view: DataFrame, start=None, stop=None, limit: int | None = None, backward: bool = False) -> DataFrame:
    """Keys in [start, stop), in order; None leaves a side open."""
    if start is not None:
        view = view.where(F.col("user_key") >= F.lit(start))
    if stop is not None:
        view = view.where(F.col("user_key") < F.lit(stop))
    ordered = reverse(view) if backward else forward(view)
    return ordered if limit is None else ordered.limit(limit)


def next_page(view: DataFrame, after, size: int) -> DataFrame:
    """The ``size`` keys after a position: keyset paging, a top-k at any depth."""
    return view.where(F.col("user_key") > F.lit(after)).orderBy("user_key").limit(size)


def prev_page(view: DataFrame, before, size: int) -> DataFrame:
    return view.where(F.col("user_key") < F.lit(before)).orderBy(F.col("user_key").desc()).limit(size)


class Cursor:
    """A bidirectional position in a view: starts invalid, stays invalid once it leaves either end (R14). Each move is one top-1 query."""

    def __init__(self, view: DataFrame) -> None:
        self.view, self.row = view, None

    @property
    def valid(self) -> bool:
        return self.row is not None

    def _to(self, rows: DataFrame) -> bool:
        self.row = rows.first()
        return self.valid

    def seek_to_first(self) -> bool:
        return self._to(forward(self.view).limit(1))

    def seek_to_last(self) -> bool:
        return self._to(seek_last(self.view))

    def seek(self, target) -> bool:
        return self._to(seek(self.view, target))

    def next(self) -> bool:
        return self._to(next_page(self.view, self.key, 1))

    def prev(self) -> bool:
        return self._to(prev_page(self.view, self.key, 1))

    @property
    def key(self):
        if self.row is None:
            raise ValueError("the cursor is not on a row")
        return self.row["user_key"]

    @property
    def value(self):
        if self.row is None:
            raise ValueError("the cursor is not on a row")
        return self.row["value"]

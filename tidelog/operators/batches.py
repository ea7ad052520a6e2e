"""Write batches: ordered puts and deletes that get consecutive sequences."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..schema import DELETE, LOG, PUT
from .ordered import ranked

MAX_OPS, MAX_LENGTH = (1 << 32) - 1, (1 << 32) - 1


@dataclass
class MutationBatch:
    """Operations in order; later ones win."""

    ops: list[tuple[int, bytes, bytes | None]] = field(default_factory=list)

    def _add(self, kind: int, key: bytes | None, value: bytes | None) -> MutationBatch:
        key = bytes(key or b"")
        if len(key) > MAX_LENGTH - 8 or len(value or b"") > MAX_LENGTH:
            raise InvalidArgument("key or value too long")
        if len(self.ops) >= MAX_OPS:
            raise InvalidArgument("too many operations in a batch")
        self.ops.append((kind, key, value))
        return self

    def put(self, key: bytes | None, value: bytes | None) -> MutationBatch:
        return self._add(PUT, key, bytes(value or b""))

    def delete(self, key: bytes | None) -> MutationBatch:
        return self._add(DELETE, key, None)

    def append(self, other: MutationBatch) -> MutationBatch:
        for op in other.ops:
            self._add(*op)
        return self

    def clear(self) -> None:
        self.ops.clear()

    def __len__(self) -> int:
        return len(self.ops)

    def visit(self, handler) -> None:
        """Call handler.put(key, value) or handler.delete(key) in order; its first error stops."""
        for kind, key, value in self.ops:
            handler.put(key, value) if kind == PUT else handler.delete(key)

    def to_df(self, spark: SparkSession, base: int) -> DataFrame:
        """Log rows with sequences base, base + 1, ..."""
        return spark.createDataFrame([(k, base + i, kind, v) for i, (kind, k, v) in enumerate(self.ops)], LOG)


def assign_seq(ops: DataFrame, base: int, *order: str) -> DataFrame:
    """Sequences for the ops of many batches: batches in order of ``order``, ops by pos, dense from ``base``.

    Ranges of (batch, pos) are put in order each by itself, so neither many batches nor a huge one meet in one task."""
    return ranked(ops, [F.col(c) for c in (*order, "pos")], "seq").withColumn("seq", F.col("seq") + F.lit(base))


def append_batches(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second batch's ops after the first's."""
    n = first.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_n"))
    return first.unionByName(second.crossJoin(F.broadcast(n)).withColumn("pos", F.col("pos") + F.col("_n")).drop("_n"))  # one row


GROUP_BYTES = 1 << 20


def commit_groups(writes: DataFrame, by: str = "shard", size: str | None = None, limit: int = GROUP_BYTES) -> DataFrame:
    """Writes (``by``, pos, sync) in arrival order to groups that never mix sync and non-sync (M4): islands per queue.

    With a ``size`` column, an island is also cut where its running bytes pass a multiple of ``limit``."""
    order = Window.partitionBy(by).orderBy("pos")
    breaks = F.coalesce((F.lag("sync").over(order) != F.col("sync")).cast("long"), F.lit(1))
    x = writes.withColumn("_b", breaks).withColumn("commit_group", F.sum("_b").over(order)).drop("_b")
    if size is None:
        return x
    island = Window.partitionBy(by, "commit_group").orderBy("pos")
    part = F.floor(F.coalesce(F.sum(size).over(island.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / limit)
    x = x.withColumn("_part", part)
    cut = F.coalesce(((F.lag("commit_group").over(order) != F.col("commit_group")) | (F.lag("_part").over(order) != F.col("_part"))).cast("long"), F.lit(1))
    return x.withColumn("_c", cut).withColumn("commit_group", F.sum("_c").over(order)).drop("_c", "_part")

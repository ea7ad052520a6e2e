"""Snapshot visibility: newest version per key at a sequence, tombstones hidden."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PUT
from .ordered import bucketed, skewed


def at_snapshot(log: DataFrame, as_of: int | None) -> DataFrame:
    """Rows with seq <= as_of; reaches the scan as a pushed filter (P5)."""
    return log if as_of is None else log.where(F.col("seq") <= as_of)


def newest(log: DataFrame, as_of: int | None = None, strategy: str = "window") -> DataFrame:
    """The newest row of each key, deletes included. "window" prunes to one row a key before its shuffle; "agg" merges partial maxima, so a hot key moves one row a task."""
    rows = at_snapshot(log, as_of)
    if strategy == "agg":
        rest = [c for c in rows.columns if c != "user_key"]
        best = rows.groupBy("user_key").agg(F.max_by(F.struct(*rest), F.struct("seq", "kind")).alias("b"))
        return best.select("user_key", "b.*").select(*rows.columns)
    order = Window.partitionBy("user_key").orderBy(F.col("seq").desc(), F.col("kind").desc())
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def visible(log: DataFrame, as_of: int | None = None, strategy: str = "window") -> DataFrame:
    """V(as_of): the tombstone filter stands above the choice of the newest (R2)."""
    return newest(log, as_of, strategy).where(F.col("kind") == PUT)


def get(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """Point lookup: no row if the key is absent or deleted (P1, R20); a top-1, never a sort of the log."""
    rows = at_snapshot(log.where(F.col("user_key") == F.lit(key)), as_of)
    return rows.orderBy(F.col("seq").desc(), F.col("kind").desc()).limit(1).where(F.col("kind") == PUT)


def multi_get(log: DataFrame, probes: DataFrame, split: bool | None = None) -> DataFrame:
    """As-of join of (probe_id, user_key, as_of) probes: the visible value of each, null where there is none.

    Only versions of probed keys take part (a semi join). They and the probes are put in the order of (key, seq), and a probe takes the version
    before it; no pair of a probe and a version is made. Where ``split`` (by default if a sample shows a hot key) that order is cut into ranges, a hot
    key over many of them; a probe with no version in its range takes the newest of its key in the ranges before, of which there is one row a
    key and range."""
    hot = skewed(log, "user_key") if split is None else split
    near = log.join(probes.select("user_key").distinct(), "user_key", "left_semi")
    version = F.struct("seq", "kind", "value")
    rows = near.select("user_key", F.col("seq").alias("_at"), F.lit(0).alias("_ask"), version.alias("_v"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), F.lit(None).cast("long").alias("as_of"))
    asked = probes.select("user_key", F.col("as_of").cast("long").alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast(rows.schema["_v"].dataType).alias("_v"), "probe_id", F.col("as_of").cast("long"))
    x = rows.unionByName(asked)
    if hot:
        x = bucketed(x, [F.col("user_key"), F.col("_at"), F.col("_ask")])
    order = Window.partitionBy(*(["_p"] if hot else []), "user_key").orderBy("_at", "_ask")
    best = x.withColumn("b", F.last("_v", ignorenulls=True).over(order)).where("_ask = 1")
    if hot:
        newest_of = x.where("_ask = 0").groupBy(F.col("user_key").alias("_key"), F.col("_p").alias("_q")).agg(F.max_by("_v", "_at").alias("_old"))
        before = best.where("b is null").select("probe_id", "user_key", "as_of", "_p").join(newest_of, (F.col("user_key") == F.col("_key")) & (F.col("_q") < F.col("_p")), "left")
        late = before.groupBy("probe_id", "user_key", "as_of", "_p").agg(F.max_by("_old", "_q").alias("b"))
        best = best.where("b is not null").select(*late.columns).unionByName(late)
    seen = F.coalesce(F.col("b.kind") == PUT, F.lit(False))
    return best.select("probe_id", "user_key", "as_of", F.when(seen, F.col("b.seq")).alias("seq"), F.when(seen, F.col("b.value")).alias("value"), seen.alias("found"))


def history(log: DataFrame) -> DataFrame:
    """Versions and deletes of each key."""
    return log.groupBy("user_key").agg(F.count("*").alias("versions"), F.sum((F.col("kind") != PUT).cast("long")).alias("deletes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def tombstones(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Keys whose newest version is a delete."""
    return newest(log, as_of).where(F.col("kind") != PUT)

"""Version edits: folding them and what a directory listing says against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALARS = ("log_number", "next_file", "last_sequence")


def fold_scalars(edits: DataFrame) -> DataFrame:
    """Last non-null value of every scalar, by edit_no."""
    return edits.agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("edit_no"))).alias(c) for c in SCALARS))


def fold_runs(actions: DataFrame) -> DataFrame:
    """(edit_no, pos, level, run, action "add"/"delete"): runs whose last action adds them."""
    order = F.struct("edit_no", "pos")
    last = actions.groupBy("level", "run").agg(F.max_by("action", order).alias("action"), F.max_by("size", order).alias("size"))
    return last.where("action = 'add'").drop("action")


def apply_edit(base: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """Base without deleted, with added."""
    return base.join(deleted, ["level", "run"], "left_anti").unionByName(added)


def smallest_snapshot(pins: DataFrame, last_seq: int) -> DataFrame:
    """Oldest pinned sequence, else the last one."""
    return pins.agg(F.coalesce(F.min("seq"), F.lit(last_seq)).alias("smallest_snapshot"))


def parse_names(names: DataFrame) -> DataFrame:
    """(name) to (name, type, number); names of no known form are dropped."""
    digits = r"^(\d{1,19})\.(log|ldb|sst|dbtmp)$"
    kind = F.when(F.col("name").isin("CURRENT", "LOCK"), F.lower("name")).when(F.col("name").isin("LOG", "LOG.old"), F.lit("info")).when(F.col("name").rlike(r"^MANIFEST-\d{1,19}$"), F.lit("manifest"))
    suffix = F.regexp_extract("name", digits, 2)
    kind = kind.when(suffix == "log", F.lit("wal")).when(suffix.isin("ldb", "sst"), F.lit("table")).when(suffix == "dbtmp", F.lit("temp"))
    number = F.expr(r"coalesce(try_cast(nullif(regexp_extract(name, '(\\d+)', 1), '') as bigint), 0)")
    return names.select("name", kind.alias("type"), number.alias("number")).where("type is not null")


def obsolete_names(parsed: DataFrame, live: set[int], pending: set[int], log: int, prev_log: int, manifest: int, pending_manifest: int = 0) -> DataFrame:
    """Files that may go: unreferenced tables and temp files, old logs, old manifests."""
    keep = sorted(live | pending) or [-1]
    number = F.col("number")
    gone = F.when(F.col("type") == "table", ~number.isin(keep)).when(F.col("type") == "wal", (number < log) & (number != prev_log))
    gone = gone.when(F.col("type") == "manifest", number < manifest)
    gone = gone.when(F.col("type") == "temp", ~number.isin(sorted(pending | {pending_manifest}) or [-1]))
    return parsed.where(F.coalesce(gone, F.lit(False)))


def with_prefix_sharing(entries: DataFrame, by: str = "run", restart: int = 16) -> DataFrame:
    """Shared prefix length with the previous key and whether an entry restarts."""
    order = Window.partitionBy(by).orderBy("user_key", F.col("seq").desc())
    x = entries.withColumn("_p", F.lag("user_key").over(order)).withColumn("_i", F.row_number().over(order) - 1)
    shared = F.expr("coalesce(array_max(transform(sequence(0, least(length(user_key), length(_p))), i -> if(left(user_key, i) = left(_p, i), i, 0))), 0)")
    restarts = F.col("_i") % restart == 0
    return x.withColumn("is_restart", restarts).withColumn("shared", F.when(restarts, 0).otherwise(shared).cast("long")).drop("_p", "_i")

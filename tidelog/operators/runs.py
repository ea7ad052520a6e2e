"""Run catalogue: bounds, overlap, closures, boundary runs and level statistics.

A run row is (level, run, size, smallest, largest): one row per stored run, so these tables are small and their
theta joins compare runs, never user rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from .ordered import bounds

LEVELS = 7


def run_meta(log: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Bounds and counts of each run (A2)."""
    return log.groupBy(*by).agg(F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("entries"))


def overlaps(a: str = "a", b: str = "b"):
    return (F.col(f"{a}.smallest") <= F.col(f"{b}.largest")) & (F.col(f"{a}.largest") >= F.col(f"{b}.smallest"))


def overlap_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of runs whose key ranges meet."""
    return left.alias("a").join(right.alias("b"), overlaps())


def overlapping(runs: DataFrame, begin=None, end=None) -> DataFrame:
    """Runs that meet [begin, end]; None is unbounded."""
    if begin is not None:
        runs = runs.where(F.col("largest") >= F.lit(begin))
    return runs if end is None else runs.where(F.col("smallest") <= F.lit(end))


def candidates(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """(user_key) with the columns of every run whose range holds it (P3, P10): both sides meet by ranges of keys, so no pair outside a range is made."""
    keys, runs = _met(keys, runs)
    return keys.join(runs, "_p").where("user_key between smallest and largest").drop("_p")


def _met(keys: DataFrame, runs: DataFrame, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Keys with their range ``_p``, and a row of each run for every range that it meets."""
    cuts = [c[0] for c in bounds(keys, [F.col("user_key")], ranges)]
    at = lambda c: F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda a, x: a + F.when(x <= F.col(c), 1).otherwise(0)) if cuts else F.lit(0)
    return keys.withColumn("_p", at("user_key")), runs.withColumn("_p", F.explode(F.sequence(at("smallest"), at("largest"))))


KEYS, RUNS = 1 << 16, 1 << 10  # about as many keys and filters meet in a task


def filtered(keys: DataFrame, runs: DataFrame, n_keys: int, n_runs: int) -> DataFrame:
    """(run, candidates): how many of the keys in a run's range its Bloom ``filter`` lets through.

    Blocks of keys, by ranges, meet blocks of runs; no pair becomes a row. ``n_keys`` and ``n_runs`` (about) only set the number of blocks."""
    import pyarrow as pa

    blocks = max(1, -(-n_runs // RUNS))
    keys, runs = _met(keys.select(F.col("user_key").cast("binary").alias("user_key")), runs.select("run", *(F.col(c).cast("binary").alias(c) for c in ("smallest", "largest")), "filter"), max(1, -(-n_keys // KEYS)))
    keys = keys.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    runs = runs.withColumn("_b", F.pmod(F.xxhash64("run"), F.lit(blocks)).cast("int"))

    def count(some: pa.Table, held: pa.Table) -> pa.Table:
        n = codec.bloom_counts(sorted(some["user_key"].to_pylist()), list(zip(held["smallest"].to_pylist(), held["largest"].to_pylist(), strict=True)), held["filter"].to_pylist())
        return pa.table({"run": held["run"], "candidates": pa.array(n, pa.int64())})

    met = keys.groupBy("_p", "_b").cogroup(runs.groupBy("_p", "_b")).applyInArrow(count, f"run {dict(runs.dtypes)['run']}, candidates long")
    return met.groupBy("run").agg(F.sum("candidates").alias("candidates")).where("candidates > 0")


def lower_bound(runs: DataFrame, key) -> DataFrame:
    """First run of a sorted level that can hold ``key`` (P11); of those that end at one key the first by its start, then by number."""
    return runs.where(F.col("largest") >= F.lit(key)).orderBy("largest", "smallest", "run").limit(1)


def islands(runs: DataFrame, by: str = "level") -> DataFrame:
    """Transitive closures of overlap within ``by``: a running maximum of ``largest`` and its gaps."""
    order = Window.partitionBy(by).orderBy("smallest", "largest", "run")
    reach = F.max("largest").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce((F.col("smallest") > reach).cast("long"), F.lit(1))
    return runs.withColumn("_gap", gap).withColumn("island", F.sum("_gap").over(order)).drop("_gap")


def closure(runs: DataFrame, begin, end) -> DataFrame:
    """Level-0 runs that meet [begin, end] directly or through each other."""
    marked = islands(runs)
    hit = overlapping(marked, begin, end).select("level", "island").distinct()
    return marked.join(hit, ["level", "island"], "left_semi").drop("island")


def boundary_pairs(runs: DataFrame) -> DataFrame:
    """Runs of a level whose smallest key is another's largest: they must move together."""
    a, b = runs.alias("a"), runs.alias("b")
    return a.join(b, (F.col("a.level") == F.col("b.level")) & (F.col("a.largest") == F.col("b.smallest")) & (F.col("a.run") != F.col("b.run"))).select(F.col("a.level").alias("level"), F.col("a.run").alias("run"), F.col("b.run").alias("next_run"), F.col("a.largest").alias("boundary_key"))


def disjointness_violations(runs: DataFrame) -> DataFrame:
    """Neighbours of levels 1 and up that meet (W8); no row in a sound catalogue."""
    order = Window.partitionBy("level").orderBy("smallest", "run")
    nxt = runs.where("level >= 1").withColumn("next_run", F.lead("run").over(order)).withColumn("next_smallest", F.lead("smallest").over(order))
    return nxt.where(F.col("next_smallest") <= F.col("largest")).select("level", "run", "next_run", "largest", "next_smallest")


def level_stats(runs: DataFrame) -> DataFrame:
    """Runs and bytes of each level that has any (A4)."""
    return runs.groupBy("level").agg(F.count("*").alias("runs"), F.sum("size").alias("bytes"))


def hull(runs: DataFrame) -> DataFrame:
    """Smallest and largest key of a set of runs (A3)."""
    return runs.agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("size").alias("bytes"))


def live(versions: DataFrame) -> DataFrame:
    """Runs that any retained version lists (A7): (version, runs array)."""
    return versions.select(F.explode("runs").alias("run")).distinct()


def missing(live_runs: DataFrame, listing: DataFrame) -> DataFrame:
    """Live runs that the directory lacks."""
    return live_runs.join(listing, "run", "left_anti")


def obsolete(listing: DataFrame, live_runs: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Stored runs that nothing refers to (J8); pending outputs stay."""
    rest = listing.join(live_runs, "run", "left_anti")
    return rest if pending is None else rest.join(pending, "run", "left_anti")

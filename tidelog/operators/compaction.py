"""Compaction: scoring, picking, garbage collection and output cuts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import Options
from ..schema import DELETE
from .ordered import running_max, skewed, with_previous


def max_bytes(level: int, options: Options) -> int:
    """Byte budget of a level >= 1 (F17), saturating at 2^63 - 1."""
    return min(options.base_level_bytes * options.level_multiplier ** max(level - 1, 0), (1 << 63) - 1)


def scores(runs: DataFrame, options: Options) -> DataFrame:
    """(level, score) for levels 0 to 5: runs over trigger at 0, bytes over budget below (A5); absent levels score 0."""
    spark = runs.sparkSession
    spine = spark.createDataFrame([(n, float(max_bytes(n, options)) if n else float(options.l0_compaction)) for n in range(6)], "level int, budget double")
    have = runs.groupBy("level").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    amount = F.when(F.col("level") == 0, F.col("n")).otherwise(F.col("bytes"))
    return spine.join(have, "level", "left").select("level", (F.coalesce(amount, F.lit(0)).cast("double") / F.col("budget")).alias("score"))


def pick_level(runs: DataFrame, options: Options) -> DataFrame:
    """The level with the greatest score, the smallest on ties; it needs compaction from score 1 on."""
    return scores(runs, options).orderBy(F.col("score").desc(), "level").limit(1).withColumn("needed", F.col("score") >= 1)


@dataclass
class Run:
    """One catalogue row on the driver (the catalogue has a row per stored run)."""

    level: int
    run: int
    size: int
    smallest: object
    largest: object
    smallest_seq: int = 0
    largest_seq: int = 0


@dataclass
class Pick:
    """A compaction: inputs of its level and the next, and what the level after holds in their range."""

    level: int
    inputs: list[Run]
    next_inputs: list[Run]
    grandparents: list[Run] = field(default_factory=list)
    pointer: object = None
    options: Options = field(default_factory=Options)

    @property
    def trivial(self) -> bool:
        """A lone run with nothing below it moves by metadata only (V6)."""
        return len(self.inputs) == 1 and not self.next_inputs and sum(g.size for g in self.grandparents) <= 10 * self.options.file_size


def _meets(runs: list[Run], begin, end) -> list[Run]:
    return [r for r in runs if r.smallest <= end and r.largest >= begin]


def _hull(runs: list[Run]):
    return min(r.smallest for r in runs), max(r.largest for r in runs)


def _with_boundaries(level: list[Run], chosen: list[Run]) -> list[Run]:
    """Add runs that begin with an older version of the chosen runs' last key, until none is left."""
    chosen = list(chosen)
    while chosen:
        last = max(chosen, key=lambda r: (r.largest, -r.largest_seq))
        more = [r for r in level if r not in chosen and r.smallest == last.largest and r.smallest_seq < last.largest_seq]
        if not more:
            break
        chosen.append(max(more, key=lambda r: r.smallest_seq))
    return chosen


def pick(catalogue: list[Run], options: Options, pointers: dict[int, object] | None = None) -> Pick | None:
    """Choose a compaction from the catalogue, or None if no score reaches 1 (V3-V5)."""
    by = {n: sorted((r for r in catalogue if r.level == n), key=lambda r: (r.smallest, r.run)) for n in range(8)}
    rated = [(len(by[0]) / options.l0_compaction, 0)] + [(sum(r.size for r in by[n]) / max_bytes(n, options), n) for n in range(1, 6)]
    score, level = max(rated, key=lambda x: (x[0], -x[1]))
    if score < 1:
        return None
    at = (pointers or {}).get(level)
    first = next((r for r in by[level] if at is None or r.largest > at), by[level][0])
    inputs = [first]
    if level == 0:
        begin, end = _hull(inputs)
        while (grown := _meets(by[0], begin, end)) != inputs:
            inputs = grown
            begin, end = _hull(inputs)
    inputs = _with_boundaries(by[level], inputs)
    below = _with_boundaries(by[level + 1], _meets(by[level + 1], *_hull(inputs)))
    if below:
        begin, end = _hull(inputs + below)
        wide = _with_boundaries(by[level], _meets(by[level], begin, end))
        if len(wide) > len(inputs) and sum(r.size for r in wide + below) < 25 * options.file_size:
            again = _with_boundaries(by[level + 1], _meets(by[level + 1], *_hull(wide)))
            if len(again) == len(below):
                inputs, below = wide, again
    begin, end = _hull(inputs + below)
    return Pick(level, inputs, below, _meets(by[level + 2], begin, end), _hull(inputs)[1], options)


KNOWN_RUNS = 10_000  # catalogue rows that the driver joins into intervals


def covered(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of ``keys`` (user_key) that lie in one of ``ranges`` (smallest, largest; one row a run).

    Up to KNOWN_RUNS ranges are joined into disjoint intervals on the driver, and these are broadcast. Beyond, both sides are put in key order over
    ranges of it: a key is covered where the farthest end of the runs begun so far is not before it."""
    few = ranges.select("smallest", "largest").limit(KNOWN_RUNS + 1).collect()
    if len(few) <= KNOWN_RUNS:
        whole: list[list] = []
        for a, b in sorted((r.smallest, r.largest) for r in few):
            if whole and a <= whole[-1][1]:
                whole[-1][1] = max(whole[-1][1], b)
            else:
                whole.append([a, b])
        kind = keys.schema["user_key"].dataType.simpleString()
        intervals = keys.sparkSession.createDataFrame([tuple(x) for x in whole], f"_from {kind}, _to {kind}")
        return keys.join(F.broadcast(intervals), (F.col("user_key") >= F.col("_from")) & (F.col("user_key") <= F.col("_to")), "left_semi").select("user_key")
    points = keys.select("user_key", F.lit(1).alias("_ask"), F.lit(None).cast(keys.schema["user_key"].dataType).alias("_to"))
    starts = ranges.select(F.col("smallest").alias("user_key"), F.lit(0).alias("_ask"), F.col("largest").alias("_to"))
    x = running_max(points.unionByName(starts), [F.col("user_key"), F.col("_ask")], F.col("_to"), "_reach")
    return x.where((F.col("_ask") == 1) & (F.col("_reach") >= F.col("user_key"))).select("user_key")


def collect_garbage(inputs: DataFrame, smallest_snapshot: int, deeper: DataFrame | None = None, split: bool | None = None) -> DataFrame:
    """Input rows with ``reason``: null if kept, "shadowed" if a newer version is visible to every snapshot, "tombstone" if a
    delete is older than every snapshot and no run of ``deeper`` (levels L + 2 and on) can hold its key (W2, J6, R19).

    The next newer version is the row before in internal order: within the key, or over ranges where ``split``
    (by default if a sample shows a hot key), so that a hot key's versions don't meet in one task."""
    if skewed(inputs, "user_key") if split is None else split:
        order = [F.col("user_key"), -F.col("seq"), -F.col("kind").cast("int")]
        rows = with_previous(inputs, order, F.struct("user_key", "seq"), "_prior")
        newer = F.when(F.col("_prior.user_key") == F.col("user_key"), F.col("_prior.seq"))
    else:
        rows = inputs.withColumn("_prior", F.lag("seq").over(Window.partitionBy("user_key").orderBy(F.col("seq").desc(), F.col("kind").desc())))
        newer = F.col("_prior")
    shadowed = F.coalesce(newer <= smallest_snapshot, F.lit(False))
    dead = (F.col("kind") == DELETE) & (F.col("seq") <= smallest_snapshot)
    if deeper is not None:
        doubtful = rows.where(dead & ~shadowed).select("user_key").distinct()
        rows = rows.join(covered(doubtful, deeper).withColumn("_covered", F.lit(True)), "user_key", "left")
        dead = dead & F.col("_covered").isNull()
    reason = F.when(shadowed, "shadowed").when(dead, "tombstone")
    return rows.withColumn("reason", reason).select(*inputs.columns, "reason")


def compact(inputs: DataFrame, smallest_snapshot: int, deeper: DataFrame | None = None) -> DataFrame:
    """What a compaction of ``inputs`` writes (V7); views at and above the snapshot don't change."""
    return collect_garbage(inputs, smallest_snapshot, deeper).where("reason is null").drop("reason")


def block_of(rows: DataFrame, limit: int, by: str = "run", size: str = "size") -> DataFrame:
    """Block numbers by running size within each run: a block is cut where the sum passes a multiple of ``limit`` (W5, approximate)."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(by).orderBy("user_key", F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("block", F.expr("cast(0 as bigint)") + F.floor(before / limit))


def exact_blocks(rows: DataFrame, limit: int, by: str = "run", size: str = "size") -> DataFrame:
    """Blocks cut after the entry whose running size, reset at every cut, reaches ``limit`` (W5, exact): one fold per run."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, block long"

    def cut(pdf):
        pdf = pdf.sort_values(["user_key", "seq"], ascending=[True, False])
        block, held, out = 0, 0, []
        for n in pdf[size]:
            out.append(block)
            held += n
            if held >= limit:
                block, held = block + 1, 0
        return pdf.assign(block=out)

    return rows.groupBy(by).applyInPandas(cut, schema)


class OutputSplitter:
    """Whether an output should end before a key, asked key by key: the per-row form of ``cut_keys``."""

    def __init__(self, grandparents: list[Run], budget: int) -> None:
        self.runs, self.budget, self.at, self.held, self.seen = sorted(grandparents, key=lambda r: r.smallest), budget, 0, 0, False

    def should_stop_before(self, key) -> bool:
        while self.at < len(self.runs) and key > self.runs[self.at].largest:
            if self.seen:
                self.held += self.runs[self.at].size
            self.at += 1
        self.seen = True
        if self.held > self.budget:
            self.held = 0
            return True
        return False


def cut_keys(grandparents: list[Run], budget: int) -> list:
    """Keys after which an output ends, as it has passed more than ``budget`` bytes of the runs two levels down."""
    cuts, held = [], 0
    for k, g in enumerate(sorted(grandparents, key=lambda r: (r.smallest, r.largest))):
        held += g.size if k else 0  # what lies before the first key isn't passed
        if held > budget:
            cuts.append(g.largest)
            held = 0
    return cuts


def in_outputs(rows: DataFrame, outputs: int, cuts: list | None = None) -> DataFrame:
    """``rows`` dealt into key ranges for ``outputs`` files of even size, which are cut again after the ``cuts``; ``out`` numbers them in key
    order (W4, W5). The versions of a key stay together, so outputs are disjoint."""
    after = F.lit(0)
    for c in cuts or []:
        after = after + F.when(F.col("user_key") > F.lit(bytearray(c) if isinstance(c, bytes) else c), 1).otherwise(0)
    dealt = rows.repartitionByRange(max(outputs, 1), "user_key")
    return dealt.withColumn("out", F.spark_partition_id() * (len(cuts or []) + 1) + after)

"""Mixing sources to target weights by capped water-filling.

Sources share a budget by weight; a source stops at ``epochs`` times its size and the excess goes to the
others by weight until none is above. Sorted by cap over weight, the sources that stop are a prefix, so the
level is found in one pass over the source table (one row per source, pre-aggregated; sizes never meet in one
task). A source's target is then met by whole repetitions of all its documents plus a
seeded part: documents in the order of a seeded hash, as long as their words fit into what is left; the one document on
the border is taken in part (or, for rows, if half of it fits).

The border is found without sorting a source: words are summed per (source, first hash byte), then per second byte inside
the border's bucket, and only the documents of that last bucket (1/65536 of a source) are put in order.

Edge cases: a null source is a source of its own, ordered last; null and empty texts have size 0 and take nothing; rows with
equal doc_id and size share one place in the hash order and the ties are ordered as repeated rows; an empty table
gives no rows; extra columns pass through ``mix_rows`` and are ignored by the query. Only DataFrame operations run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARE, EPOCHS, WEIGHTS, SEED = 1.5, 2.0, (3, 1, 2), "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, epochs: float = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source."""
    every = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    below, above = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    x = x.withColumn("level", (F.lit(share) * total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above))
    x = x.withColumn("stops", (F.col("cap") / F.col("weight") <= F.col("level")).cast("int"))
    level = F.max(F.when(F.col("stops") == 0, F.struct(-F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    return x.select("source", "source_size", F.when(F.col("stops") == 1, F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def _source() -> Column:
    """A source as a join key; null is one of its own."""
    return F.struct(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"))


def _border(sums: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """``sums`` (keys, bucket, _n, part) with what stands before a bucket, and whether ``part`` ends in it."""
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("_before", before).withColumn("_border", (F.col("_before") <= F.col("part")) & (F.col("_before") + F.col("_n") > F.col("part")))


def mix(docs: DataFrame, seed: str = SEED, carry: list[str] | None = None, **shares) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, repeats) and the columns to ``carry``: repeats is taken as whole documents, the border one rounded.

    Rows meet what is planned for their source by (source, first hash byte), which deals a hot source over 256 keys; the plan has at most
    256 rows a source."""
    digest = F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    base = docs.select("doc_id", "source", words().alias("size"), *(carry or [])).withColumn("h", digest)
    base = written(base, "sizes").withColumns({"_s": _source(), "b1": F.substring("h", 1, 2), "b2": F.substring("h", 3, 2)})
    sums = written(base.groupBy("source", "b1").agg(F.sum("size").alias("_n")), "sums")
    goal = targets(sums.groupBy("source").agg(F.sum("_n").alias("source_size")), **shares)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("part", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    goal = written(goal, "targets").withColumn("_s", _source()).drop("source")
    one = _border(sums.withColumn("_s", _source()).drop("source").join(goal, "_s"), ["_s"], "b1")
    rest = one.where("_border").select("_s", "b1", (F.col("part") - F.col("_before")).alias("part"))
    inside = base.join(rest, ["_s", "b1"]).groupBy("_s", "b1", "b2", "part").agg(F.sum("size").alias("_n"))
    two = _border(inside, ["_s", "b1"], "b2").where("_border").select("_s", "b1", F.col("b2").alias("c2"), (F.col("part") - F.col("_before")).alias("left"))
    plan = written(one.drop("_n").join(two, ["_s", "b1"], "left"), "plan")
    x = base.join(plan, ["_s", "b1"])
    last = F.coalesce(F.col("b2") == F.col("c2"), F.lit(False))
    sure = (~F.col("_border") & (F.col("_before") < F.col("part"))) | F.coalesce(F.col("_border") & (F.col("b2") < F.col("c2")), F.lit(False))
    far = x.where(~last).withColumn("extra", F.when(sure, F.col("size")).otherwise(F.lit(0)))
    run = F.coalesce(F.sum("size").over(Window.partitionBy("_s").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = x.where(last).withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("left") - run)))
    repeats = F.col("whole") + (2 * F.col("extra") >= F.greatest("size", F.lit(1))).cast("long")
    return far.unionByName(near).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), repeats.alias("repeats"), *(carry or []))


def op5_water_filling(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def mix_rows(docs: DataFrame, **shares) -> DataFrame:
    """``docs`` with each row as often as the mix repeats it (whole documents); columns as before. Every row is decided by itself, whatever its doc_id."""
    names = docs.columns
    inner = [c if c in ("doc_id", "text", "source") else f"_in_{k}" for k, c in enumerate(names)]  # clear of the columns that are made here
    rows = docs.toDF(*inner)
    found = mix(rows, carry=[c for c in inner if c not in ("doc_id", "source")], **shares).where("repeats > 0")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*inner).toDF(*names)

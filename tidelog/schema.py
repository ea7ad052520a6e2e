"""The mutation log: its schema, its checks, and how the driver's tables bind to it.

A log row is (user_key, seq, kind, value): kind 1 puts, kind 0 deletes. Binary keys compare as unsigned
bytes in Spark, which is the default order of the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidArgument

DELETE, PUT = 0, 1
MAX_SEQ = (1 << 56) - 1

LOG = T.StructType(
    [
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("kind", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)


def checked(log: DataFrame) -> DataFrame:
    """Reject rows that no store accepts when they are read: unknown kinds, sequences out of range, values on deletes."""
    fine = F.col("kind").isin(DELETE, PUT) & F.col("seq").between(0, MAX_SEQ) & F.col("user_key").isNotNull()
    seq = F.when(F.coalesce(fine, F.lit(False)), F.col("seq")).otherwise(F.raise_error(F.lit("corrupt log row: kind, seq or key out of range")).cast("long"))
    value = F.when(F.col("kind") == PUT, F.coalesce("value", F.lit(b"")))
    return log.withColumn("seq", seq).withColumn("value", value)


def make_key(number: F.Column | str) -> F.Column:
    """16 decimal digits, so that byte order is number order."""
    c = F.col(number) if isinstance(number, str) else number
    return F.lpad(c.cast("string"), 16, "0")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding E: one mutation per event; errors delete."""
    return table(spark, sf_dir, "events").select(make_key("user_id").alias("user_key"), (F.col("event_id") + 1).alias("seq"), F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("kind"), "value")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding O: one mutation per order; finished orders delete."""
    return table(spark, sf_dir, "orders").select(make_key("o_custkey").alias("user_key"), (F.col("o_orderkey") + 1).alias("seq"), F.when(F.col("o_orderstatus") == "F", DELETE).otherwise(PUT).alias("kind"), F.col("o_totalprice").alias("value"))


def in_runs(log: DataFrame, rows: int = 1000) -> DataFrame:
    """Cut a log into sorted runs of ``rows`` sequences, as flushes would."""
    if rows < 1:
        raise InvalidArgument("a run holds at least one row")
    return log.withColumn("run", F.expr(f"(seq - 1) div {int(rows)}"))

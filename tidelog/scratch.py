"""A folder for what a query stores on the way, on storage that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A path that no other run uses, under ``spark.checkpoint.dir``; under a temporary folder only in local mode where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="tidelog-")
    return f"{where.rstrip('/')}/{what}-{uuid.uuid4().hex}"

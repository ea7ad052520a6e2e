"""The benchmark workloads as set operations, by several workers at once."""

from __future__ import annotations

import argparse
import json
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import histogram, scan
from ..options import Options
from ..schema import make_key
from ..scratch import scratch
from ..store import Store

VALUE, SEED, STEPS = 100, 301, 4  # bytes of a value; steps (jobs) of a worker, whose mean latencies its histogram counts
WORKLOADS = ("fillseq", "fillrandom", "overwrite", "readrandom", "readseq", "readreverse", "compact", "stats", "tables")


def values(n: int = VALUE, compressible: float = 0.5) -> F.Column:
    """``n`` characters of which a share repeats."""
    fresh = max(int(n * compressible), 1)
    return F.substring(F.repeat(F.substring(F.sha2(F.col("id").cast("string"), 512), 1, min(fresh, 128)), -(-n // min(fresh, 128))), 1, n)


def _rows(ids: DataFrame, key: F.Column, size: int, compressible: float) -> DataFrame:
    return ids.select(make_key(key).alias("user_key"), (F.col("id") + 1).alias("seq"), F.lit(1).cast("byte").alias("kind"), values(size, compressible).alias("value"))


def fill_seq(spark: SparkSession, num: int, start: int = 0, size: int = VALUE, compressible: float = 0.5) -> DataFrame:
    return _rows(spark.range(start, start + num), F.col("id"), size, compressible)


def fill_random(spark: SparkSession, num: int, start: int = 0, keys: int | None = None, seed: int = 12345, size: int = VALUE, compressible: float = 0.5) -> DataFrame:
    """Keys below ``keys`` by a congruential step of the row number, so reruns agree."""
    key = ((F.col("id") * 1103515245 + seed) % 2147483648) % (keys or num)
    return _rows(spark.range(start, start + num), key, size, compressible)


def _ingest(store: Store, rows: DataFrame, start: int) -> None:
    store.ingest(rows.select(F.col("user_key").cast("binary").alias("user_key"), (F.col("seq") - 1 - start).alias("seq"), "kind", F.col("value").cast("binary").alias("value")))


class Report:
    """Operations, bytes, misses, and a histogram of latencies in microseconds; reports of workers add up."""

    def __init__(self) -> None:
        self.ops, self.bytes, self.misses, self.thread_s, self.bounds = 0, 0, 0, 0.0, Counter()

    def add(self, ops: int, bytes_: int, seconds: float, misses: int = 0) -> None:
        self.ops, self.bytes, self.misses, self.thread_s = self.ops + ops, self.bytes + bytes_, self.misses + misses, self.thread_s + seconds
        self.bounds[histogram.bound_of(seconds / max(ops, 1) * 1e6)] += ops

    def merge(self, other: Report) -> Report:
        self.ops, self.bytes, self.misses, self.thread_s = self.ops + other.ops, self.bytes + other.bytes, self.misses + other.misses, self.thread_s + other.thread_s
        self.bounds.update(other.bounds)
        return self

    def result(self, wall_s: float) -> dict:
        return {"seconds": wall_s, "ops": self.ops, "misses": self.misses} | histogram.throughput(self.ops, self.bytes, wall_s, self.thread_s) | {f"p{p}_us": histogram.rank_of(self.bounds, p) for p in (50, 95, 99)}


def _work(spark: SparkSession, store: Store, name: str, num: int, worker: int, threads: int, size: int, compressible: float, seed: int) -> Report:
    """What one worker does: ``num`` operations in STEPS jobs (a scan is one)."""
    report, sink = Report(), lambda df: df.write.format("noop").mode("overwrite").save()
    if name in ("readseq", "readreverse", "compact"):
        began = time.time()
        if name == "compact":
            store.maintain()
        else:
            sink((scan.reverse if name == "readreverse" else scan.forward)(store.view()))
        report.add(num, num * (16 + size), time.time() - began)
        return report
    step = -(-num // STEPS)
    for at in range(0, num, step):
        n, start, misses = min(step, num - at), worker * num + at, 0
        began = time.time()
        if name == "fillseq":
            _ingest(store, fill_seq(spark, n, start, size, compressible), start)
        elif name == "readrandom":
            p = fill_random(spark, n, start, num * threads, seed).select(F.col("seq").alias("probe_id"), F.col("user_key").cast("binary").alias("user_key"), F.lit(store.version().last_seq).alias("as_of"))
            misses = store.multi_get(p).agg(F.count_if(~F.col("found")).alias("n")).first().n
        else:
            _ingest(store, fill_random(spark, n, start, num * threads, seed, size, compressible), start)
        report.add(n, (n - misses) * (16 + size), time.time() - began, misses)
    return report


def run(spark: SparkSession, names: list[str], num: int, path: str | None = None, threads: int = 1, size: int = VALUE, compressible: float = 0.5, seed: int = SEED, options: Options | None = None, reuse: bool = False) -> dict[str, dict]:
    """Run workloads in order, each by ``threads`` workers with ``num`` operations; a fill opens a fresh store unless ``reuse``."""
    out, store, fresh = {}, None, 0
    for name in names:
        if name not in WORKLOADS:
            raise ValueError(f"no workload {name}")
        if store is None or (name in ("fillseq", "fillrandom") and not reuse):
            fresh += 1
            store = Store(spark, f"{path}-{fresh}" if path and fresh > 1 else path or scratch(spark, "bench"), options)
        began = time.time()
        if name in ("stats", "tables"):
            out[name] = {"rows": [r.asDict() for r in store.property(name).collect()], "seconds": time.time() - began}  # a row for each level or run
            continue
        workers = 1 if name == "compact" else threads
        with ThreadPoolExecutor(workers) as pool:
            parts = list(pool.map(lambda k: _work(spark, store, name, num, k, workers, size, compressible, seed), range(workers)))  # noqa: B023
        total = Report()
        for p in parts:
            total.merge(p)
        out[name] = total.result(time.time() - began)
    return out


def main() -> None:
    p = argparse.ArgumentParser(description="Benchmark workloads of the store")
    p.add_argument("--benchmarks", default="fillseq,readrandom")
    p.add_argument("--num", type=int, default=100_000)
    p.add_argument("--threads", type=int, default=1)
    p.add_argument("--value-size", type=int, default=VALUE)
    p.add_argument("--compressibility", type=float, default=0.5)
    p.add_argument("--seed", type=int, default=SEED)
    p.add_argument("--reuse", action="store_true", help="fills go into the store that is there")
    p.add_argument("--path")
    for flag in ("write_buffer", "file_size", "block_size", "restart_interval", "max_open_files", "block_cache", "bloom_bits", "l0_compaction", "l0_slowdown", "l0_stop", "level_multiplier", "base_level_bytes", "compact_every"):
        p.add_argument(f"--{flag.replace('_', '-')}", type=int)
    p.add_argument("--compression", choices=("snappy", "none"))
    a = vars(p.parse_args())
    given = {k: a[k] for k in Options.__dataclass_fields__ if a.get(k) is not None}
    spark = SparkSession.builder.getOrCreate()
    print(json.dumps(run(spark, a["benchmarks"].split(","), a["num"], a["path"], a["threads"], a["value_size"], a["compressibility"], a["seed"], Options(**given), a["reuse"])))


if __name__ == "__main__":
    main()

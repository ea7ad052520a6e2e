"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return df.columns.tolist(), sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, duck, name):
    assert rows(queries()[name](spark, SF).toPandas()) == rows(duck.execute(oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_bloom_has_no_false_negatives(spark):
    got = {r.run: r.candidates for r in queries()["bloom_candidates"](spark, SF).collect()}
    from tidelog.schema import events_log, in_runs

    true = {r.run: r.n for r in in_runs(events_log(spark, SF)).selectExpr("run", "user_key").distinct().groupBy("run").count().withColumnRenamed("count", "n").collect()}
    assert all(got[k] >= n for k, n in true.items())


def test_bloom_probes_every_run(spark, tmp_path):
    from tidelog.schema import events_log, in_runs

    keys = spark.range(20_000).selectExpr("id AS event_id", "id * 7919 % 97 AS user_id", "'view' AS event_type", "1.0D AS value")
    kept = spark.read.parquet(f"{SF}/events.parquet")
    keys.select(*[c if c in keys.columns else F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns]).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.run: r.candidates for r in queries()["bloom_candidates"](spark, str(tmp_path)).collect()}
    true = {r.run: r.n for r in in_runs(events_log(spark, str(tmp_path))).selectExpr("run", "user_key").distinct().groupBy("run").count().withColumnRenamed("count", "n").collect()}
    assert len(true) == 20 and got.keys() == true.keys() and all(got[k] >= n for k, n in true.items())


def test_bloom_filters_meet_keys_in_blocks(spark, monkeypatch):
    from tidelog.functions import codec
    from tidelog.operators import runs

    assert "forall" not in queries()["bloom_candidates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()  # no probe by pairs
    monkeypatch.setattr(runs, "KEYS", 100)
    monkeypatch.setattr(runs, "RUNS", 3)
    keys = [b"%04d" % k for k in range(500)]
    held = [(r, *(lambda m: (m[0], m[-1], codec.bloom_build(m)))([b"%04d" % k for k in range(r * 20, r * 20 + 1 + r * 10, 1 + r % 3)])) for r in range(12)]
    got = runs.filtered(spark.createDataFrame([(bytearray(k),) for k in keys], "user_key binary"), spark.createDataFrame([(r, *map(bytearray, x)) for r, *x in held], "run long, smallest binary, largest binary, filter binary"), 500, 12)
    assert {r.run: r.candidates for r in got.collect()} == {r: sum(a <= k <= b and codec.bloom_probe(k, f) for k in keys) for r, a, b, f in held}


def test_lower_bound_of_runs_that_end_alike(spark):
    from tidelog.operators.runs import lower_bound

    rows = [(1, 93, "c", "e"), (1, 53, "b", "e"), (1, 13, "b", "e"), (1, 5, "a", "b"), (1, 1, "f", "g")]
    for given in (rows, rows[::-1]):
        assert lower_bound(spark.createDataFrame(given, "level int, run long, smallest string, largest string").coalesce(1), "d").collect() == [(1, 13, "b", "e")]


def test_merge_covers_the_whole_log(spark):
    from tidelog.schema import events_log

    assert queries()["merge_runs_whole"](spark, SF).select("seq").distinct().count() == events_log(spark, SF).select("seq").distinct().count()

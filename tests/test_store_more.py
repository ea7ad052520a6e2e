"""Pruning, cut compactions, replay, streams, sources, key orders and workloads of the store."""

import logging
import random
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidelog.errors import Corruption, InvalidArgument, NotFound
from tidelog.functions import codec
from tidelog.operators import compaction, ordered, visibility
from tidelog.operators.batches import MutationBatch
from tidelog.options import REVERSE, Options
from tidelog.sources.datasource import VersionEdit, _ManifestWriter, fold_edits, register, whole_edit
from tidelog.sources.tablefile import FilterPolicy, Table, read_block, read_block_backward, read_block_from, write_table
from tidelog.sources.walfile import read_records, write_records
from tidelog.store import open_store
from tidelog.streaming.ingest import ingest_stream, latest_stream

LOG = "user_key binary, seq long, kind int, value binary"


def seen(df):
    return {bytes(r.user_key): bytes(r.value) for r in df.collect()}


def rows(spark, ops):
    return spark.createDataFrame([(bytearray(k), i, int(v is not None), None if v is None else bytearray(v)) for i, (k, v) in enumerate(ops)], LOG)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_ops(rng, n, keys):
    return [(b"k%05d" % rng.randrange(keys), None if rng.random() < 0.2 else b"v%d" % i) for i in range(n)]


def test_reads_prune_runs_and_push_the_snapshot(spark, tmp_path):
    db = open_store(spark, str(tmp_path / "db"), Options(bloom_bits=10))
    for part in (b"a", b"m", b"z"):
        db.ingest(rows(spark, [(part + b"%d" % i, b"x") for i in range(50)]))
    runs = db.version().runs
    assert [len(db.pruned(runs, k, k)) for k in (b"a1", b"m7", b"q")] == [1, 1, 0] and len(db.pruned(runs, as_of=60)) == 2
    mid = db.log(as_of=60)
    assert plan(mid).count("FileScan") == 2 and "LessThanOrEqual(seq,9)" in plan(mid)  # 60 less the second run's base of 51
    assert mid.count() == 60 and db.log(as_of=0).count() == 0
    one = db.scan(b"m1", b"m3")
    assert plan(one).count("FileScan") == 1 and "GreaterThanOrEqual(user_key" in plan(one) and set(seen(one)) == {b"m1", *(b"m1%d" % i for i in range(10)), b"m2", *(b"m2%d" % i for i in range(10))}
    got = visibility.get(db.log(runs=db.pruned(runs, b"z3", b"z3")), bytearray(b"z3"))
    assert "EqualTo(user_key" in plan(got) and db.get(b"z3") == b"x"
    with pytest.raises(NotFound):
        db.get(b"q")


def test_unsound_rows_fail_a_write(spark, tmp_path):
    db = open_store(spark, str(tmp_path / "db"))
    for bad in ([(bytearray(b"k"), 0, 7, bytearray(b"v"))], [(None, 0, 1, bytearray(b"v"))], [(bytearray(b"k"), -1, 1, None)]):
        with pytest.raises(Exception, match="corrupt log row"):
            db.ingest(spark.createDataFrame(bad, LOG))
    db.ingest(spark.createDataFrame([(bytearray(b"k"), 0, 0, bytearray(b"dropped")), (bytearray(b"e"), 1, 1, None)], LOG))
    assert seen(db.view()) == {b"e": b""} and db.log().where("kind = 0").first().value is None


def test_compaction_cuts_outputs(spark, tmp_path):
    rng = random.Random(4)
    options = Options(l0_compaction=2, l0_slowdown=2, l0_stop=3, base_level_bytes=1, file_size=1 << 20, compression="none")
    db, model = open_store(spark, str(tmp_path / "db"), options), {}
    for _ in range(4):
        ops = [(k, None if v is None else v + rng.randbytes(900)) for k, v in random_ops(rng, 3000, 4000)]
        db.ingest(rows(spark, ops))
        model |= dict(ops)
    assert sum(r["level"] == 0 for r in db.version().runs) < 3  # a full level 0 compacts by itself
    while db.compact() and max(r["level"] for r in db.version().runs) < 3:
        pass
    deep = [r for r in db.catalogue() if r.level > 0]
    assert len(deep) > 2 and max(r.size for r in deep) < 2 * (1 << 20)
    for level in {r.level for r in deep}:
        own = sorted((r for r in deep if r.level == level), key=lambda r: r.smallest)
        assert all(a.largest < b.smallest for a, b in zip(own, own[1:], strict=False))
    assert seen(db.view()) == {k: v for k, v in model.items() if v is not None}
    stats = {r.level: r for r in db.property("stats").collect()}
    done = [r for r in stats.values() if r.compactions]
    assert done and all(r.bytes_read > 0 and r.bytes_written > 0 and r.seconds > 0 for r in done)


def test_cut_keys_follow_the_splitter():
    rng = random.Random(1)
    for _ in range(50):
        at, grandparents = 0, []
        for k in range(rng.randrange(12)):
            a = at + rng.randrange(1, 5)
            at = a + rng.randrange(1, 5)
            grandparents.append(compaction.Run(3, k, rng.randrange(1, 9), a, at))
        splitter, budget = compaction.OutputSplitter(grandparents, 10), 10
        first = grandparents[0].smallest if grandparents else 0
        cuts = compaction.cut_keys(grandparents, budget)
        keys = range(first, at + 3)
        by_key = [k for k in keys if splitter.should_stop_before(k)]
        assert len(by_key) >= len(cuts) - 1 and all(c in {g.largest for g in grandparents} for c in cuts)


def test_boundary_runs_move_together(spark, tmp_path):
    a = compaction.Run(1, 1, 10, b"a", b"m", 50, 90)
    b = compaction.Run(1, 2, 10, b"m", b"z", 10, 40)
    picked = compaction.pick([a, b], Options(base_level_bytes=1))
    assert {r.run for r in picked.inputs} == {1, 2}
    db = open_store(spark, str(tmp_path / "db"))
    db.ingest(rows(spark, [(b"k", b"1"), (b"k", b"2")]))
    db.put(b"k", b"3")
    assert [(r.smallest_seq, r.largest_seq) for r in db.catalogue()] == [(1, 2), (3, 3)]


def test_trivial_moves_follow_the_pointer(spark, tmp_path):
    db = open_store(spark, str(tmp_path / "db"), Options(l0_compaction=1, l0_slowdown=1, l0_stop=50, base_level_bytes=1 << 30))
    db.put(b"a", b"1")
    assert db.compact() and [r["level"] for r in db.version().runs] == [1] and db.version().pointers and not db.compact()
    assert db.get(b"a") == b"1"


def test_logs_are_replayed_on_open(spark, tmp_path):
    path = tmp_path / "db"
    db = open_store(spark, str(path))
    db.put(b"a", b"old")
    first = write_records([codec.encode_batch(2, [(1, b"a", b"new"), (1, b"b", b"x")]), codec.encode_batch(4, [(0, b"b", None)])])
    (path / "000003.log").write_bytes(first)
    again = open_store(spark, str(path))
    assert seen(again.view()) == {b"a": b"new"} and again.version().last_seq == 4 and again.version().log_number == 4
    assert again.get(b"b", 3) == b"x" and open_store(spark, str(path)).version().number == again.version().number  # once
    assert "000003.log" in again.vacuum() and again.put(b"c", b"y") == 5
    broken = bytearray(write_records([codec.encode_batch(6, [(1, b"d", b"1")]), codec.encode_batch(7, [(1, b"e", b"2")])]))
    broken[20] ^= 1
    (path / "000009.log").write_bytes(bytes(broken) + write_records([codec.encode_batch(8, [(1, b"f", b"3")])]))
    with pytest.raises(Exception):
        open_store(spark, str(path), Options(paranoid=True))
    skipped = open_store(spark, str(path))
    assert b"d" not in seen(skipped.view()) and skipped.version().log_number == 10
    short = write_records([codec.encode_batch(20, [(1, b"g", b"1")]), codec.encode_batch(21, [(1, b"h", b"2")])])
    (path / "000011.log").write_bytes(short[:-3])
    assert b"g" in seen(open_store(spark, str(path)).view()) and open_store(spark, str(path)).version().last_seq == 20


def test_vacuum_spares_pending_runs(spark, tmp_path):
    db = open_store(spark, str(tmp_path / "db"))
    db.put(b"a", b"1")
    made = db._write_runs(db._checked(rows(spark, [(b"b", b"2")])))  # written, not committed
    assert not [n for n in db.vacuum(grace_s=0) if n.startswith("run-")]  # this handle's own
    other = open_store(spark, str(tmp_path / "db"))
    assert not [n for n in other.vacuum() if n.startswith("run-")]  # younger than the grace
    assert [n for n in other.vacuum(grace_s=0) if n.startswith("run-")] == [made[0]["path"].split("/")[0]] and seen(other.view()) == {b"a": b"1"}


def test_old_manifests_rotate(spark, tmp_path):
    db = open_store(spark, str(tmp_path / "db"), Options(manifest_size=1024))
    for _ in range(15):
        db.snapshot()
    assert len(db._manifests()) == 10 and len(db.version().pins) == 15


def test_streams_have_their_own_batches(spark, tmp_path):
    df = lambda k: spark.createDataFrame([(i, 1, bytearray(b"%d-%d" % (k, i)), bytearray(b"v")) for i in range(3)], "pos long, kind int, user_key binary, value binary")
    db = open_store(spark, str(tmp_path / "db"))
    for k in range(2):
        df(k).write.parquet(str(tmp_path / f"in{k}"))
    read = lambda k: spark.readStream.schema(df(k).schema).parquet(str(tmp_path / f"in{k}"))
    for k, checkpoint in ((0, "a"), (1, "b"), (0, "a"), (0, "replaced")):
        assert ingest_stream(read(k), db, str(tmp_path / checkpoint)).awaitTermination(120)
    assert len(seen(db.view())) == 6 and db.version().last_seq == 9 and len(db.version().streams) == 3
    db.ingest(rows(spark, [(b"x", b"1")]), 5, "s")
    db.ingest(rows(spark, [(b"y", b"1")]), 4, "s")
    assert b"y" not in seen(db.view())


def test_latest_stream(spark, tmp_path):
    rng = random.Random(2)
    every = [(b"k%d" % rng.randrange(5), s, rng.randrange(2), b"v%d" % s) for s in range(60)]
    rng.shuffle(every)
    schema = "user_key binary, seq long, kind int, value binary"
    for k in range(3):
        spark.createDataFrame([(bytearray(a), b, c, bytearray(d)) for a, b, c, d in every[k::3]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = latest_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = {bytes(r.user_key): (r.seq, r.kind, bytes(r.value)) for r in visibility.newest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {k: max((b, c, d) for a, b, c, d in every if a == k) for k in {x[0] for x in every}}


@pytest.mark.parametrize("source", ["kvlog_wal", "kvlog_table"])
def test_appends_add_and_overwrite_replaces(spark, tmp_path, source):
    register(spark)
    path, df = str(tmp_path / "f"), lambda k: spark.createDataFrame([(bytearray(b"%d" % k), k, 1, bytearray(b"v"))], LOG)
    keys = lambda: sorted(bytes(r.user_key) for r in spark.read.format(source).load(path).collect())
    for k in range(3):
        df(k).write.format(source).option("path", path).mode("append").save()
    assert keys() == [b"0", b"1", b"2"]
    df(7).write.format(source).option("path", path).mode("overwrite").save()
    assert keys() == [b"7"]


def test_table_options(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "t")
    log = spark.range(2000).select(F.format_string("k%05d", F.col("id") % 500).cast("binary").alias("user_key"), (F.col("id") + 1).alias("seq"), F.lit(1).alias("kind"), F.lit(b"v").alias("value"))
    log.repartitionByRange(2, "user_key").write.format("kvlog_table").options(path=path, file_size=8000, bloom_bits=10, block_size=1024).mode("append").save()
    read = lambda **o: spark.read.format("kvlog_table").options(**o).load(path)
    assert read().count() == read(split=2000).count() == 2000 and read(split=2000).rdd.getNumPartitions() > read().rdd.getNumPartitions() > 4
    assert read(key=b"k00007".hex()).count() == 4 and read(key=b"k00007".hex(), as_of=600).count() == 2 and read(key=b"none".hex()).count() == 0
    assert read(**{"from": b"k00010".hex(), "to": b"k00019".hex()}).count() == 40 and read(to=b"k00001".hex(), split=2000).count() == 8


def test_blocks_seek_and_go_backward():
    rows_ = [(codec.internal_key(b"key%03d" % (i // 2), 1000 - i, 1), b"%d" % i) for i in range(300)]
    class Even(FilterPolicy):  # noqa: E306
        name = "even"

        def build(self, keys):
            return b"".join(k[-1:] for k in keys if int(k[-1:]) % 2 == 0)

        def probe(self, key, filter_):
            return key[-1:] in filter_

    t = Table(write_table(rows_, block_size=512, policy=Even()), policy=Even())
    assert list(t.backward()) == rows_[::-1] and list(t.entries()) == rows_ and len(t.index) > 5
    block = t.block(*t.index[1][1:])
    own = list(read_block(block))
    assert list(read_block_backward(block)) == own[::-1]
    for k in (own[0][0], own[17][0], own[-1][0], b"zzz"):
        assert list(read_block_from(block, k)) == [x for x in own if x[0] >= k]
    assert t.get(b"key004", 1000) == (1, b"8") and t.get(b"key004", 991) == (1, b"9") and t.get(b"key004", 5) is None and t.get(b"key005", 1000) is None  # the policy says no
    assert Table(write_table(rows_, bloom_bits=10)).get(b"key005", 1000) == (1, b"10")


def test_manifest_sink(spark, tmp_path):
    register(spark)
    edits = [VersionEdit().set(comparator="bytewise", log_number=k, next_file=k + 1, last_sequence=9 * k).add(0, k, 5, b"a%d" % k, b"b%d" % k).set_pointer(1, b"p%d" % k) for k in range(1, 30)]
    edits[20].remove(0, 3)
    edits = [e.build() for e in edits]
    with pytest.raises(InvalidArgument):
        VersionEdit().set(colour=1)
    schema = spark.read.format("kvlog_manifest").load(str(tmp_path)).schema
    data = [(0, n, e["comparator"], e["log_number"], None, e["next_file"], e["last_sequence"], e["deleted"], [(*x[:3], bytearray(x[3]), bytearray(x[4])) for x in e["added"]], [(n_, bytearray(k)) for n_, k in e["pointers"]]) for n, e in enumerate(edits)]
    spark.createDataFrame(data, schema).coalesce(1).write.format("kvlog_manifest").options(path=str(tmp_path / "m"), manifest_size=300).mode("append").save()
    names = sorted(p.name for p in (tmp_path / "m").glob("MANIFEST-*"))
    assert len(names) > 2 and (tmp_path / "m" / "CURRENT").read_text() == names[-1] + "\n"
    last = [codec.decode_edit(r) for r, _ in read_records((tmp_path / "m" / names[-1]).read_bytes(), True)]
    assert fold_edits(last) == fold_edits(edits) == fold_edits([whole_edit(edits)]) and (0, 3) not in fold_edits(last)["runs"] and fold_edits(last)["pointers"] == {1: b"p29"}
    db = open_store(spark, str(tmp_path / "db"))
    db.put(b"k", b"v")
    assert fold_edits(db.manifest_edits())["last_sequence"] == 1


def test_small_tables_share_partitions(spark, tmp_path):
    """Tasks don't grow with the number of small files, and writers do with the rows."""
    register(spark)
    rows = spark.range(6000).selectExpr("cast(lpad(id, 8, '0') as binary) as user_key", "id as seq", "cast(id % 2 as byte) as kind", "if(id % 2 = 1, cast(cast(id as string) as binary), null) as value")
    for source in ("kvlog_table", "kvlog_wal"):
        rows.repartitionByRange(2, "user_key").write.format(source).options(path=str(tmp_path / source), file_size=500).mode("append").save()
        back = spark.read.format(source).load(str(tmp_path / source))
        assert len(list((tmp_path / source).iterdir())) > 200 and 16 < back.rdd.getNumPartitions() < 70
        assert not back.drop("file").exceptAll(rows).count() and back.count() == 6000


def test_long_checksums():
    for n in (255, 256, 300, 4096, 4097, 4099, 4100, 9001):
        data = random.Random(n).randbytes(n)
        parts = 0
        for k in range(0, n, 100):
            parts = codec.crc32c(data[k : k + 100], parts)
        assert codec.crc32c(data) == parts
        assert codec.crc32c(data[200:], codec.crc32c(data[:200])) == parts


def test_manifests_grow_with_their_edits():
    """Many small rotations: the files together stay within a few times the edits, and the last says all."""
    edits = [VersionEdit().set(comparator="bytewise", log_number=1, next_file=k + 1, last_sequence=k).add(k % 3, k, 5, b"a%08d" % k, b"b%08d" % k).build() for k in range(3000)]
    rows = [Row(edit_no=n, prev_log_number=None, **e) for n, e in enumerate(edits)]
    files = [b"".join(f) for f in _ManifestWriter({"path": "", "manifest_size": 200}, False).files(rows)]
    assert 5 < len(files) < 30 and sum(map(len, files)) < 5 * sum(len(codec.encode_edit(e)) for e in edits)
    assert fold_edits([codec.decode_edit(r) for r, _ in read_records(files[-1], True)]) == fold_edits(edits)


def test_key_orders(spark, tmp_path):
    db = open_store(spark, str(tmp_path / "db"), Options(comparator=REVERSE))
    keys = [b"", b"a", b"a\x00", b"ab", b"b", b"\xff", b"\xff\xff"]
    db.ingest(rows(spark, [(k, b"v" + k) for k in keys]))
    assert [bytes(r.user_key) for r in db.scan().collect()] == sorted(keys, reverse=True)
    assert [bytes(r.user_key) for r in db.scan(b"b", b"a").collect()] == [b"b", b"ab", b"a\x00"] and db.get(b"ab") == b"vab"
    with pytest.raises(InvalidArgument):
        open_store(spark, str(tmp_path / "db"))
    assert seen(open_store(spark, str(tmp_path / "db"), Options(comparator="reverse-bytewise")).view()) == {k: b"v" + k for k in keys}


def test_logger(spark, tmp_path, caplog):
    with caplog.at_level(logging.INFO, "tidelog"):
        db = open_store(spark, str(tmp_path / "db"))
        db.vacuum()
    assert any("opened" in r.message for r in caplog.records) and any("removed" in r.message for r in caplog.records)


def test_skew_is_seen(spark):
    even = spark.range(4000).selectExpr("id % 50 AS k")
    assert not ordered.skewed(even, "k") and ordered.skewed(even.union(spark.range(6000).selectExpr("7L AS k")), "k") and not ordered.skewed(even.limit(0), "k")


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_order_over_ranges(spark, ranges):
    rng = random.Random(ranges)
    data = [(rng.choice([3, rng.randrange(50)]), i, rng.choice([None, rng.randrange(100)])) for i in range(400)]
    df, keys = spark.createDataFrame(data, "k int, i int, v int"), [F.col("k"), F.col("i")]
    order = sorted(data)
    assert {r.i: r.at for r in ordered.ranked(df, keys, "at", ranges).collect()} == {x[1]: n for n, x in enumerate(order)}
    tops, best = {}, None
    for x in order:
        tops[x[1]] = best
        best = x[2] if best is None else best if x[2] is None else max(best, x[2])
    assert {r.i: r.m for r in ordered.running_max(df, keys, F.col("v"), "m", ranges).collect()} == tops
    assert {r.i: r.b for r in ordered.with_previous(df, keys, F.col("i"), "b", ranges).collect()} == {x[1]: (order[n - 1][1] if n else None) for n, x in enumerate(order)}
    if ranges > 2:
        assert ordered.bucketed(df, keys, ranges).where("k = 3").select("_p").distinct().count() > 1  # a hot key is split
    assert ordered.ranked(df.limit(0), keys, "at", ranges).count() == 0


@pytest.mark.parametrize("split", [True, False])
def test_multi_get_against_a_model(spark, split):
    rng = random.Random(9)
    log = [(b"k%d" % rng.choice([1, rng.randrange(30)]), s, rng.randrange(2), b"v%d" % s) for s in range(1, 300)]
    probes = [(p, b"k%d" % rng.choice([1, rng.randrange(35)]), rng.randrange(0, 310)) for p in range(200)]
    df = spark.createDataFrame([(bytearray(k), s, c, bytearray(v)) for k, s, c, v in log], LOG)
    got = {r.probe_id: (r.found, r.seq, r.value and bytes(r.value)) for r in visibility.multi_get(df, spark.createDataFrame([(p, bytearray(k), s) for p, k, s in probes], "probe_id long, user_key binary, as_of long"), split).collect()}
    for p, k, at in probes:
        best = max((x for x in log if x[0] == k and x[1] <= at), key=lambda x: x[1], default=None)
        assert got[p] == ((True, best[1], best[3]) if best and best[2] else (False, None, None))
    assert len(got) == len(probes)


@pytest.mark.parametrize("split", [True, False])
def test_collect_garbage_against_a_model(spark, monkeypatch, split):
    monkeypatch.setattr(compaction, "KNOWN_RUNS", 0 if split else 10)
    rng = random.Random(3)
    log = [(b"k%02d" % rng.choice([1, rng.randrange(20)]), s, rng.randrange(2), b"v") for s in range(1, 250)]
    deep = [(b"k03", b"k07"), (b"k05", b"k05"), (b"k12", b"k13")]
    df = spark.createDataFrame([(bytearray(k), s, c, bytearray(v)) for k, s, c, v in log], LOG)
    ranges = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in deep], "smallest binary, largest binary")
    got = {r.seq: r.reason for r in compaction.collect_garbage(df, 120, ranges, split).collect()}
    for k, s, c, _ in log:
        newer = min((x[1] for x in log if x[0] == k and x[1] > s), default=None)
        want = "shadowed" if newer is not None and newer <= 120 else "tombstone" if c == 0 and s <= 120 and not any(a <= k <= b for a, b in deep) else None
        assert got[s] == want


def test_workers_and_options(spark, tmp_path):
    from tidelog.plans.workloads import run

    out = run(spark, ["fillrandom", "overwrite", "compact", "readrandom", "stats"], 400, str(tmp_path / "b"), threads=2, size=50, options=Options(bloom_bits=10, compact_every=4))
    assert out["fillrandom"]["ops"] == out["readrandom"]["ops"] == 800 and out["readrandom"]["misses"] < 800 and out["stats"]["rows"]
    assert out["overwrite"]["p50_us"] <= out["overwrite"]["p99_us"] and out["overwrite"]["mb_per_s"] > 0
    with pytest.raises(ValueError):
        run(spark, ["nope"], 1, str(tmp_path / "c"))


def test_corrupt_manifest_and_missing_runs(spark, tmp_path):
    db = open_store(spark, str(tmp_path / "db"))
    db.write(MutationBatch().put(b"a", b"1"))
    db.files.delete(db.version().runs[0]["path"].split("/")[0])
    with pytest.raises(Corruption, match="missing"):
        open_store(spark, str(tmp_path / "db"))
    assert struct.calcsize("<Q") == 8

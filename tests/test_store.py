"""The store end to end, and streaming into it."""

import pytest

from tidelog.errors import InvalidArgument, NotFound
from tidelog.operators.batches import MutationBatch
from tidelog.options import Options
from tidelog.store import open_store


def seen(df):
    return {bytes(r.user_key): bytes(r.value) for r in df.collect()}


def test_basics(spark, tmp_path):
    db = open_store(spark, str(tmp_path / "db"))
    db.put(b"key1", b"some value")
    db.put(b"", b"empty key")
    snap = db.snapshot()
    last = db.write(MutationBatch().put(b"key1", b"new value").put(b"key2", b"").delete(b""))
    assert last == 5 and db.write(MutationBatch()) == 5
    assert db.get(b"key1") == b"new value" and db.get(b"key2") == b"" and db.get(b"key1", snap.seq) == b"some value"
    with pytest.raises(NotFound):
        db.get(b"")
    assert seen(db.view(snap.seq)) == {b"key1": b"some value", b"": b"empty key"}
    assert [bytes(r.user_key) for r in db.scan(backward=True).collect()] == [b"key2", b"key1"]
    snap.release()
    again = open_store(spark, str(tmp_path / "db"))
    assert seen(again.view()) == {b"key1": b"new value", b"key2": b""}
    assert again.property("num-files-at-level0").first().files == 3
    assert again.property("num-files-at-level7") is None and again.property("nope") is None
    assert again.property("stats").first().entries == 5
    for bad in (Options(error_if_exists=True), Options(comparator="other")):
        with pytest.raises(InvalidArgument):
            open_store(spark, str(tmp_path / "db"), bad)
    with pytest.raises(InvalidArgument):
        open_store(spark, str(tmp_path / "none"), Options(create_if_missing=False))


def test_compaction_keeps_snapshots(spark, tmp_path):
    db = open_store(spark, str(tmp_path / "db"))
    db.put(b"k", b"v")
    with db.snapshot() as snap:
        db.delete(b"k")
        for i in range(3):
            db.put(b"k%d" % i, b"x")
        while db.compact():
            pass
        assert db.get(b"k", snap.seq) == b"v"
        with pytest.raises(NotFound):
            db.get(b"k")
    assert db.property("num-files-at-level0").first().files < 4
    assert db.vacuum() and seen(db.view()) == {b"k%d" % i: b"x" for i in range(3)}


def test_stream_ingest(spark, tmp_path):
    from tidelog.streaming.ingest import ingest_stream

    rows = [(i, 1, bytearray(b"k%d" % (i % 3)), bytearray(b"v%d" % i)) for i in range(9)]
    df = spark.createDataFrame(rows, "pos long, kind int, user_key binary, value binary")
    df.write.parquet(str(tmp_path / "in"))
    db = open_store(spark, str(tmp_path / "db"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        q = ingest_stream(stream, db, str(tmp_path / "ck"))
        assert q.awaitTermination(120)
    assert seen(db.view()) == {b"k0": b"v6", b"k1": b"v7", b"k2": b"v8"} and db.version().last_seq == 9


def test_workloads(spark):
    from tidelog.plans.workloads import run

    out = run(spark, ["fillseq", "readseq", "readreverse", "readrandom"], 2000)
    assert set(out) == {"fillseq", "readseq", "readreverse", "readrandom"} and out["fillseq"]["ops_per_s"] > 0

"""Golden tables for snapshots, scans, merges and batches."""

import pytest

from tidelog.operators import batches, merge, scan, visibility
from tidelog.operators.batches import MutationBatch
from tidelog.schema import LOG


def log(spark, *rows):
    """Rows as (key, seq, value), a value of None deletes."""
    return spark.createDataFrame([(bytearray(k.encode()), s, int(v is not None), None if v is None else bytearray(v.encode())) for k, s, v in rows], LOG)


def seen(df):
    return {bytes(r.user_key).decode(): bytes(r.value).decode() for r in df.collect()}


ABC = [("a", 1, "1"), ("a", 2, "2"), ("b", 3, None), ("b", 4, "4"), ("c", 5, None), ("c", 6, "6")]
KM = [("k", 1, "v1"), ("k", 2, None), ("k", 3, "v3"), ("m", 1, "m1")]
MERGED = [("a", 1, "a1"), ("b", 5, "b5"), ("d", 2, "d2"), ("a", 3, "a3"), ("b", 4, None), ("c", 6, "c6")]


@pytest.mark.parametrize("strategy", ["window", "agg"])
@pytest.mark.parametrize(
    "rows,as_of,expected",
    [
        (ABC, 4, {"a": "2", "b": "4"}),
        (ABC, 5, {"a": "2", "b": "4"}),
        (ABC, 6, {"a": "2", "b": "4", "c": "6"}),
        (KM, 0, {}),
        (KM, 1, {"k": "v1", "m": "m1"}),
        (KM, 2, {"m": "m1"}),
        (KM, 3, {"k": "v3", "m": "m1"}),
        (MERGED, 6, {"a": "a3", "b": "b5", "c": "c6", "d": "d2"}),
        (MERGED, 4, {"a": "a3", "d": "d2"}),
        (ABC, None, {"a": "2", "b": "4", "c": "6"}),
    ],
)
def test_visible(spark, strategy, rows, as_of, expected):
    assert seen(visibility.visible(log(spark, *rows), as_of, strategy)) == expected


TRAVEL = [("a", 1, "1"), ("b", 2, "@"), ("c", 3, "3"), ("cc", 4, "33"), ("b", 5, "2"), ("cc", 6, None), ("d", 7, "4"), ("e", 8, "5")]


def test_ordered_traversal(spark):
    v = visibility.visible(log(spark, *TRAVEL)).select("user_key", "value")
    keys = lambda df: [bytes(r.user_key).decode() for r in df.collect()]
    assert keys(scan.forward(v)) == list("abcde")
    assert keys(scan.reverse(v)) == list("edcba")
    for target, found in (("c", ["c"]), ("A", ["a"]), ("cc", ["d"]), ("z", [])):
        assert keys(scan.seek(v, bytearray(target.encode()))) == found
    assert keys(scan.next_page(v, bytearray(b"b"), 2)) == ["c", "d"]
    assert keys(scan.prev_page(v, bytearray(b"d"), 2)) == ["c", "b"]
    assert keys(scan.range_scan(v, bytearray(b"b"), bytearray(b"d"))) == ["b", "c"]


def test_cursor(spark):
    c = scan.Cursor(visibility.visible(log(spark, *TRAVEL)).select("user_key", "value").cache())
    assert not c.valid
    with pytest.raises(ValueError):
        _ = c.key
    assert c.seek(bytearray(b"b")) and c.prev() and bytes(c.key) == b"a" and c.next() and bytes(c.value) == b"2"
    assert c.seek_to_last() and not c.next() and not c.valid
    assert c.seek_to_first() and not c.prev() and not c.valid


def test_get_and_history(spark):
    rows = log(spark, *KM, ("", 9, "empty"))
    assert visibility.get(rows, bytearray(b"k"), 2).count() == 0
    assert seen(visibility.get(rows, bytearray(b""))) == {"": "empty"}
    assert {bytes(r.user_key): (r.versions, r.deletes) for r in visibility.history(rows).collect()}[b"k"] == (3, 1)
    probes = spark.createDataFrame([(1, bytearray(b"k"), 1), (2, bytearray(b"k"), 2), (3, bytearray(b"q"), 9)], "probe_id long, user_key binary, as_of long")
    assert {r.probe_id: r.value and bytes(r.value) for r in visibility.multi_get(rows, probes).collect()} == {1: b"v1", 2: None, 3: None}


def test_merge_keeps_duplicates(spark):
    a, b = log(spark, ("a", 1, "x"), ("b", 2, "y")), log(spark, ("a", 1, "x"), ("a", 3, "z"))
    assert [(bytes(r.user_key), r.seq) for r in merge.merge_runs([a, b]).collect()] == [(b"a", 3), (b"a", 1), (b"a", 1), (b"b", 2)]
    assert [(bytes(r.user_key), r.seq) for r in merge.merge_runs([a, b], backward=True).collect()] == [(b"b", 2), (b"a", 1), (b"a", 1), (b"a", 3)]


def test_batches(spark):
    b = MutationBatch().put(b"k", b"v1").delete(b"k").put(b"k", b"v2").delete(b"k")
    rows = b.to_df(spark, 7)
    for as_of, value in ((10, {}), (9, {"k": "v2"}), (8, {}), (7, {"k": "v1"}), (6, {})):
        assert seen(visibility.visible(rows, as_of)) == value
    b.append(MutationBatch().put(b"k", b"v3"))
    assert seen(visibility.visible(b.to_df(spark, 7), 11)) == {"k": "v3"}
    seen_ops = []

    class Handler:
        def put(self, key, value):
            seen_ops.append(("put", key, value))

        def delete(self, key):
            seen_ops.append(("delete", key))

    b.visit(Handler())
    assert seen_ops[1] == ("delete", b"k") and len(seen_ops) == 5
    b.clear()
    assert not len(b)


def test_commit_groups(spark):
    rows = spark.createDataFrame([(0, 0, True), (0, 1, True), (0, 2, False), (0, 3, True)], "shard int, pos int, sync boolean")
    assert [r.commit_group for r in batches.commit_groups(rows).orderBy("pos").collect()] == [1, 1, 2, 3]

"""Run catalogue, picking, garbage collection, and the law that compaction keeps every view at and above its snapshot."""

import random

import pytest

from tidelog.errors import InvalidArgument
from tidelog.operators import compaction, histogram, runs, versions, visibility
from tidelog.operators.compaction import OutputSplitter, Run, pick
from tidelog.options import Options

O = Options(base_level_bytes=1000)  # noqa: E741


def cat(level, *ranges, first=1, size=400):
    return [Run(level, first + i, size, a, b) for i, (a, b) in enumerate(ranges)]


def test_closure(spark):
    rows = spark.createDataFrame([(0, 1, "a", "c"), (0, 2, "b", "e"), (0, 3, "d", "g"), (0, 4, "x", "z")], "level int, run int, smallest string, largest string")
    assert sorted(r.run for r in runs.closure(rows, "a", "c").collect()) == [1, 2, 3]


def numbers(x):
    return sorted(r.run for r in x)


def test_pick_level_zero():
    p = pick(cat(0, ("a", "c"), ("b", "e"), ("k", "l"), ("m", "n")) + cat(1, ("a", "d"), ("x", "z"), first=11), O)
    assert numbers(p.inputs) == [1, 2] and numbers(p.next_inputs) == [11] and p.pointer == "e"


def test_pick_resumes_and_wraps():
    c = cat(1, ("a", "b"), ("c", "d"), ("e", "f")) + cat(2, ("c", "c"), ("d", "e"), ("x", "z"), first=21)
    p = pick(c, O, {1: "b"})
    assert numbers(p.inputs) == [2, 3] and numbers(p.next_inputs) == [21, 22]
    assert numbers(pick(c, O, {1: "zz"}).inputs)[0] == 1


@pytest.mark.parametrize("below,inputs,nexts", [([("b", "e")], [1, 2], [3]), ([("b", "c"), ("e", "g")], [1], [3])])
def test_expansion(below, inputs, nexts):
    p = pick(cat(1, ("a", "c"), ("d", "f"), size=600) + cat(2, *below, first=3, size=100), O)
    assert numbers(p.inputs) == inputs and numbers(p.next_inputs) == nexts


def test_grandparents_and_trivial_move():
    p = pick(cat(1, ("a", "c"), size=2000) + cat(2, ("b", "d"), first=2) + cat(3, ("a", "b"), ("c", "e"), ("x", "z"), first=3), O)
    assert numbers(p.grandparents) == [3, 4] and not p.trivial
    assert pick(cat(1, ("a", "b"), size=2000), O).trivial
    wide = Options(base_level_bytes=1 << 20)
    assert not pick(cat(1, ("a", "b"), size=2 << 20) + cat(3, ("a", "b"), ("b", "b"), first=5, size=25 << 20), wide).trivial


def test_pick_needs_a_score_of_one():
    assert pick(cat(0, ("a", "b"), ("c", "d")), O) is None
    assert pick(cat(6, ("a", "b"), size=1 << 40), O) is None
    assert pick(cat(0, ("a", "b"), ("c", "d")) + cat(1, ("a", "b"), first=9, size=1500), O).level == 1


def test_boundary_run():
    a, b = Run(1, 1, 2000, "a", "b", 5, 2), Run(1, 2, 10, "b", "c", 1, 9)
    assert numbers(pick([a, b], O).inputs) == [1, 2]


def test_output_splitter():
    s = OutputSplitter([Run(3, 1, 5, "a", "c"), Run(3, 2, 6, "d", "f")], 10)
    assert [s.should_stop_before(k) for k in "bdg"] == [False, False, True]


def gc(spark, rows, s0, deeper=None):
    df = spark.createDataFrame([(k, q, int(v is not None), v) for k, q, v in rows], "user_key string, seq long, kind int, value string")
    d = None if deeper is None else spark.createDataFrame(deeper, "smallest string, largest string")
    return sorted((r.user_key, r.seq) for r in compaction.compact(df, s0, d).collect())


def test_collect_garbage(spark):
    assert gc(spark, [("alpha", 9, "v"), ("victim", 7, "new"), ("victim", 5, "old")], 100) == [("alpha", 9), ("victim", 7)]
    assert gc(spark, [("victim", 7, None)], 100, [("victim", "victim")]) == [("victim", 7)]
    assert gc(spark, [("victim", 7, None)], 100, [("a", "c")]) == []
    assert gc(spark, [("k", 2, None), ("k", 1, "v")], 1) == [("k", 1), ("k", 2)]


def test_views_survive_compaction(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abcdefgh"), q, int(rng.random() < 0.7), q) for q in range(1, 300)]
    df = spark.createDataFrame(rows, "user_key string, seq long, kind int, value long").cache()
    out = compaction.compact(df, 150).cache()

    def view(log, s):
        return sorted((r.user_key, r.value) for r in visibility.visible(log, s).collect())

    for s in (150, 200, 299):
        model = {}
        for k, q, kind, v in rows:
            if q <= s:
                model[k] = (kind, v)
        assert view(df, s) == view(out, s) == sorted((k, v) for k, (kind, v) in model.items() if kind)


def test_options():
    o = Options(write_buffer=1024)
    assert o.write_buffer == 64 << 10 and o.base_level_bytes == 4 * o.write_buffer
    assert (Options().l0_compaction, Options().l0_slowdown, Options().l0_stop) == (4, 8, 12)
    for bad in (dict(l0_compaction=13), dict(l0_compaction=9, l0_slowdown=3), dict(l0_compaction=4, l0_slowdown=9, l0_stop=5)):
        with pytest.raises(InvalidArgument):
            Options(**bad)
    Options(l0_compaction=4, l0_slowdown=6, l0_stop=9)


@pytest.mark.parametrize(
    "names,live,pending,log,prev,manifest,gone",
    [
        (["000001.ldb", "000002.ldb", "000003.ldb", "000004.log", "000005.dbtmp", "MANIFEST-000001", "CURRENT"], {1}, {2, 5}, 4, 0, 1, ["000003.ldb"]),
        (["000003.log", "000004.log", "000005.log"], set(), set(), 5, 4, 1, ["000003.log"]),
        (["000003.log", "000004.log", "000005.log", "MANIFEST-000001", "MANIFEST-000006"], set(), set(), 5, 4, 6, ["000003.log", "MANIFEST-000001"]),
        (["000001.ldb", "000001.dbtmp"], {1}, set(), 0, 0, 1, ["000001.dbtmp"]),
    ],
)
def test_obsolete_names(spark, names, live, pending, log, prev, manifest, gone):
    parsed = versions.parse_names(spark.createDataFrame([(n,) for n in [*names, "junk", "1.foo"]], "name string"))
    assert sorted(r.name for r in versions.obsolete_names(parsed, live, pending, log, prev, manifest).collect()) == gone


def test_exact_blocks(spark):
    df = spark.createDataFrame([(1, f"{i:03d}", i, 10) for i in range(10)], "run int, user_key string, seq long, size int")
    assert [r.block for r in compaction.exact_blocks(df, 25).orderBy("user_key").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_percentiles(spark):
    h = histogram.observe(spark.createDataFrame([(float(x),) for x in (1, 6, 6, 5_000_000)], "us double"), "us")
    assert histogram.percentiles(h, (25, 50, 99)).first().asDict() == {"p25": 5, "p50": 10, "p99": 1_000_000}
    assert histogram.percentiles(h.limit(0)).first().asDict() == {"p50": 0, "p95": 0, "p99": 0}

"""Named queries of the engine, each with the SQL that DuckDB answers alike.

``Lq`` is binding E (a mutation per event), ``Oq`` binding O, ``R`` runs of 1000 sequences with levels by age.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import batches, compaction, histogram, merge, runs, scan, versions, visibility
from ..options import Options
from ..schema import events_log, in_runs, make_key, orders_log, table

L_SQL = "SELECT lpad(CAST(user_id AS VARCHAR), 16, '0') AS user_key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, value FROM events"
O_SQL = "SELECT lpad(CAST(o_custkey AS VARCHAR), 16, '0') AS user_key, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS kind, o_totalprice AS value FROM orders"
RUNS = 1000
META_SQL = f"SELECT (seq - 1) // {RUNS} AS run, min(user_key) AS smallest, max(user_key) AS largest, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS entries FROM L GROUP BY 1"
OMETA_SQL = "SELECT (seq - 1) // 1000 AS run, min(user_key) AS smallest, max(user_key) AS largest, count(*) AS entries FROM O GROUP BY 1"


def _newest(where: str = "", log: str = "L") -> str:
    return f"SELECT user_key, seq, kind, value FROM {log} {where} QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1"


def _visible(where: str = "") -> str:
    return f"SELECT user_key, seq, value FROM ({_newest(where)}) WHERE kind = 1"


WITH = f"WITH L AS ({L_SQL}), O AS ({O_SQL}) "
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if sql.lstrip().upper().startswith("WITH ") else WITH + sql
        return f

    return add


def L(s: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return events_log(s, d)


def V(s: SparkSession, d: str, as_of: int | None = None) -> DataFrame:  # noqa: N802
    return visibility.visible(L(s, d), as_of).select("user_key", "seq", "value")


def key(n: int) -> str:
    return f"{n:016d}"


def _long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


# --- visibility ------------------------------------------------------------------


@query("visible_latest", _visible() + " ORDER BY user_key")
def _(s, d):
    return scan.forward(V(s, d))


@query("visible_at_snapshot", _visible("WHERE seq <= 6000"))
def _(s, d):
    return V(s, d, 6000)


@query("visible_agg", _visible())
def _(s, d):
    return visibility.visible(L(s, d), None, "agg").select("user_key", "seq", "value")


@query("visible_orders", f"SELECT user_key, seq, value FROM ({_newest(log='O')}) WHERE kind = 1")
def _(s, d):
    return visibility.visible(orders_log(s, d)).select("user_key", "seq", "value")


@query("visible_at_zero", _visible("WHERE seq <= 0"))
def _(s, d):
    return V(s, d, 0)


@query("point_get", f"SELECT * FROM ({_visible()}) WHERE user_key = '{key(7)}'")
def _(s, d):
    return visibility.get(L(s, d), key(7)).select("user_key", "seq", "value")


@query("point_get_snapshot", f"SELECT * FROM ({_visible('WHERE seq <= 500')}) WHERE user_key = '{key(7)}'")
def _(s, d):
    return visibility.get(L(s, d), key(7), 500).select("user_key", "seq", "value")


@query("point_get_absent", f"SELECT * FROM ({_visible()}) WHERE user_key = 'zzz'")
def _(s, d):
    return visibility.get(L(s, d), "zzz").select("user_key", "seq", "value")


@query("tombstones_live", f"SELECT user_key, seq FROM ({_newest()}) WHERE kind = 0")
def _(s, d):
    return visibility.tombstones(L(s, d)).select("user_key", "seq")


@query("key_history", "SELECT user_key, count(*) AS versions, CAST(sum(1 - kind) AS BIGINT) AS deletes, min(seq) AS first_seq, max(seq) AS last_seq FROM L GROUP BY 1")
def _(s, d):
    return visibility.history(L(s, d))


def _probes(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("probe_id"), make_key("c_custkey").alias("user_key"), ((F.col("c_custkey") * 37) % 10000 + 1).alias("as_of"))


PROBES = "SELECT c_custkey AS probe_id, lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS user_key, (c_custkey * 37) % 10000 + 1 AS as_of FROM customer"
ASOF = f"P AS ({PROBES}), J AS (SELECT p.probe_id, p.user_key, p.as_of, l.seq, l.kind, l.value FROM P p ASOF LEFT JOIN L l ON p.user_key = l.user_key AND p.as_of >= l.seq)"


@query("multi_get_asof", f"{WITH}, {ASOF} SELECT probe_id, user_key, as_of, CASE WHEN kind = 1 THEN seq ELSE 0 END AS seq, CASE WHEN kind = 1 THEN value END AS value, coalesce(kind = 1, false) AS found FROM J")
def _(s, d):
    return visibility.multi_get(L(s, d), _probes(s, d)).withColumn("seq", F.coalesce("seq", F.lit(0)))


@query("multi_get_miss_count", f"{WITH}, {ASOF} SELECT count(*) AS probes, count(*) FILTER (WHERE coalesce(kind, 0) <> 1) AS misses FROM J")
def _(s, d):
    return visibility.multi_get(L(s, d), _probes(s, d)).agg(F.count("*").alias("probes"), F.count_if(~F.col("found")).alias("misses"))


# --- ordered access ----------------------------------------------------------------


@query("seek_ge", f"SELECT * FROM ({_visible()}) WHERE user_key >= '{key(40)}' ORDER BY user_key LIMIT 1")
def _(s, d):
    return scan.seek(V(s, d), key(40))


@query("seek_past_end", f"SELECT * FROM ({_visible()}) WHERE user_key >= 'z' ORDER BY user_key LIMIT 1")
def _(s, d):
    return scan.seek(V(s, d), "z")


@query("seek_deleted", f"SELECT * FROM ({_visible()}) WHERE user_key >= (SELECT min(user_key) FROM ({_newest()}) WHERE kind = 0) ORDER BY user_key LIMIT 1")
def _(s, d):
    first = visibility.tombstones(L(s, d)).agg(F.min("user_key").alias("_t"))
    return V(s, d).join(F.broadcast(first), F.col("user_key") >= F.col("_t")).drop("_t").orderBy("user_key").limit(1)


@query("range_scan", f"SELECT * FROM ({_visible()}) WHERE user_key >= '{key(20)}' AND user_key < '{key(60)}' ORDER BY user_key")
def _(s, d):
    return scan.range_scan(V(s, d), key(20), key(60))


@query("scan_reverse", f"SELECT * FROM ({_visible()}) ORDER BY user_key DESC")
def _(s, d):
    return scan.reverse(V(s, d))


@query("topk_reverse", f"SELECT * FROM ({_visible()}) ORDER BY user_key DESC LIMIT 10")
def _(s, d):
    return scan.range_scan(V(s, d), limit=10, backward=True)


@query("next_page", f"SELECT * FROM ({_visible()}) WHERE user_key > '{key(30)}' ORDER BY user_key LIMIT 5")
def _(s, d):
    return scan.next_page(V(s, d), key(30), 5)


@query("prev_page", f"SELECT * FROM ({_visible()}) WHERE user_key < '{key(30)}' ORDER BY user_key DESC LIMIT 5")
def _(s, d):
    return scan.prev_page(V(s, d), key(30), 5)


# --- merge and batches ---------------------------------------------------------------


@query("merge_runs", "SELECT user_key, seq, kind, value FROM L WHERE seq % 2 = 0 UNION ALL SELECT user_key, seq, kind, value FROM L WHERE seq % 3 = 0 ORDER BY 1, 2 DESC")
def _(s, d):
    log = L(s, d)
    return merge.merge_runs([log.where("seq % 2 = 0"), log.where("seq % 3 = 0")])


@query("merge_runs_whole", "SELECT user_key, seq, kind, value FROM L ORDER BY user_key, seq DESC")
def _(s, d):
    log = L(s, d)
    return merge.merge_runs([log.where("seq % 2 = 0"), log.where("seq % 2 = 1")])


def _ops(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("ops")).select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("pos"), "ops")


OPS = "SELECT l_orderkey AS batch, l_linenumber AS pos, count(*) AS ops FROM lineitem GROUP BY 1, 2"


@query("batch_seq_assignment", f"SELECT batch, pos, ops, 6 + row_number() OVER (ORDER BY batch, pos) AS seq FROM ({OPS})")
def _(s, d):
    return batches.assign_seq(_ops(s, d), 7, "batch").select("batch", "pos", "ops", _long("seq"))


@query("batch_append", "SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS user_key FROM nation UNION ALL SELECT 25 + CAST(r_regionkey AS BIGINT), r_name FROM region")
def _(s, d):
    a = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("user_key"))
    b = table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("user_key"))
    return batches.append_batches(a, b)


@query("sync_group_commit", "SELECT shard, commit_group, count(*) AS writes, bool_and(sync) AS sync FROM (SELECT *, CAST(sum(b) OVER (PARTITION BY shard ORDER BY pos) AS BIGINT) AS commit_group FROM (SELECT user_id AS shard, event_id AS pos, event_type = 'purchase' AS sync, CASE WHEN lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) = (event_type = 'purchase') THEN 0 ELSE 1 END AS b FROM events)) GROUP BY ALL")
def _(s, d):
    w = table(s, d, "events").select(F.col("user_id").alias("shard"), F.col("event_id").alias("pos"), (F.col("event_type") == "purchase").alias("sync"))
    return batches.commit_groups(w).groupBy("shard", "commit_group").agg(F.count("*").alias("writes"), F.bool_and("sync").alias("sync"))


# --- run metadata ----------------------------------------------------------------------


def _meta(s, d):
    return runs.run_meta(in_runs(L(s, d), RUNS))


def _catalogue(s, d):
    """Runs of orders: level by run number, size by entries; sorted key ranges in levels 1 and up."""
    m = in_runs(orders_log(s, d)).groupBy("run").agg(F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"), F.count("*").alias("entries"))
    return m.select((F.col("run") % 4).cast("int").alias("level"), "run", "smallest", "largest", (F.col("entries") * 100).alias("size"))


CAT = f"C AS (SELECT CAST(run % 4 AS INTEGER) AS level, run, smallest, largest, entries * 100 AS size FROM ({OMETA_SQL}))"


def _narrow(s, d):
    """Runs whose key ranges are narrow, so that some meet and some don't."""
    lo = (F.col("run") * 7919) % 20 * 50
    return _catalogue(s, d).select("level", "run", "size", make_key(lo).alias("smallest"), make_key(lo + F.floor(F.col("run") / 4) % 4 * 50).alias("largest"))


NARROW = f"{CAT}, N AS (SELECT level, run, size, lpad(CAST((run * 7919) % 20 * 50 AS VARCHAR), 16, '0') AS smallest, lpad(CAST((run * 7919) % 20 * 50 + (run // 4) % 4 * 50 AS VARCHAR), 16, '0') AS largest FROM C)"


@query("run_meta", META_SQL)
def _(s, d):
    return _meta(s, d)


@query("run_overlap_pairs", f"{WITH}, {NARROW} SELECT a.run AS left_run, b.run AS right_run FROM N a JOIN N b ON a.smallest <= b.largest AND a.largest >= b.smallest WHERE a.run < b.run")
def _(s, d):
    n = _narrow(s, d)
    return runs.overlap_pairs(n, n).where("a.run < b.run").select(F.col("a.run").alias("left_run"), F.col("b.run").alias("right_run"))


@query("runs_overlapping_range", f"{WITH}, {NARROW} SELECT level, run FROM N WHERE largest >= '{key(100)}' AND smallest <= '{key(300)}'")
def _(s, d):
    return runs.overlapping(_narrow(s, d), key(100), key(300)).select("level", "run")


@query("run_lower_bound", f"{WITH}, {NARROW} SELECT level, run, smallest, largest FROM N WHERE level = 1 AND largest >= '{key(500)}' ORDER BY largest LIMIT 1")
def _(s, d):
    return runs.lower_bound(_narrow(s, d).where("level = 1"), key(500)).select("level", "run", "smallest", "largest")


@query("l0_overlap_closure", f"""{WITH}, {NARROW}, G AS (SELECT *, CASE WHEN smallest > max(largest) OVER (PARTITION BY level ORDER BY smallest, largest, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT TRUE AND row_number() OVER (PARTITION BY level ORDER BY smallest, largest, run) > 1 THEN 0 ELSE 1 END AS g FROM N)
SELECT level, run, CAST(sum(g) OVER (PARTITION BY level ORDER BY smallest, largest, run) AS BIGINT) AS island FROM G""")
def _(s, d):
    return runs.islands(_narrow(s, d)).select("level", "run", _long("island"))


def _chained(s, d):
    """Runs of a level whose ranges touch: each begins at the key where another ends, some reach over their neighbour."""
    a = F.floor(F.col("run") / 4)
    return _catalogue(s, d).select("level", "run", "size", make_key(a * 50).alias("smallest"), make_key((a + 1) * 50 + F.when(a % 3 == 0, 25).otherwise(0)).alias("largest"))


CHAINED = f"{CAT}, T AS (SELECT level, run, size, lpad(CAST(run // 4 * 50 AS VARCHAR), 16, '0') AS smallest, lpad(CAST((run // 4 + 1) * 50 + CASE WHEN run // 4 % 3 = 0 THEN 25 ELSE 0 END AS VARCHAR), 16, '0') AS largest FROM C)"


@query("boundary_files_chained", f"{WITH}, {CHAINED} SELECT a.level, a.run, b.run AS next_run, a.largest AS boundary_key FROM T a JOIN T b ON a.level = b.level AND a.largest = b.smallest AND a.run <> b.run")
def _(s, d):
    return runs.boundary_pairs(_chained(s, d))


@query("disjointness_violations_chained", f"{WITH}, {CHAINED} SELECT level, run, next_run, largest, next_smallest FROM (SELECT *, lead(run) OVER w AS next_run, lead(smallest) OVER w AS next_smallest FROM T WHERE level >= 1 WINDOW w AS (PARTITION BY level ORDER BY smallest, run)) WHERE next_smallest <= largest")
def _(s, d):
    return runs.disjointness_violations(_chained(s, d))


@query("boundary_files", f"{WITH}, {NARROW} SELECT a.level, a.run, b.run AS next_run, a.largest AS boundary_key FROM N a JOIN N b ON a.level = b.level AND a.largest = b.smallest AND a.run <> b.run")
def _(s, d):
    return runs.boundary_pairs(_narrow(s, d))


@query("run_disjointness_violations", f"{WITH}, {NARROW} SELECT level, run, next_run, largest, next_smallest FROM (SELECT *, lead(run) OVER w AS next_run, lead(smallest) OVER w AS next_smallest FROM N WHERE level >= 1 WINDOW w AS (PARTITION BY level ORDER BY smallest, run)) WHERE next_smallest <= largest")
def _(s, d):
    return runs.disjointness_violations(_narrow(s, d))


@query("level_stats", f"{WITH}, {CAT} SELECT level, count(*) AS runs, CAST(sum(size) AS BIGINT) AS bytes FROM C GROUP BY 1")
def _(s, d):
    return runs.level_stats(_catalogue(s, d))


@query("num_files_at_level", f"{WITH}, {CAT} SELECT count(*) AS files FROM C WHERE level = 2")
def _(s, d):
    return _catalogue(s, d).where("level = 2").agg(F.count("*").alias("files"))


@query("run_hull", f"{WITH}, {CAT} SELECT min(smallest) AS smallest, max(largest) AS largest, CAST(sum(size) AS BIGINT) AS bytes FROM C WHERE level = 0")
def _(s, d):
    return runs.hull(_catalogue(s, d).where("level = 0"))


SMALL = Options(l0_compaction=4, base_level_bytes=200_000, level_multiplier=10)
SCORES = f"{CAT}, S AS (SELECT g.level, coalesce(CASE WHEN g.level = 0 THEN count(run) / 4.0 ELSE sum(size) / (200000.0 * pow(10, g.level - 1)) END, 0.0) AS score FROM (SELECT CAST(unnest(range(6)) AS INTEGER) AS level) g LEFT JOIN C USING (level) GROUP BY g.level)"


@query("compaction_score", f"{WITH}, {SCORES} SELECT level, round(CAST(score AS DOUBLE), 9) AS score FROM S")
def _(s, d):
    return compaction.scores(_catalogue(s, d), SMALL).select("level", F.round("score", 9).alias("score"))


@query("compaction_pick", f"{WITH}, {SCORES} SELECT level, round(CAST(score AS DOUBLE), 9) AS score, score >= 1 AS needed FROM S ORDER BY score DESC, level LIMIT 1")
def _(s, d):
    return compaction.pick_level(_catalogue(s, d), SMALL).select("level", F.round("score", 9).alias("score"), "needed")


@query("grandparent_bytes", f"{WITH}, {NARROW} SELECT a.run, CAST(sum(b.size) AS BIGINT) AS bytes FROM N a JOIN N b ON b.level = a.level + 2 AND a.smallest <= b.largest AND a.largest >= b.smallest GROUP BY 1")
def _(s, d):
    n = _narrow(s, d)
    return runs.overlap_pairs(n, n).where("b.level = a.level + 2").groupBy(F.col("a.run").alias("run")).agg(F.sum("b.size").alias("bytes"))


def _versions(s, d):
    return _catalogue(s, d).select((F.col("run") % 3).alias("version"), "run").groupBy("version").agg(F.collect_list("run").alias("runs")).where("version < 2")


@query("live_runs", f"{WITH}, {CAT} SELECT DISTINCT run FROM C WHERE run % 3 < 2")
def _(s, d):
    return runs.live(_versions(s, d))


@query("obsolete_runs", f"{WITH}, {CAT} SELECT run FROM C WHERE run % 3 = 2 AND run % 5 <> 0")
def _(s, d):
    c = _catalogue(s, d).select("run")
    return runs.obsolete(c, runs.live(_versions(s, d)), c.where("run % 5 = 0"))


@query("missing_runs", f"{WITH}, {CAT} SELECT DISTINCT run FROM C WHERE run % 3 < 2 AND run % 7 = 0")
def _(s, d):
    return runs.missing(runs.live(_versions(s, d)), _catalogue(s, d).where("run % 7 <> 0").select("run"))


def _actions(s, d):
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("edit_no"), F.lit(0).alias("pos"), (F.col("user_id") % 7).cast("int").alias("level"), (F.col("event_id") % 500).alias("run"), F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("action"), (F.col("event_id") * 10).alias("size"))


@query("manifest_fold", "SELECT CAST(user_id % 7 AS INTEGER) AS level, event_id % 500 AS run, arg_max(event_id * 10, event_id) AS size FROM events GROUP BY 1, 2 HAVING arg_max(event_type, event_id) <> 'error'")
def _(s, d):
    return versions.fold_runs(_actions(s, d)).select("level", "run", "size")


@query("manifest_scalars", "SELECT arg_max(user_id, event_id) FILTER (WHERE event_type = 'click') AS log_number, arg_max(event_id, event_id) FILTER (WHERE event_type = 'view') AS next_file, max(event_id) AS last_sequence FROM events")
def _(s, d):
    e = table(s, d, "events")
    return versions.fold_scalars(e.select(F.col("event_id").alias("edit_no"), F.when(F.col("event_type") == "click", F.col("user_id")).alias("log_number"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("next_file"), F.col("event_id").alias("last_sequence")))


@query("version_apply_edit", f"{WITH}, {CAT} SELECT level, run, size FROM C WHERE run % 4 <> 1 UNION ALL SELECT 5, run + 1000000, size FROM C WHERE run % 4 = 1")
def _(s, d):
    c = _catalogue(s, d).select("level", "run", "size")
    moved = c.where("run % 4 = 1")
    return versions.apply_edit(c, moved.select("level", "run"), moved.select(F.lit(5).alias("level"), (F.col("run") + 1000000).alias("run"), "size"))


@query("smallest_snapshot", "SELECT coalesce(min(event_id), 99) AS smallest_snapshot FROM events WHERE event_type = 'purchase'")
def _(s, d):
    return versions.smallest_snapshot(table(s, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("seq")), 99)


# --- compaction ----------------------------------------------------------------------------

GC = "SELECT *, CASE WHEN newer <= 6000 THEN 'shadowed' WHEN kind = 0 AND seq <= 6000{deep} THEN 'tombstone' END AS reason FROM (SELECT user_key, seq, kind, value, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) AS newer FROM L{where})"
DEEP = " AND NOT EXISTS (SELECT 1 FROM D WHERE user_key >= smallest AND user_key <= largest)"


@query("compact_bottom", f"SELECT user_key, seq, kind, value FROM ({GC.format(deep='', where='')}) WHERE reason IS NULL")
def _(s, d):
    return compaction.compact(L(s, d), 6000).select("user_key", "seq", "kind", "value")


def _deeper(s, d):
    return runs.run_meta(in_runs(L(s, d).where(f"seq <= 3000 AND user_key < '{key(60)}'"), RUNS))


D_SQL = f"D AS (SELECT (seq - 1) // {RUNS} AS run, min(user_key) AS smallest, max(user_key) AS largest FROM L WHERE seq <= 3000 AND user_key < '{key(60)}' GROUP BY 1)"


@query("compact_level", f"{WITH}, {D_SQL} SELECT user_key, seq, kind, value FROM ({GC.format(deep=DEEP, where=' WHERE seq > 3000')}) g WHERE reason IS NULL")
def _(s, d):
    return compaction.compact(L(s, d).where("seq > 3000"), 6000, _deeper(s, d)).select("user_key", "seq", "kind", "value")


@query("gc_savings", f"SELECT reason, count(*) AS n FROM ({GC.format(deep='', where='')}) GROUP BY 1")
def _(s, d):
    return compaction.collect_garbage(L(s, d), 6000).groupBy("reason").agg(F.count("*").alias("n"))


@query("compact_invariant", "SELECT unnest([6000, 7777, 10000]) AS as_of, 0 AS lost, 0 AS gained")
def _(s, d):
    log = L(s, d)
    out = None
    for at in (6000, 7777, 10000):
        a, b = (visibility.visible(x, at).select("user_key", "seq", "value") for x in (log, compaction.compact(log, 6000).select(*log.columns)))
        lost, gained = a.exceptAll(b).agg(F.count("*").cast("int").alias("lost")), b.exceptAll(a).agg(F.count("*").cast("int").alias("gained"))
        row = lost.crossJoin(gained).select(F.lit(at).alias("as_of"), "lost", "gained")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query("block_assignment", f"SELECT run, user_key, seq, CAST(floor(coalesce(sum(size) OVER (PARTITION BY run ORDER BY user_key, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4096) AS BIGINT) AS block FROM (SELECT (seq - 1) // {RUNS} AS run, user_key, seq, 16 + seq % 100 AS size FROM L)")
def _(s, d):
    return compaction.block_of(in_runs(L(s, d), RUNS).withColumn("size", F.lit(16) + F.col("seq") % 100), 4096).select("run", "user_key", "seq", _long("block"))


@query("exact_block_count", f"""WITH RECURSIVE L AS ({L_SQL}), S AS (SELECT (seq - 1) // {RUNS} AS run, 16 + seq % 100 AS size, row_number() OVER (PARTITION BY (seq - 1) // {RUNS} ORDER BY user_key, seq DESC) AS i FROM L),
W AS (SELECT run, i, size AS bytes, CAST(0 AS BIGINT) AS block, CAST(size AS BIGINT) AS held FROM S WHERE i = 1
UNION ALL SELECT S.run, S.i, W.bytes + S.size, CASE WHEN W.held >= 4096 THEN W.block + 1 ELSE W.block END, CASE WHEN W.held >= 4096 THEN 0 ELSE W.held END + S.size FROM W JOIN S ON S.run = W.run AND S.i = W.i + 1)
SELECT run, max(block) + 1 AS blocks, CAST(max(bytes) AS BIGINT) AS bytes FROM W GROUP BY run""")
def _(s, d):
    cut = compaction.exact_blocks(in_runs(L(s, d), RUNS).select("run", "user_key", "seq", (F.lit(16) + F.col("seq") % 100).alias("size")), 4096)
    return cut.groupBy("run").agg((F.max("block") + 1).alias("blocks"), F.sum("size").alias("bytes"))


@query("prefix_share", f"""SELECT run, user_key, seq, (i % 16 = 0) AS is_restart, CAST(CASE WHEN i % 16 = 0 THEN 0 ELSE list_max(list_transform(range(17), lambda n: CASE WHEN left(user_key, n) = left(p, n) THEN n ELSE 0 END)) END AS BIGINT) AS shared
FROM (SELECT (seq - 1) // {RUNS} AS run, user_key, seq, lag(user_key) OVER w AS p, row_number() OVER w - 1 AS i FROM L WINDOW w AS (PARTITION BY (seq - 1) // {RUNS} ORDER BY user_key, seq DESC))""")
def _(s, d):
    return versions.with_prefix_sharing(in_runs(L(s, d), RUNS)).select("run", "user_key", "seq", "is_restart", "shared")


# --- functions ---------------------------------------------------------------------------------


@query("varint_length", "SELECT event_id, CAST(greatest(1, ceil(length(bin(event_id * 1000003)) / 7.0)) AS BIGINT) AS n FROM events")
def _(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") * 1000003).alias("x"))
    return e.select("event_id", fx.varint_length("x").alias("n"))


@query("pack_trailer", "SELECT seq, CAST(seq * 256 + kind AS VARCHAR) AS trailer FROM L")
def _(s, d):
    return L(s, d).select("seq", fx.pack_trailer("seq", "kind").cast("string").alias("trailer"))


_W = " ".join(f"+ (CAST(ascii(substr(user_key, {{i}} + {j + 1}, 1)) AS HUGEINT) << {8 * j})" for j in range(4))
_M, _H0 = 0xC6A4A793, (0xBC9F1D34 ^ 16 * 0xC6A4A793) & 0xFFFFFFFF
_STEP = "SELECT user_key, xor(x, x >> 16) AS h FROM (SELECT user_key, ((h {w}) * {m}) % 4294967296 AS x FROM ({inner}))"


def _hash_sql() -> str:
    inner = f"SELECT DISTINCT user_key, CAST({_H0} AS HUGEINT) AS h FROM L"
    for i in range(4):
        inner = _STEP.format(w=_W.format(i=4 * i), m=_M, inner=inner)
    return f"SELECT user_key, CAST(h AS BIGINT) AS h FROM ({inner})"


@query("key_hash", _hash_sql())
def _(s, d):
    return L(s, d).select("user_key").distinct().select("user_key", fx.key_hash("user_key", 16).alias("h"))


def _bloom_sql() -> str:
    """Bits of every run's keys (ten a key, six probes), and the keys within a run's range all of whose bits are set."""
    return f"""{WITH}, H AS ({_hash_sql()}), K AS (SELECT DISTINCT (seq - 1) // {RUNS} AS run, user_key FROM L),
B AS (SELECT run, 8 * CAST(ceil(greatest(64, 10 * count(*)) / 8.0) AS BIGINT) AS bits, min(user_key) AS smallest, max(user_key) AS largest FROM K GROUP BY run),
X AS (SELECT user_key, i, (h + i * (((h >> 17) | (h << 15)) & 4294967295)) & 4294967295 AS x FROM H, (SELECT CAST(unnest(range(6)) AS BIGINT) AS i)),
S AS (SELECT DISTINCT run, x % bits AS b FROM K JOIN B USING (run) JOIN X USING (user_key))
SELECT run, count(*) AS candidates FROM (SELECT B.run, X.user_key FROM B JOIN X ON X.user_key BETWEEN smallest AND largest LEFT JOIN S ON S.run = B.run AND S.b = X.x % B.bits GROUP BY 1, 2 HAVING count(S.b) = 6) GROUP BY 1"""


@query("bloom_candidates", _bloom_sql())
def _(s, d):
    """For every run, the keys in its range that its filter lets through."""
    log = in_runs(L(s, d), RUNS)
    held = runs.run_meta(log).select("run", "smallest", "largest").join(fx.bloom_build(log, "run"), "run")
    n = log.agg(F.approx_count_distinct("user_key"), F.approx_count_distinct("run")).first()
    return runs.filtered(log.select("user_key").distinct(), held, *n)


_CASE = "CASE " + " ".join(f"WHEN us <= {b} THEN {b}" for b in histogram.BOUNDS) + f" ELSE {histogram.BOUNDS[-1]} END"


@query("latency_histogram", f"SELECT CAST({_CASE} AS BIGINT) AS bound, count(*) AS n FROM (SELECT o_totalprice AS us FROM orders) GROUP BY 1")
def _(s, d):
    return histogram.observe(table(s, d, "orders"), "o_totalprice")


@query("latency_percentiles", f"WITH h AS (SELECT CAST({_CASE} AS BIGINT) AS bound, count(*) AS n FROM (SELECT o_totalprice AS us FROM orders) GROUP BY 1), c AS (SELECT bound, sum(n) OVER (ORDER BY bound) AS upto, sum(n) OVER () AS total FROM h) SELECT " + ", ".join(f"min(bound) FILTER (WHERE upto >= greatest(1, ceil(total * {p} / 100.0))) AS p{p}" for p in (50, 95, 99)) + " FROM c")
def _(s, d):
    o = table(s, d, "orders")
    h = histogram.merge(*(histogram.observe(o.where(f"o_orderkey % 2 = {k}"), "o_totalprice") for k in (0, 1)))
    return histogram.percentiles(h)


# --- workloads and streaming ---------------------------------------------------------------------


@query("bench_fill_seq", "SELECT lpad(CAST(range AS VARCHAR), 16, '0') AS user_key, range + 1 AS seq FROM range(10000)")
def _(s, d):
    from .workloads import fill_seq

    return fill_seq(s, 10_000).select("user_key", "seq")


@query("bench_fill_random_distinct", "SELECT count(DISTINCT ((range * 1103515245 + 12345) % 2147483648) % 10000) AS keys FROM range(10000)")
def _(s, d):
    from .workloads import fill_random

    return fill_random(s, 10_000).agg(F.count_distinct("user_key").alias("keys"))


@query("stream_latest", f"SELECT user_key, seq, CAST(kind AS INTEGER) AS kind, value FROM ({_newest()})")
def _(s, d):
    """The batch form of the streaming operator: same plan, run over a table."""
    from ..streaming.ingest import latest_updates

    return latest_updates(L(s, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import store_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import store_queries  # noqa: F401

    return dict(ORACLES)

"""Queries through the store, the file formats and the stream, each from the events table and with SQL on that table.

A query builds what it asks: a store of several ingested runs, files in the classic formats, a streamed store. What is built
lies in the shared folder (``scratch``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import columns as fx
from ..operators import batches, compaction, merge, ordered, runs, versions, visibility
from ..options import REVERSE, Options
from ..schema import in_runs, make_key, table
from ..scratch import scratch
from ..store import Store, open_store
from .queries import OPS, RUNS, WITH, L, _newest, _visible, key, query

PARTS = 5  # ingested runs of a store
TINY = dict(file_size=1 << 20, base_level_bytes=1, l0_compaction=4)


def _mutations(s: SparkSession, d: str) -> DataFrame:
    """The events log as stored rows: binary keys, sequences from 0, values as text."""
    return L(s, d).select(F.col("user_key").cast("binary").alias("user_key"), (F.col("seq") - 1).alias("seq"), F.col("kind").cast("byte").alias("kind"), F.col("value").cast("string").cast("binary").alias("value"))


def _store(s: SparkSession, d: str, options: Options | None = None) -> Store:
    """The log in PARTS ingested runs, each rebased by the store to follow the one before."""
    db, rows = open_store(s, scratch(s, "store"), options), _mutations(s, d)
    n = rows.count()
    step = -(-n // PARTS)
    for k in range(PARTS):
        db.ingest(rows.where((F.col("seq") >= k * step) & (F.col("seq") < (k + 1) * step)).withColumn("seq", F.col("seq") - k * step))
    return db


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_key").cast("string").alias("user_key"), F.round(F.col("value").cast("string").cast("double"), 6).alias("value"))


V_SQL = f"SELECT user_key, round(value, 6) AS value FROM ({_visible()})"
HALF = f"SELECT user_key, round(value, 6) AS value FROM ({_visible('WHERE seq <= 5000')})"
LOG_SQL = "SELECT user_key, seq, kind, CASE WHEN kind = 1 THEN round(value, 6) END AS value FROM L"


def _log(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_key").cast("string").alias("user_key"), "seq", F.col("kind").cast("int").alias("kind"), F.when(F.col("kind") == 1, F.round(F.col("value").cast("string").cast("double"), 6)).alias("value"))


# --- the store ------------------------------------------------------------------------


@query("store_view", V_SQL)
def _(s, d):
    return _text(_store(s, d).view())


@query("store_view_at_snapshot", HALF)
def _(s, d):
    return _text(_store(s, d).view(5000))


@query("store_log", LOG_SQL)
def _(s, d):
    """Every run's rows with the sequences that the manifests give them."""
    return _log(_store(s, d).log())


@query("store_reopened_view", V_SQL)
def _(s, d):
    return _text(open_store(s, _store(s, d).path).view())


@query("store_scan_range", f"SELECT * FROM ({V_SQL}) WHERE user_key >= '{key(20)}' AND user_key < '{key(60)}'")
def _(s, d):
    return _text(_store(s, d).scan(key(20).encode(), key(60).encode()))


@query("store_scan_backward", f"SELECT * FROM ({V_SQL}) ORDER BY user_key DESC LIMIT 25")
def _(s, d):
    return _text(_store(s, d).scan(backward=True, limit=25))


@query("store_reverse_order", f"SELECT * FROM ({V_SQL}) ORDER BY user_key DESC LIMIT 25")
def _(s, d):
    """A store whose own order is the reverse: its first keys are the greatest."""
    return _text(_store(s, d, Options(comparator=REVERSE)).scan(limit=25))


@query("store_multi_get", f"WITH L AS (SELECT * FROM (SELECT lpad(CAST(user_id AS VARCHAR), 16, '0') AS user_key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, value FROM events)), P AS (SELECT event_id AS probe_id, lpad(CAST(user_id AS VARCHAR), 16, '0') AS user_key, event_id * 7 % 10000 + 1 AS as_of FROM events WHERE event_type = 'view'), J AS (SELECT p.probe_id, l.seq, l.kind, l.value FROM P p ASOF LEFT JOIN L l ON p.user_key = l.user_key AND p.as_of >= l.seq) SELECT probe_id, coalesce(kind = 1, false) AS found, CASE WHEN kind = 1 THEN round(value, 6) END AS value FROM J")
def _(s, d):
    """Many probes of the same keys at different snapshots."""
    probes = table(s, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("probe_id"), make_key("user_id").cast("binary").alias("user_key"), (F.col("event_id") * 7 % 10000 + 1).alias("as_of"))
    return _store(s, d).multi_get(probes).select("probe_id", "found", F.round(F.col("value").cast("string").cast("double"), 6).alias("value"))


@query("store_get", f"SELECT user_key, value FROM ({V_SQL}) WHERE user_key IN ('{key(3)}', '{key(7)}', '{key(11)}')")
def _(s, d):
    """Point lookups one by one, in a store with Bloom filters; absent keys give no row."""
    from ..errors import NotFound

    db, found = _store(s, d, Options(bloom_bits=10)), []
    for k in (key(3), key(7), key(11), "absent"):
        try:
            found.append((bytearray(k.encode()), bytearray(db.get(k.encode()))))
        except NotFound:
            pass
    return _text(s.createDataFrame(found, "user_key binary, value binary"))


@query("store_compacted_view", V_SQL)
def _(s, d):
    db = _store(s, d, Options(**TINY))
    db.maintain(3)
    return _text(db.view())


@query("store_compacted_snapshot", HALF)
def _(s, d):
    """Compaction keeps what a pinned snapshot sees."""
    rows = _mutations(s, d)
    db = open_store(s, scratch(s, "store"), Options(**TINY))
    db.ingest(rows.where("seq < 5000"))
    snap = db.snapshot()
    for k in range(4):
        db.ingest(rows.where(f"seq >= 5000 and seq % 4 = {k}").withColumn("seq", F.expr("(seq - 5000) div 4")))
    db.maintain(3)
    return _text(db.view(snap.seq))


@query("store_compacted_entries", f"SELECT count(*) AS entries, count(DISTINCT user_key) AS keys FROM ({_newest()}) WHERE kind = 1")
def _(s, d):
    """After compaction to the bottom without snapshots only the visible version of a key is left."""
    db = _store(s, d, Options(**TINY))
    db.maintain(3)
    return db.log().agg(F.count("*").alias("entries"), F.count_distinct("user_key").alias("keys"))


@query("store_levels", "SELECT 0 AS level, 5 AS files, count(*) AS entries FROM events")
def _(s, d):
    stats = _store(s, d).property("stats")
    return stats.select("level", F.col("files").cast("int").alias("files"), "entries")


@query("store_runs", f"SELECT (event_id) // (SELECT CAST(ceil(count(*) / {PARTS}.0) AS BIGINT) FROM events) + 1 AS run, count(*) AS entries, min(lpad(CAST(user_id AS VARCHAR), 16, '0')) AS smallest, max(lpad(CAST(user_id AS VARCHAR), 16, '0')) AS largest FROM events GROUP BY 1")
def _(s, d):
    return _store(s, d).property("tables").select("run", "entries", F.unbase64("smallest").cast("string").alias("smallest"), F.unbase64("largest").cast("string").alias("largest"))


@query("store_pruned_runs", f"SELECT count(*) AS runs FROM (SELECT seq FROM L) l JOIN (SELECT CAST(ceil(count(*) / {PARTS}.0) AS BIGINT) AS step FROM L) ON (seq - 1) % step = 0 AND seq <= 5000")
def _(s, d):
    """Runs that a snapshot's reader opens: those that begin at or before it."""
    db = _store(s, d)
    return s.createDataFrame([(len(db.pruned(db.version().runs, as_of=5000)),)], "runs long")


@query("store_batches", "SELECT user_key, seq FROM (VALUES ('a', 4), ('b', 2)) t(user_key, seq)")
def _(s, d):
    """put, delete and atomic batches: sequences follow, later operations of a batch win."""
    db = open_store(s, scratch(s, "store"))
    db.put(b"a", b"1")
    db.write(batches.MutationBatch().put(b"b", b"2").delete(b"c").put(b"a", b"3"))
    return visibility.visible(db.log()).select(F.col("user_key").cast("string").alias("user_key"), F.col("seq").cast("int").alias("seq"))


@query("store_stream_view", V_SQL)
def _(s, d):
    """The log streamed into a store file by file; the second start of the stream finds nothing new."""
    from ..streaming.ingest import ingest_stream

    rows = _mutations(s, d).withColumnRenamed("seq", "pos")
    where, db = scratch(s, "stream"), open_store(s, scratch(s, "store"), Options(l0_compaction=2, l0_slowdown=2, l0_stop=2, base_level_bytes=1, file_size=1 << 20))
    rows.where("pos < 4000").coalesce(1).write.parquet(f"{where}/in")
    read = lambda: s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    for more in (None, "pos >= 4000", None):
        if more:
            rows.where(more).coalesce(1).write.mode("append").parquet(f"{where}/in")
        q = ingest_stream(read(), db, f"{where}/ck")
        q.awaitTermination()
    return _text(db.view())


@query("stream_latest_state", f"SELECT user_key, seq, CAST(kind AS INTEGER) AS kind FROM ({_newest()})")
def _(s, d):
    """The newest version per key kept by a running stream: what its updates leave."""
    from ..streaming.ingest import latest_updates

    rows = L(s, d)
    where = scratch(s, "latest")
    rows.repartition(3, "seq").write.parquet(f"{where}/in")
    stream = latest_updates(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in"))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{where}/out")).option("checkpointLocation", f"{where}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return visibility.newest(s.read.parquet(f"{where}/out")).select("user_key", "seq", F.col("kind").cast("int").alias("kind"))


# --- file formats ---------------------------------------------------------------------


def _written(s: SparkSession, d: str, source: str, **options) -> str:
    from ..sources.datasource import register

    register(s)
    path = scratch(s, source).removeprefix("file://")
    rows = _mutations(s, d).withColumn("seq", F.col("seq") + 1).withColumn("value", F.when(F.col("kind") == 1, F.col("value")))
    rows.repartitionByRange(*merge.internal_order()).sortWithinPartitions(*merge.internal_order()).write.format(source).options(path=path, **options).mode("append").save()
    return path


@query("wal_round_trip", LOG_SQL)
def _(s, d):
    return _log(s.read.format("kvlog_wal").load(_written(s, d, "kvlog_wal", file_size=65_536)))


@query("wal_appended_twice", f"SELECT user_key, count(*) AS n FROM ({LOG_SQL} UNION ALL {LOG_SQL}) GROUP BY 1")
def _(s, d):
    """A second append adds files beside the first one's."""
    path = _written(s, d, "kvlog_wal")
    s.read.format("kvlog_wal").load(path).drop("file").write.format("kvlog_wal").option("path", path).mode("append").save()
    return s.read.format("kvlog_wal").load(path).groupBy(F.col("user_key").cast("string").alias("user_key")).agg(F.count("*").alias("n"))


@query("wal_replayed_view", V_SQL)
def _(s, d):
    """A store that opens over write-ahead logs puts them into a run, with their sequences."""
    return _text(open_store(s, _written(s, d, "kvlog_wal", file_size=65_536)).view())


@query("table_round_trip", LOG_SQL)
def _(s, d):
    return _log(s.read.format("kvlog_table").load(_written(s, d, "kvlog_table", bloom_bits=10, file_size=65_536)))


@query("table_range", f"SELECT * FROM ({LOG_SQL}) WHERE user_key BETWEEN '{key(20)}' AND '{key(60)}' AND seq <= 6000")
def _(s, d):
    path = _written(s, d, "kvlog_table", split=20_000)
    return _log(s.read.format("kvlog_table").options(split=20_000, as_of=6000, **{"from": key(20).encode().hex(), "to": key(60).encode().hex()}).load(path))


@query("table_point", f"SELECT * FROM ({LOG_SQL}) WHERE user_key = '{key(7)}'")
def _(s, d):
    return _log(s.read.format("kvlog_table").option("key", key(7).encode().hex()).load(_written(s, d, "kvlog_table", bloom_bits=10, compression="none")))


@query("manifest_round_trip", f"SELECT (seq - 1) // {RUNS} + 1 AS run, CAST((seq - 1) // {RUNS} % 3 AS INTEGER) AS level, count(*) AS size, min(user_key) AS smallest, max(user_key) AS largest FROM L GROUP BY 1, 2")
def _(s, d):
    """One edit a run through a manifest that rotates, folded again from the newest file."""
    from ..sources.datasource import register

    register(s)
    path = scratch(s, "manifest").removeprefix("file://")
    m = runs.run_meta(in_runs(L(s, d), RUNS))
    added = F.array(F.struct((F.col("run") % 3).cast("int").alias("level"), (F.col("run") + 1).alias("run"), F.col("entries").alias("size"), F.col("smallest").cast("binary").alias("smallest"), F.col("largest").cast("binary").alias("largest")))
    number = F.lit(None).cast("long")
    edits = m.select(F.lit(0).cast("long").alias("file"), F.col("run").alias("edit_no"), F.lit("bytewise").alias("comparator"), F.lit(1).cast("long").alias("log_number"), number.alias("prev_log_number"), (F.col("run") + 2).alias("next_file"), F.col("max_seq").alias("last_sequence"), F.expr("cast(array() as array<struct<level: int, run: long>>)").alias("deleted"), added.alias("added"), F.expr("cast(array() as array<struct<level: int, key: binary>>)").alias("pointers"))
    edits.repartition(1).write.format("kvlog_manifest").options(path=path, manifest_size=200).mode("append").save()
    back = s.read.format("kvlog_manifest").load(path)
    newest = back.where(F.col("file") == back.agg(F.max("file")).first()[0])
    return newest.select(F.explode("added").alias("a")).select("a.run", "a.level", "a.size", F.col("a.smallest").cast("string").alias("smallest"), F.col("a.largest").cast("string").alias("largest"))


@query("store_exported_manifest", "SELECT count(*) AS last_sequence, 6 AS next_file, 5 AS runs FROM events")
def _(s, d):
    """The version of a store in the classic manifest format."""
    e = codec.decode_edit(codec.encode_edit(_store(s, d).manifest_edits()[0]))
    return s.createDataFrame([(e["last_sequence"], e["next_file"], len(e["added"]))], "last_sequence long, next_file int, runs int")


@query("file_names", r"""SELECT name, type, CAST(number AS BIGINT) AS number FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.' || k.suffix AS name, k.type, o_orderkey AS number FROM orders, (VALUES ('log', 'wal'), ('ldb', 'table'), ('sst', 'table'), ('dbtmp', 'temp')) k(suffix, type) WHERE o_orderkey < 1000 UNION ALL SELECT 'MANIFEST-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), 'manifest', o_orderkey FROM orders WHERE o_orderkey < 1000)""")
def _(s, d):
    o = table(s, d, "orders").where("o_orderkey < 1000").select("o_orderkey")
    n = F.lpad(F.col("o_orderkey").cast("string"), 6, "0")
    names = o.select(F.explode(F.array(*(F.concat(n, F.lit(f".{x}")) for x in ("log", "ldb", "sst", "dbtmp", "bak")), F.concat(F.lit("MANIFEST-"), n), F.concat(F.lit("x"), n))).alias("name"))
    return versions.parse_names(names)


# --- order, merge, functions --------------------------------------------------------------


@query("merge_backward", "SELECT user_key, seq, kind, value, row_number() OVER (ORDER BY user_key DESC, seq) AS place FROM L")
def _(s, d):
    """The reverse merge, with every row's place in it."""
    log = L(s, d)
    merged = merge.merge_runs([log.where("seq % 2 = 0"), log.where("seq % 2 = 1")], backward=True)
    return ordered.ranked(merged, [F.expr("-cast(user_key as bigint)"), F.col("seq")], "place").withColumn("place", F.col("place") + 1)


@query("run_places", f"SELECT run, user_key, seq, row_number() OVER (ORDER BY run, user_key, seq DESC) - 1 AS place FROM (SELECT (seq - 1) // {RUNS} AS run, user_key, seq FROM L)")
def _(s, d):
    """Concatenation of runs, each in internal order."""
    return ordered.ranked(in_runs(L(s, d), RUNS).select("run", "user_key", "seq"), [F.col("run"), F.col("user_key"), -F.col("seq")], "place")


@query("commit_groups_by_bytes", "SELECT shard, commit_group, count(*) AS writes, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT shard, size, CAST(sum(c) OVER (PARTITION BY shard ORDER BY pos) AS BIGINT) AS commit_group FROM (SELECT *, CASE WHEN lag(g) OVER w = g AND lag(p) OVER w = p THEN 0 ELSE 1 END AS c FROM (SELECT *, floor(coalesce(sum(size) OVER (PARTITION BY shard, g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 300) AS p FROM (SELECT *, sum(b) OVER (PARTITION BY shard ORDER BY pos) AS g FROM (SELECT user_id AS shard, event_id AS pos, event_id % 200 AS size, CASE WHEN lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) = (event_type = 'purchase') THEN 0 ELSE 1 END AS b FROM events))) WINDOW w AS (PARTITION BY shard ORDER BY pos))) GROUP BY ALL")
def _(s, d):
    w = table(s, d, "events").select(F.col("user_id").alias("shard"), F.col("event_id").alias("pos"), (F.col("event_type") == "purchase").alias("sync"), (F.col("event_id") % 200).alias("size"))
    return batches.commit_groups(w, size="size", limit=300).groupBy("shard", "commit_group").agg(F.count("*").alias("writes"), F.sum("size").alias("bytes"))


@query("compaction_budgets", "SELECT CAST(level AS INTEGER) AS level, CAST(least(40960 * pow(10, greatest(level - 1, 0)), 9223372036854775807) AS DOUBLE) AS bytes FROM (SELECT unnest(range(1, 7)) AS level)")
def _(s, d):
    o = Options(base_level_bytes=40_960)
    return s.createDataFrame([(n, float(compaction.max_bytes(n, o))) for n in range(1, 7)], "level int, bytes double")


@query("masked_checksums", "SELECT event_id, ((c >> 15 | (c << 17) & 4294967295) + 2726488792) & 4294967295 AS masked FROM (SELECT event_id, event_id * 2654435761 % 4294967296 AS c FROM events)")
def _(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") * 2654435761 % 4294967296).alias("c"))
    return e.select("event_id", fx.mask_crc("c").alias("masked"))


@query("filter_slots", "SELECT event_id, (event_id * 977) >> 11 AS slot, least(greatest(event_id, 100), 5000) AS clipped FROM events")
def _(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") * 977).alias("offset"))
    return e.select("event_id", fx.filter_index("offset").alias("slot"), fx.clip(F.col("event_id"), 100, 5000).alias("clipped"))


@query("key_successors", "SELECT user_key, chr(ascii(user_key) + 1) AS successor, hex(user_key) || '0' || kind AS head FROM (SELECT DISTINCT user_key, kind FROM L)")
def _(s, d):
    """The shortest key not below a key, by the codec; and its bytes with the kind."""
    rows = [(r.user_key, codec.successor(r.user_key.encode()).decode(), codec.internal_key(r.user_key.encode(), 0, r.kind)[:17].hex().upper()) for r in L(s, d).select("user_key", "kind").distinct().collect()]  # a key space of hundreds
    return s.createDataFrame(rows, "user_key string, successor string, head string")


@query("stored_bytes", "SELECT (seq - 1) // 1000 AS run, CAST(sum(length(user_key) + 9) AS BIGINT) AS bytes FROM L GROUP BY 1")
def _(s, d):
    """Approximate memory of each run: keys with their trailers and a tag a row."""
    return in_runs(L(s, d), RUNS).groupBy("run").agg(F.sum(F.length("user_key") + 9).alias("bytes"))


@query("batch_op_counts", f"SELECT batch, count(*) AS n FROM ({OPS}) GROUP BY 1")
def _(s, d):
    """Entry counts of batches through their encoded records."""
    ops = table(s, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("pos")).distinct()
    encode = F.udf(lambda ks: codec.encode_batch(1, [(1, str(k).encode(), b"v") for k in ks]), "binary")
    records = ops.groupBy("batch").agg(encode(F.sort_array(F.collect_list("pos"))).alias("record"))  # an order's lines
    count = F.expr("cast(conv(concat(hex(substring(record, 12, 1)), hex(substring(record, 11, 1)), hex(substring(record, 10, 1)), hex(substring(record, 9, 1))), 16, 10) as bigint)")
    return records.select("batch", count.alias("n"))

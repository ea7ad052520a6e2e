"""A versioned store: sorted Parquet runs and manifests that are created once.

Publication is the creation of ``MANIFEST-<n>.json``: it must not exist, so of two writers one gets ``Conflict`` and
retries on the new state. Readers pin one manifest. Runs are written before the manifest that lists them; what no
manifest lists is invisible and goes at ``vacuum`` when it is older than a grace. All driver file access goes through Hadoop's FileSystem.

A run's manifest entry bounds its keys and sequences, so reads skip runs outright; ingested runs hold offsets from a base that the
manifest names, and a snapshot reaches each run's scan as a bound on what is stored. Level 0 holds ingested runs, which may
overlap; deeper levels hold disjoint runs that compactions cut at the file size and at their grandparents.
Key columns are stored in the order's encoding (``Options.comparator``) and decoded when rows are returned.
"""

from __future__ import annotations

import base64
import json
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Conflict, Corruption, InvalidArgument, NotFound
from .operators import compaction, scan, visibility
from .operators.batches import MutationBatch
from .operators.merge import internal_order
from .options import Options
from .schema import LOG, checked

KEPT_MANIFESTS = 10  # of those that outgrow Options.manifest_size
MANY_RUNS = 32  # ingested runs that one scan reads together rather than each by itself


class _Files:
    """The few file operations that the driver needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, jvm = root.rstrip("/"), spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self._fs.exists(self._at("")) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._io.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if the name is taken."""
        try:
            stream = self._fs.create(self._at(name), False)
        except Exception as e:  # py4j wraps the file system's own exception
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()


def _b64(x: bytes | None) -> str | None:
    return None if x is None else base64.b64encode(bytes(x)).decode()


def _bytes(x: str | None) -> bytes | None:
    return None if x is None else base64.b64decode(x)


@dataclass
class Version:
    """One manifest: live runs, next numbers, pins, the last batch of every stream, what compactions did."""

    number: int = 0
    last_seq: int = 0
    next_run: int = 1
    log_number: int = 0  # logs from this number on are not in runs yet
    comparator: str = "bytewise"
    runs: list[dict] = field(default_factory=list)  # run, level, size, entries, smallest, largest (base64), base, min_seq, max_seq (from the base), path
    pointers: dict[str, str] = field(default_factory=dict)
    pins: dict[str, int] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)  # the last batch id applied of each stream
    stats: dict[str, list] = field(default_factory=dict)  # of each level: compactions into it, seconds, bytes read, bytes written

    def dump(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


class Store:
    """A handle on one store; ``df`` methods are lazy, writes commit at once."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None) -> None:
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.order, self.logger = self.options.comparator, self.options.logger
        self.files, self.pending = _Files(spark, self.path), set()
        found = self._manifests()
        if found and self.options.error_if_exists:
            raise InvalidArgument(f"{path} exists")
        if not found:
            if not self.options.create_if_missing:
                raise InvalidArgument(f"{path} doesn't exist")
            self.files.create("MANIFEST-000000.json", Version(comparator=self.order.name).dump())
        v = self.version()
        if v.comparator != self.order.name:
            raise InvalidArgument(f"the store orders keys by {v.comparator}, not {self.order.name}")
        if lost := sorted({r["path"].split("/")[0] for r in v.runs} - set(self.files.names())):
            raise Corruption(f"runs are missing: {lost}")
        self.logger.info("opened %s at manifest %d with %d runs", self.path, v.number, len(v.runs))
        if any(int(m[1]) >= v.log_number for n in self.files.names() if (m := re.fullmatch(r"(\d+)\.log", n))):
            self.replay(self.path)

    # --- versions ---------------------------------------------------------------

    def _manifests(self) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names() if (m := re.fullmatch(r"MANIFEST-(\d+)\.json", n)))

    def version(self, number: int | None = None) -> Version:
        number = self._manifests()[-1] if number is None else number
        return Version(**json.loads(self.files.read(f"MANIFEST-{number:06d}.json")))

    def _commit(self, change, tries: int = 8) -> Version:
        """Apply ``change(version)`` to the newest version and publish the result; retried if another writer was first."""
        for _ in range(tries):
            v = self.version()
            if change(v) is False:
                return v
            v.number += 1
            text = v.dump()
            if self.files.create(f"MANIFEST-{v.number:06d}.json", text):
                self.logger.debug("committed manifest %d", v.number)
                old = self._manifests()
                if len(old) > KEPT_MANIFESTS and len(old) * len(text) > self.options.manifest_size:
                    for n in old[:-KEPT_MANIFESTS]:
                        self.files.delete(f"MANIFEST-{n:06d}.json")
                return v
            time.sleep(0.05)
        raise Conflict("other writers kept committing first")

    # --- writes -----------------------------------------------------------------

    def _write_runs(self, rows: DataFrame, outputs: int | None = None, cuts: list | None = None) -> list[dict]:
        """Sorted runs, one unless ``outputs`` cuts the rows into more; their numbers come with the commit."""
        path = f"run-{uuid.uuid4().hex}"
        self.pending.add(path)
        dealt = rows.repartitionByRange("user_key").withColumn("out", F.lit(0)) if outputs is None else compaction.in_outputs(rows, outputs, cuts)
        sink = dealt.sortWithinPartitions("out", *internal_order()).write.partitionBy("out")
        if bits := self.options.bloom_bits:
            sink = sink.option("parquet.bloom.filter.enabled#user_key", "true").option("parquet.bloom.filter.fpp#user_key", str(max(0.6185**bits, 1e-6)))
        if self.options.compression == "none":
            sink = sink.option("compression", "none")
        sink.parquet(f"{self.path}/{path}")
        back = self.spark.read.schema("user_key binary, seq long, kind byte, value binary, out int").parquet(f"{self.path}/{path}")
        found = back.groupBy("out").agg(F.min("user_key").alias("a"), F.max("user_key").alias("b"), F.count("*").alias("n"), F.min("seq").alias("s"), F.max("seq").alias("t")).collect()  # a row for each output
        if not found:
            self.files.delete(path)
        made = []
        for m in sorted(found, key=lambda m: m.out):
            own = f"{path}/out={m.out}"
            made.append({"path": own, "level": 0, "size": self.files.size(own), "entries": m.n, "smallest": _b64(m.a), "largest": _b64(m.b), "min_seq": m.s, "max_seq": m.t, "base": 0})
        return made

    def write(self, batch: MutationBatch) -> int:
        """Apply a batch atomically; returns the last sequence. An empty batch changes nothing."""
        return self.version().last_seq if not len(batch) else self.ingest(batch.to_df(self.spark, 0))

    def put(self, key: bytes, value: bytes) -> int:
        return self.write(MutationBatch().put(key, value))

    def delete(self, key: bytes) -> int:
        return self.write(MutationBatch().delete(key))

    def _checked(self, rows: DataFrame) -> DataFrame:
        rows = checked(rows.select("user_key", F.col("seq").cast("long").alias("seq"), F.col("kind").cast("byte").alias("kind"), "value"))
        return rows.withColumn("user_key", self.order.encode(F.col("user_key")))

    def ingest(self, rows: DataFrame, batch_id: int | None = None, stream: str = "") -> int:
        """Publish (user_key, seq, kind, value) rows whose seq is an offset from 0 as one run above all earlier ones.

        The run stores offsets; its base is in the manifest, so a conflict needs no rewrite. Rows that no store accepts fail the
        write. A batch_id not above the last one of its ``stream`` changes nothing. Where level 0 is full, or every
        ``compact_every`` runs, compactions follow."""
        seen = lambda v: batch_id is not None and batch_id <= v.streams.get(stream, -1)
        if seen(self.version()):
            return self.version().last_seq
        runs = self._write_runs(self._checked(rows))

        def change(v: Version):
            if seen(v):
                return False
            for run in runs:
                v.runs.append(run | {"run": v.next_run, "base": v.last_seq + 1})
                v.next_run, v.last_seq = v.next_run + 1, v.last_seq + 1 + run["max_seq"]
            if batch_id is not None:
                v.streams[stream] = batch_id
            return bool(runs) or batch_id is not None

        v = self._commit(change)
        self.pending -= {r["path"].split("/")[0] for r in runs}
        full = sum(r["level"] == 0 for r in v.runs)
        if full >= self.options.l0_stop or (self.options.compact_every and runs and full >= self.options.l0_compaction and v.next_run % self.options.compact_every == 0):
            self.maintain()
        return v.last_seq

    def replay(self, path: str) -> int:
        """Put the write-ahead logs under ``path``, from the version's log number on, into a level-0 run with the sequences that they hold
        (S3, S7). Damaged records fail if ``paranoid``, else they are skipped. Returns the last sequence."""
        from .sources.datasource import register

        register(self.spark)
        mode = "FAILFAST" if self.options.paranoid else "PERMISSIVE"
        numbers = [int(m[1]) for n in _Files(self.spark, path).names() if (m := re.fullmatch(r"(\d+)\.log", n))]
        first = self.version().log_number
        logs = self.spark.read.format("kvlog_wal").option("mode", mode).option("from_number", first).load(path)
        runs = self._write_runs(self._checked(logs))

        def change(v: Version):
            if v.log_number != first:
                raise Conflict("another writer replayed these logs")
            for run in runs:
                v.runs.append(run | {"run": v.next_run})
                v.next_run, v.last_seq = v.next_run + 1, max(v.last_seq, run["max_seq"])
            v.log_number = max([first, *(n + 1 for n in numbers)])
            return True

        v = self._commit(change)
        self.logger.info("replayed logs %s of %s", [n for n in numbers if n >= first], path)
        return v.last_seq

    # --- reads ------------------------------------------------------------------

    @staticmethod
    def pruned(runs: list[dict], start: bytes | None = None, stop: bytes | None = None, as_of: int | None = None) -> list[dict]:
        """Of ``runs`` those that can hold a key of [start, stop] and a sequence up to ``as_of``."""
        return [r for r in runs if (start is None or _bytes(r["largest"]) >= start) and (stop is None or _bytes(r["smallest"]) <= stop) and (as_of is None or r["base"] + r["min_seq"] <= as_of)]

    def log(self, version: Version | None = None, runs: list[dict] | None = None, as_of: int | None = None) -> DataFrame:
        """The mutation log of the pinned version up to ``as_of``, keys as stored. A bound on stored sequences reaches each run's scan;
        runs wholly below it share one."""
        v = version or self.version()
        runs = self.pruned(v.runs if runs is None else runs, as_of=as_of)
        whole = lambda r: as_of is None or r["base"] + r["max_seq"] <= as_of
        read = lambda part: self.spark.read.schema(LOG).parquet(*(f"{self.path}/{r['path']}" for r in part))
        plain = [r for r in runs if not r["base"] and whole(r)]
        moved = [r for r in runs if r["base"] and whole(r)]
        alone = [r for r in runs if not whole(r)]
        if len(moved) <= MANY_RUNS:
            alone, moved = alone + moved, []
        parts = [read(plain)] if plain else []
        for r in alone:
            rows = read([r])
            if not whole(r):
                rows = rows.where(F.col("seq") <= as_of - r["base"])
            parts.append(rows.withColumn("seq", F.col("seq") + F.lit(r["base"])) if r["base"] else rows)
        if moved:
            at = F.create_map(*(F.lit(x) for r in moved for x in (r["path"], r["base"])))
            name = F.regexp_extract(F.col("_metadata.file_path"), r"(run-[0-9a-f]{32}/out=\d+)", 1)
            parts.append(read(moved).select("user_key", (F.col("seq") + F.element_at(at, name)).alias("seq"), "kind", "value"))
        if not parts:
            return self.spark.createDataFrame([], LOG)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _as_of(self, as_of: int | None, v: Version) -> int:
        return v.last_seq if as_of is None else as_of

    def _decoded(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("user_key", self.order.decode(F.col("user_key")))

    def view(self, as_of: int | None = None) -> DataFrame:
        v = self.version()
        return self._decoded(visibility.visible(self.log(v, as_of=self._as_of(as_of, v))).select("user_key", "value"))

    def get(self, key: bytes, as_of: int | None = None) -> bytes:
        """The value of one key. Only runs whose range holds it are read; their Parquet statistics and, with ``bloom_bits``, Bloom filters answer first."""
        v, stored = self.version(), self.order.encode_bytes(key)
        at = self._as_of(as_of, v)
        row = visibility.get(self.log(v, self.pruned(v.runs, stored, stored, at), at), bytearray(stored)).first()
        if row is None:
            raise NotFound(key)
        return bytes(row.value)

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return self._decoded(visibility.multi_get(self.log(), probes.withColumn("user_key", self.order.encode(F.col("user_key")))))

    def scan(self, start: bytes | None = None, stop: bytes | None = None, as_of: int | None = None, backward: bool = False, limit: int | None = None) -> DataFrame:
        """Keys in [start, stop) of the store's order; runs outside the range are not read."""
        v = self.version()
        at, low, high = self._as_of(as_of, v), *(None if k is None else self.order.encode_bytes(k) for k in (start, stop))
        rows = visibility.visible(self.log(v, self.pruned(v.runs, low, high, at), at)).select("user_key", "value")
        as_key = lambda k: None if k is None else bytearray(k)
        return self._decoded(scan.range_scan(rows, as_key(low), as_key(high), limit, backward))

    # --- snapshots --------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        """Pin the last sequence: compaction keeps what it sees until release."""
        name = uuid.uuid4().hex
        v = self._commit(lambda v: v.pins.__setitem__(name, v.last_seq) or True)
        return Snapshot(self, name, v.pins[name])

    def smallest_snapshot(self, v: Version | None = None) -> int:
        v = v or self.version()
        return min(v.pins.values(), default=v.last_seq)

    # --- compaction -------------------------------------------------------------

    def catalogue(self, v: Version | None = None) -> list[compaction.Run]:
        return [compaction.Run(r["level"], r["run"], r["size"], _bytes(r["smallest"]), _bytes(r["largest"]), r["base"] + r["min_seq"], r["base"] + r["max_seq"]) for r in (v or self.version()).runs]

    def compact(self) -> bool:
        """One picked compaction, if a score asks for it; True if something was done."""
        v, began = self.version(), time.time()
        rows = self.catalogue(v)
        pick = compaction.pick(rows, self.options, {int(k): _bytes(p) for k, p in v.pointers.items()})
        if pick is None:
            return False
        taken = {r.run for r in pick.inputs + pick.next_inputs}
        level, pointer = pick.level + 1, _b64(pick.pointer)
        used = [r for r in v.runs if r["run"] in taken]
        read = sum(r["size"] for r in used)
        if pick.trivial:
            outputs = [r | {"level": level} for r in used]
        else:
            deeper = [r for r in rows if r.level > level]
            ranges = self.spark.createDataFrame([(bytearray(r.smallest), bytearray(r.largest)) for r in deeper], "smallest binary, largest binary") if deeper else None
            kept = compaction.compact(self.log(v, used), self.smallest_snapshot(v), ranges)
            cuts = compaction.cut_keys(pick.grandparents, 10 * self.options.file_size)
            outputs = [o | {"level": level} for o in self._write_runs(kept, -(-read // self.options.file_size), cuts)]

        def change(now: Version):
            if not taken <= {r["run"] for r in now.runs}:
                raise Conflict("another compaction took these runs")
            now.runs = [r for r in now.runs if r["run"] not in taken]
            for o in outputs:
                now.runs.append(o | {"run": o["run"] if pick.trivial else now.next_run})
                now.next_run += not pick.trivial
            now.pointers[str(pick.level)] = pointer
            if not pick.trivial:
                n, s, a, b = now.stats.get(str(level), [0, 0.0, 0, 0])
                now.stats[str(level)] = [n + 1, s + time.time() - began, a + read, b + sum(o["size"] for o in outputs)]
            return True

        self._commit(change)
        self.pending -= {o["path"].split("/")[0] for o in outputs}
        self.logger.info("compacted %d runs of level %d and %d of level %d into %d", len(pick.inputs), pick.level, len(pick.next_inputs), level, len(outputs))
        return True

    def maintain(self, most: int = 100) -> int:
        """Compactions until no score asks for one (M9); returns how many."""
        done = 0
        while done < most and self.compact():
            done += 1
        return done

    def vacuum(self, keep_versions: int = 1, grace_s: float = 3600.0) -> list[str]:
        """Remove manifests but the newest, runs that no kept manifest lists, and logs already in runs (J8b). Runs that this handle is writing stay, and ones
        younger than the grace, as another writer may be about to commit them (V11)."""
        numbers = self._manifests()
        kept = numbers[-max(keep_versions, 1) :]
        versions = [self.version(n) for n in kept]
        live = {r["path"] for v in versions for r in v.runs}
        roots = {p.split("/")[0] for p in live} | self.pending
        gone = [f"MANIFEST-{n:06d}.json" for n in numbers if n not in kept]
        now = time.time() * 1000
        old = lambda n: now - self.files._fs.getFileStatus(self.files._at(n)).getModificationTime() >= grace_s * 1000
        for n in self.files.names():
            if n.startswith("run-") and n not in roots:
                gone += [n] if old(n) else []
            elif n.startswith("run-") and n not in self.pending:
                gone += [f"{n}/{o}" for o in _Files(self.spark, f"{self.path}/{n}").names() if o.startswith("out=") and f"{n}/{o}" not in live and old(n)]
            elif (m := re.fullmatch(r"(\d+)\.log", n)) and int(m[1]) < min(v.log_number for v in versions):
                gone.append(n)
        for n in gone:
            self.files.delete(n)
        self.logger.info("removed %d files of %s", len(gone), self.path)
        return gone

    # --- properties -------------------------------------------------------------

    def property(self, name: str) -> DataFrame | None:
        """stats, tables, num-files-at-level<N>, approximate-memory-usage; None if unknown."""
        v = self.version()
        schema = "level int, run long, entries long, size long, smallest string, largest string"
        rows = self.spark.createDataFrame([(r["level"], r["run"], r["entries"], r["size"], r["smallest"], r["largest"]) for r in v.runs], schema)
        if name == "tables":
            return rows.orderBy("level", F.unbase64("smallest"), "run")
        if name == "stats":
            done = self.spark.createDataFrame([(int(k), *x) for k, x in v.stats.items()], "level int, compactions long, seconds double, bytes_read long, bytes_written long")
            have = rows.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("entries").alias("entries"))
            return have.join(done, "level", "full").na.fill(0).orderBy("level")
        if name == "approximate-memory-usage":
            return rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        if (m := re.fullmatch(r"num-files-at-level(\d+)", name)) and int(m[1]) < 7:
            return rows.where(F.col("level") == int(m[1])).agg(F.count("*").alias("files"))
        return None

    def manifest_edits(self) -> list[dict]:
        """The version as one edit of the classic manifest format (S14); runs are numbered, keys carry their trailers."""
        from .functions.codec import internal_key

        v = self.version()
        added = [(r["level"], r["run"], r["size"], internal_key(_bytes(r["smallest"]), r["base"] + r["max_seq"], 1), internal_key(_bytes(r["largest"]), r["base"] + r["min_seq"], 1)) for r in v.runs]
        pointers = [(int(k), internal_key(_bytes(p), 0, 1)) for k, p in v.pointers.items()]
        return [{"comparator": v.comparator, "log_number": v.log_number, "next_file": v.next_run, "last_sequence": v.last_seq, "pointers": pointers, "deleted": [], "added": added}]

    def close(self) -> None:
        """Nothing is held."""


@dataclass
class Snapshot:
    store: Store
    name: str
    seq: int

    def release(self) -> None:
        self.store._commit(lambda v: v.pins.pop(self.name, None) is not None)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def open_store(spark: SparkSession, path: str, options: Options | None = None) -> Store:
    """Open or create the store at ``path``."""
    return Store(spark, path, options)

"""Spark data sources over the file formats: kvlog_wal, kvlog_table, kvlog_manifest.

Files are read through pyarrow's filesystems, so a path may be local or any URI they know. A log or manifest is read by one partition, a
table by one for every ``split`` bytes (64 MB), of which only its index and the blocks asked for; many small files share partitions, each up to
a 32nd of all bytes and 2 MB. Options:

* mode: FAILFAST (default) or PERMISSIVE, which skips what is damaged;
* from, to, key (tables; hex): user keys in [from, to], or one key, by the index and the filters; as_of: sequences up to it;
* from_number (logs): files from this number on;
* file_size (tables, logs; 4 MB): rows that a task holds before it writes a file; sorted input gives disjoint tables;
* compression, bloom_bits, block_size (tables), manifest_size (manifests): as of a store.

Written files are numbered above those there ("append") or replace them ("overwrite"), all at once by the driver.
"""

from __future__ import annotations

import posixpath
import re
import uuid

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import Corruption, InvalidArgument
from ..functions import codec
from .tablefile import Table, write_table
from .walfile import framed, read_records

LOG_COLUMNS = "user_key binary, seq long, kind byte, value binary"


def filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files_of(path: str, pattern: str) -> list[str]:
    from pyarrow import fs

    system, root = filesystem(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    found = system.get_file_info(fs.FileSelector(root, recursive=False))
    return sorted(f.path for f in found if f.type == fs.FileType.File and re.search(pattern, posixpath.basename(f.path)))


class _File(InputPartition):
    def __init__(self, name: str, blocks: tuple[int, int] | None = None) -> None:
        self.name, self.blocks = name, blocks


class _Files(InputPartition):
    def __init__(self, files: list[_File]) -> None:
        self.files = files


TOGETHER = 2 << 20  # bytes of small files that a partition reads


def number_of(name: str) -> int:
    found = re.search(r"(\d+)", posixpath.basename(name))
    return int(found[1]) if found else 0


class _Reader(DataSourceReader):
    pattern = ""

    def __init__(self, options: dict) -> None:
        self.options, self.path, self.strict = dict(options), options["path"], options.get("mode", "FAILFAST").upper() != "PERMISSIVE"

    def partitions(self) -> list[InputPartition]:
        least = int(self.options.get("from_number", 0))
        names = [f for f in files_of(self.path, self.pattern) if number_of(f) >= least]
        sizes = [info.size for info in filesystem(self.path)[0].get_file_info(names)]
        out, room, most = [], 0, min(TOGETHER, sum(sizes) // 32)
        for name, whole in zip(names, sizes, strict=True):
            for part, size in self.parts(name, whole):
                if size > room:
                    out.append(_Files([]))
                    room = most
                out[-1].files.append(part)
                room -= size
        return out

    def parts(self, name: str, size: int) -> list[tuple[_File, int]]:
        """What is read of a file on its own, with its bytes."""
        return [(_File(name), size)]

    def read(self, partition: _Files):
        system, _ = filesystem(self.path)
        for part in partition.files:
            with system.open_input_file(part.name) as f:
                yield from self.rows(f, part)


class _WalReader(_Reader):
    pattern = r"\.log$"

    def rows(self, f, partition: _File):
        number = number_of(partition.name)
        for record, _ in read_records(f.read(), self.strict):
            if record is not None:
                for key, seq, kind, value in codec.decode_batch(record, self.strict)[0]:
                    yield key, seq, kind, value, number


class _TableReader(_Reader):
    pattern = r"\.(ldb|sst)$"

    def parts(self, name: str, size: int) -> list[tuple[_File, int]]:
        split = int(self.options.get("split", 64 << 20))
        if size <= split:
            return super().parts(name, size)
        with filesystem(self.path)[0].open_input_file(name) as f:
            blocks = len(Table(f).index)
        step = max(1, blocks * split // size)
        return [(_File(name, (k, k + step)), TOGETHER) for k in range(0, blocks, step)]

    def rows(self, f, partition: _File):
        key, low, high = (bytes.fromhex(self.options[o]) if o in self.options else None for o in ("key", "from", "to"))
        start, stop = (key, key) if key is not None else (low if low is not None or high is None else b"", high)
        as_of, number = int(self.options.get("as_of", codec.MAX_SEQ)), number_of(partition.name)
        for k, value in Table(f).entries(not self.strict, start, stop, range(*partition.blocks) if partition.blocks else None):
            user_key, seq, kind = codec.parse_internal_key(k)
            if seq <= as_of:
                yield user_key, seq, kind, value if kind else None, number


class _ManifestReader(_Reader):
    pattern = r"^MANIFEST-"

    def rows(self, f, partition: _File):
        for n, (record, _) in enumerate(read_records(f.read(), self.strict)):
            if record is None:
                continue
            e = codec.decode_edit(record)
            yield number_of(partition.name), n, e.get("comparator"), e.get("log_number"), e.get("prev_log_number"), e.get("next_file"), e.get("last_sequence"), e["deleted"], e["added"], e["pointers"]


class _Written(WriterCommitMessage):
    def __init__(self, temps: list[str]) -> None:
        self.temps = temps


class _Writer(DataSourceWriter):
    """Each task writes temporary files; the driver numbers and renames them all when every task is done."""

    def __init__(self, options: dict, suffix: str, overwrite: bool) -> None:
        self.options, self.path, self.suffix, self.overwrite = dict(options), options["path"], suffix, overwrite

    def write(self, rows) -> WriterCommitMessage:
        system, root = filesystem(self.path)
        system.create_dir(root)
        temps: list[str] = []
        for parts in self.files(rows):
            temps.append(posixpath.join(root, f"{uuid.uuid4().hex}.dbtmp"))
            with system.open_output_stream(temps[-1]) as f:
                for part in parts:
                    f.write(part)
        return _Written(temps)

    def files(self, rows):
        """The bytes of one file after the other, each from rows of about ``file_size`` bytes."""
        limit, held, size = int(self.options.get("file_size", 4 << 20)), [], 0
        for r in rows:
            held.append((bytes(r.user_key), r.seq, r.kind, None if r.value is None else bytes(r.value)))
            size += len(held[-1][0]) + len(held[-1][3] or b"") + 16
            if size >= limit:
                yield self.encoded(held)
                held, size = [], 0
        if held:
            yield self.encoded(held)

    def encoded(self, rows: list):
        if self.suffix == ".log":
            return framed(codec.encode_batch(seq, [(kind, key, value)]) for key, seq, kind, value in rows)
        rows.sort(key=lambda r: (r[0], -r[1]))
        entries = ((codec.internal_key(k, s, kind), v or b"") for k, s, kind, v in rows)
        return [write_table(entries, compress=self.options.get("compression", "snappy") != "none", bloom_bits=int(self.options.get("bloom_bits", 0)), block_size=int(self.options.get("block_size", 4096)))]

    def name(self, number: int) -> str:
        return f"{number:06d}{self.suffix}"

    def commit(self, messages: list) -> None:
        system, root = filesystem(self.path)
        system.create_dir(root)
        old = files_of(self.path, re.escape(self.suffix) + "$" if self.suffix.startswith(".") else "^" + self.suffix)
        at = max([int(self.options.get("number", 1)) - 1, *map(number_of, old)])
        for m in messages:
            for temp in m.temps if m is not None else ():
                at += 1
                system.move(temp, posixpath.join(root, self.name(at)))
        if self.overwrite:
            for f in old:
                system.delete_file(f)

    def abort(self, messages: list) -> None:
        system, _ = filesystem(self.path)
        for m in messages:
            for temp in m.temps if m is not None else ():
                system.delete_file(temp)


class _ManifestWriter(_Writer):
    """A manifest from the edits of each task in the order of edit_no, a new one where it outgrows ``manifest_size`` and twice what it started with;
    each later file starts with the fold of what came before, so it stands alone. A fold is paid for by as many bytes of edits, so what is written
    grows with the edits and not with their square. CURRENT names the last."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, "MANIFEST-", overwrite)

    def name(self, number: int) -> str:
        return f"MANIFEST-{number:06d}"

    def files(self, rows):
        limit, found = int(self.options.get("manifest_size", 64 << 20)), sorted(rows, key=lambda r: r.edit_no)
        held, size, least, state = [], 0, 0, _state()
        for r in found:
            edit = {c: r[c] for c in ("comparator", "log_number", "prev_log_number", "next_file", "last_sequence")}
            edit |= {"deleted": [tuple(x) for x in r.deleted or ()], "added": [(x[0], x[1], x[2], bytes(x[3]), bytes(x[4])) for x in r.added or ()], "pointers": [(x[0], bytes(x[1])) for x in r.pointers or ()]}
            raw = codec.encode_edit(edit)
            if held and size + len(raw) > max(limit, least):
                yield framed(held)
                held = [codec.encode_edit(_whole(state))]
                size = len(held[0])
                least = 2 * size
            held.append(raw)
            _apply(state, edit)
            size += len(raw)
        if held:
            yield framed(held)

    def commit(self, messages: list) -> None:
        super().commit(messages)
        system, root = filesystem(self.path)
        last = max(files_of(self.path, "^MANIFEST-"), key=number_of, default=None)
        if last:
            temp = posixpath.join(root, f"{uuid.uuid4().hex}.dbtmp")
            with system.open_output_stream(temp) as f:
                f.write(posixpath.basename(last).encode() + b"\n")
            system.move(temp, posixpath.join(root, "CURRENT"))


class WalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvlog_wal"

    def schema(self) -> str:
        return f"{LOG_COLUMNS}, file long"

    def reader(self, schema):
        return _WalReader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, ".log", overwrite)


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvlog_table"

    def schema(self) -> str:
        return f"{LOG_COLUMNS}, file long"

    def reader(self, schema):
        return _TableReader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, ".ldb", overwrite)


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvlog_manifest"

    def schema(self) -> str:
        return "file long, edit_no long, comparator string, log_number long, prev_log_number long, next_file long, last_sequence long, deleted array<struct<level: int, run: long>>, added array<struct<level: int, run: long, size: long, smallest: binary, largest: binary>>, pointers array<struct<level: int, key: binary>>"

    def reader(self, schema):
        return _ManifestReader(self.options)

    def writer(self, schema, overwrite: bool):
        return _ManifestWriter(self.options, overwrite)


def register(spark) -> None:
    for source in (WalSource, TableSource, ManifestSource):
        spark.dataSource.register(source)


def _state() -> dict:
    return {"runs": {}, "pointers": {}, "prev_log_number": 0}


def _apply(state: dict, e: dict) -> None:
    state |= {k: v for k, v in e.items() if k in ("comparator", "log_number", "prev_log_number", "next_file", "last_sequence") and v is not None}
    state["pointers"] |= dict(e.get("pointers", ()))
    for level, number in e.get("deleted", ()):
        state["runs"].pop((level, number), None)
    for level, number, size, smallest, largest in e.get("added", ()):
        state["runs"][level, number] = (size, smallest, largest)


def _fold(edits: list[dict]) -> dict:
    state = _state()
    for e in edits:
        _apply(state, e)
    return state


def _whole(state: dict) -> dict:
    return {k: v for k, v in state.items() if k not in ("runs", "pointers")} | {"pointers": sorted(state["pointers"].items()), "deleted": [], "added": [(*k, *v) for k, v in sorted(state["runs"].items())]}


def whole_edit(edits: list[dict]) -> dict:
    """One edit that says what all of ``edits`` say."""
    return _whole(_fold(edits))


def fold_edits(edits: list[dict]) -> dict:
    """The state that a manifest's edits describe (A6); lacking scalars are corruption."""
    state = _fold(edits)
    for name in ("log_number", "next_file", "last_sequence"):
        if name not in state:
            raise Corruption(f"manifest without {name}")
    return state


class VersionEdit:
    """Builds one edit step by step (V21b); ``build`` gives it."""

    def __init__(self) -> None:
        self.edit: dict = {"pointers": [], "deleted": [], "added": []}

    def set(self, **scalars) -> VersionEdit:
        """comparator, log_number, prev_log_number, next_file, last_sequence."""
        if unknown := set(scalars) - set(codec._TAGS):
            raise InvalidArgument(f"an edit has no {sorted(unknown)}")
        self.edit |= scalars
        return self

    def set_pointer(self, level: int, key: bytes) -> VersionEdit:
        self.edit["pointers"].append((level, key))
        return self

    def add(self, level: int, number: int, size: int, smallest: bytes, largest: bytes) -> VersionEdit:
        self.edit["added"].append((level, number, size, smallest, largest))
        return self

    def remove(self, level: int, number: int) -> VersionEdit:
        self.edit["deleted"].append((level, number))
        return self

    def build(self) -> dict:
        return self.edit

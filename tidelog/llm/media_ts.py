"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

``encode_media`` stores a payload of 8-bit samples as one programme with one private
elementary stream: PAT and PMT sections, PES packets with presentation times, program clock
references and random-access flags. ``demux`` is a general reader: it resynchronises on the
sync byte, parses the program tables (CRC checked), checks continuity counters, reassembles PES packets of
any elementary stream, and returns their time stamps and random-access points.

Edge cases: a null or empty text becomes one padded unit of 255s; a null media value gives no
packets; repeated rows give equal values; other columns of the input are ignored. All work is
row by row, so nothing is shuffled and a hot source or copy group costs its own rows only. Columns of the input that
are named as a result are ignored like any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, in_batches, written

UNIT = 576  # samples of one frame
RATE = 8000  # samples a second
TICKS = UNIT * 90_000 // RATE  # of the 90 kHz clock, a frame
FRAMES = 16  # frames in a PES packet
GOP = 8  # PES packets from one random-access point to the next
PSI_EVERY = 32  # PES packets from one PAT and PMT to the next
PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
_CLOCK = (1 << 33) - 1

_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC.append(_c)


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _psi(section: bytes) -> bytes:
    return (b"\x00" + section).ljust(184, b"\xff")


PAT = _psi(_section(0x00, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _psi(_section(0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _read_stamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


_MIDDLE = [bytes([0x47, ES_PID >> 8, ES_PID & 0xFF, 0x10 | cc]) for cc in range(16)]


def mux(payload: bytes) -> bytes:
    """One programme whose elementary stream is ``payload``."""
    out, cc, psi_cc, step = [], 0, 0, UNIT * FRAMES
    for k, at in enumerate(range(0, max(len(payload), 1), step)):
        if k % PSI_EVERY == 0:
            out += [bytes([0x47, 0x40, 0x00, 0x10 | psi_cc]), PAT, bytes([0x47, 0x40 | PMT_PID >> 8, PMT_PID & 0xFF, 0x10 | psi_cc]), PMT]
            psi_cc = psi_cc + 1 & 15
        part = payload[at : at + step]
        pts = k * FRAMES * TICKS & _CLOCK
        data = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + part
        rap = k % GOP == 0
        pos = 0
        if rap:  # random_access_indicator and PCR
            adapt = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
            room = 184 - 1 - len(adapt)
            body = data[:room]
            adapt = adapt.ljust(183 - len(body), b"\xff")
            out += [bytes([0x47, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | cc, len(adapt)]), adapt, body]
            cc, pos = cc + 1 & 15, len(body)
        start = 0 if rap else 0x40
        while len(data) - pos >= 184:
            out += [_MIDDLE[cc] if not start else bytes([0x47, start | ES_PID >> 8, ES_PID & 0xFF, 0x10 | cc]), data[pos : pos + 184]]
            cc, pos, start = cc + 1 & 15, pos + 184, 0
        if pos < len(data):
            body = data[pos:]
            fill = 183 - len(body)
            adapt = b"" if not fill else b"\x00".ljust(fill, b"\xff")
            out += [bytes([0x47, start | ES_PID >> 8, ES_PID & 0xFF, 0x30 | cc, fill]), adapt, body]
            cc = cc + 1 & 15
    return b"".join(out)


@dataclass
class Pes:
    pid: int
    index: int  # in its elementary stream
    pts: int | None
    dts: int | None
    random_access: bool
    offset: int  # of its data in the elementary stream
    length: int
    complete: bool


@dataclass
class Stream:
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program number -> PMT pid
    streams: dict[int, tuple[int, int]] = field(default_factory=dict)  # pid -> (program number, stream type)
    pcr_pids: dict[int, int] = field(default_factory=dict)
    pcr: list[int] = field(default_factory=list)  # 27 MHz
    cc_errors: dict[int, int] = field(default_factory=dict)
    duplicates: int = 0
    lost_bytes: int = 0  # skipped to find the sync byte
    bad_sections: int = 0
    pes: list[Pes] = field(default_factory=list)
    data: dict[int, bytes] = field(default_factory=dict)  # pid -> elementary stream


def _sections(buffer: bytes) -> tuple[list[bytes], bytes]:
    found = []
    while len(buffer) >= 3 and buffer[0] != 0xFF:
        n = 3 + (int.from_bytes(buffer[1:3], "big") & 0x0FFF)
        if len(buffer) < n:
            return found, buffer
        found.append(buffer[:n])
        buffer = buffer[n:]
    return found, b""


def demux(ts: bytes | None) -> Stream:
    """Read a transport stream; damaged parts are counted, never fatal."""
    s = Stream()
    if not ts:
        return s
    psi: dict[int, bytes | None] = {0: None}
    last: dict[int, tuple[int, bytes]] = {}
    parts: dict[int, list[bytes]] = {}
    opened: dict[int, tuple[list[bytes], bool]] = {}
    done: dict[int, list[tuple[bytes, bool]]] = {}
    at, n = 0, len(ts)
    while at + 188 <= n:
        if ts[at] != 0x47:
            nxt = ts.find(b"\x47", at + 1)
            while nxt >= 0 and nxt + 188 < n and ts[nxt + 188] != 0x47:
                nxt = ts.find(b"\x47", nxt + 1)
            s.lost_bytes += (n if nxt < 0 else nxt) - at
            if nxt < 0:
                break
            at = nxt
            continue
        b1, b3 = ts[at + 1], ts[at + 3]
        pid = (b1 & 0x1F) << 8 | ts[at + 2]
        s.packets += 1
        body, rap, jump = at + 4, False, False
        if b3 & 0x20:
            size = ts[body]
            if size:
                flags = ts[body + 1]
                rap, jump = bool(flags & 0x40), bool(flags & 0x80)
                if flags & 0x10 and size >= 7:
                    v = int.from_bytes(ts[body + 2 : body + 8], "big")
                    s.pcr.append((v >> 15) * 300 + (v & 0x1FF))
            body += 1 + size
        end = at + 188
        at = end
        if pid == 0x1FFF or b1 & 0x80 or not b3 & 0x10 or body >= end:
            continue
        cc = b3 & 15
        if pid in last:
            before, held = last[pid]
            if cc == before and not jump:
                if held == ts[body:end]:
                    s.duplicates += 1
                    continue
                s.cc_errors[pid] = s.cc_errors.get(pid, 0) + 1
            elif cc != (before + 1 & 15) and not jump:
                s.cc_errors[pid] = s.cc_errors.get(pid, 0) + 1
        chunk = ts[body:end]
        last[pid] = (cc, chunk)
        starts = b1 & 0x40
        if pid in psi:
            if starts:
                skip = chunk[0]
                ready = (psi[pid] + chunk[1 : 1 + skip] if psi[pid] else b"", chunk[1 + skip :])
            else:
                ready = (psi[pid] + chunk,) if psi[pid] is not None else ()
            for piece in ready:
                found, psi[pid] = _sections(piece)
                for x in found:
                    if len(x) < 12 or crc32_mpeg(x):
                        s.bad_sections += 1
                    elif x[0] == 0x00 and pid == 0:
                        for i in range(8, len(x) - 4, 4):
                            number, target = int.from_bytes(x[i : i + 2], "big"), int.from_bytes(x[i + 2 : i + 4], "big") & 0x1FFF
                            if number:
                                s.programs[number] = target
                                psi.setdefault(target, None)
                    elif x[0] == 0x02:
                        number = int.from_bytes(x[3:5], "big")
                        s.pcr_pids[number] = int.from_bytes(x[8:10], "big") & 0x1FFF
                        i = 12 + (int.from_bytes(x[10:12], "big") & 0x0FFF)
                        while i + 5 <= len(x) - 4:
                            s.streams[int.from_bytes(x[i + 1 : i + 3], "big") & 0x1FFF] = (number, x[i])
                            i += 5 + (int.from_bytes(x[i + 3 : i + 5], "big") & 0x0FFF)
        elif starts:
            if pid in opened:
                done.setdefault(pid, []).append((b"".join(opened[pid][0]), opened[pid][1]))
            opened[pid] = ([chunk], rap)
        elif pid in opened:
            opened[pid][0].append(chunk)
    for pid, (chunks, rap) in opened.items():
        done.setdefault(pid, []).append((b"".join(chunks), rap))
    for pid in sorted(done):
        offset = 0
        for k, (raw, rap) in enumerate(done[pid]):
            if raw[:3] != b"\x00\x00\x01" or len(raw) < 9:
                continue
            size, flags, head = int.from_bytes(raw[4:6], "big"), raw[7], 9 + raw[8]
            pts = _read_stamp(raw[9:14]) if flags & 0x80 and len(raw) >= 14 else None
            dts = _read_stamp(raw[14:19]) if flags & 0x40 and len(raw) >= 19 else None
            data = raw[head : 6 + size] if size else raw[head:]
            parts.setdefault(pid, []).append(data)
            s.pes.append(Pes(pid, k, pts, dts, rap, offset, len(data), not size or len(raw) >= 6 + size))
            offset += len(data)
    s.data = {pid: b"".join(x) for pid, x in parts.items()}
    return s


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\xff")


def feature(s: Stream) -> str:
    """What the stream's index says: tables, continuity, a digest of all time stamps, and every random-access point (pts/offset)."""
    raps = [f"{'' if p.pts is None else p.pts}/{p.offset}" for p in s.pes if p.random_access]
    index = hashlib.sha256(",".join(f"{p.pid}:{p.pts}:{p.dts}" for p in s.pes).encode()).hexdigest()
    stamps = [p.pts for p in s.pes if p.pts is not None]
    tables = ",".join(f"{n}:{s.programs[n]}:" + "+".join(f"{pid}/{kind}" for pid, (of, kind) in sorted(s.streams.items()) if of == n) for n in sorted(s.programs))
    return f"programs={tables};packets={s.packets};pes={len(s.pes)};cc_errors={sum(s.cc_errors.values())};pts={min(stamps, default='')}..{max(stamps, default='')}#{index};raps={len(raps)}@{','.join(raps)};pcr={len(s.pcr)}"


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        rows: list[list] = [[], [], []]
        held = 0
        for i, t in zip(ids, texts, strict=True):
            t = t.as_py()
            media = mux(padded(t))
            rows[0].append(i), rows[1].append(len((t or "").encode())), rows[2].append(media)
            held += len(media)
            if held > 8 << 20:  # a batch goes on before it is large
                yield batch(_MEDIA, rows)
                rows, held = [[], [], []], 0
        yield batch(_MEDIA, rows)


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a transport stream."""
    return in_batches(docs.select("doc_id", "text"), _encode, "doc_id long, n_bytes long, media binary")


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("cc_errors", pa.int64()), ("n_random_access", pa.int64()), ("access_points", pa.list_(pa.struct([("pts", pa.int64()), ("es_offset", pa.int64())])))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[] for _ in _FEATURES]
        for i, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            media = m.as_py() or b""
            s = demux(media)
            payload = s.data.get(ES_PID, b"")
            for c, v in zip(rows, (i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), sum(s.cc_errors.values()), sum(p.random_access for p in s.pes), [{"pts": p.pts, "es_offset": p.offset} for p in s.pes if p.random_access]), strict=True):
                c.append(v)
        yield batch(_FEATURES, rows)


def media_features(media: DataFrame) -> DataFrame:
    """Read the stored bytes back: one row per document with its payload's digests and the stream's features."""
    return in_batches(media.select("doc_id", "n_bytes", "media"), _features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, cc_errors long, n_random_access long, access_points array<struct<pts: long, es_offset: long>>")


_INDEX = pa.schema([("doc_id", pa.int64()), ("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("pes", pa.int64()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("es_offset", pa.int64()), ("es_length", pa.int64())])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[] for _ in _INDEX]
        for i, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = demux(m.as_py())
            for p in s.pes:
                program, kind = s.streams.get(p.pid, (None, None))
                for c, v in zip(rows, (i, program, p.pid, kind, p.index, p.pts, p.dts, p.random_access, p.offset, p.length), strict=True):
                    c.append(v)
        yield batch(_INDEX, rows)


def pes_index(media: DataFrame) -> DataFrame:
    """One row per PES packet of a ``media`` column: time stamps, random access, place in the elementary stream."""
    return in_batches(media.select("doc_id", "media"), _index, "doc_id long, program int, pid int, stream_type int, pes long, pts long, dts long, random_access boolean, es_offset long, es_length long")


def op1_transport_stream(docs: DataFrame) -> DataFrame:
    """The media column is written to the shared folder, and everything that is returned comes from the bytes read back."""
    return media_features(written(encode_media(docs), "media", compression="zstd"))

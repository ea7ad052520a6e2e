"""Write-ahead log framing: 32 KiB blocks, masked CRC32C, FULL/FIRST/MIDDLE/LAST fragments."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from ..errors import Corruption
from ..functions.codec import crc32c, mask_crc, unmask_crc

BLOCK, HEADER = 32 * 1024, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def write_records(records: Iterable[bytes]) -> bytes:
    return b"".join(framed(records))


def framed(records: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a log, a record at a time."""
    at = 0
    for record in records:
        start, begin, out = 0, True, bytearray()
        while True:
            room = BLOCK - at
            if room < HEADER:
                out += bytes(room)
                at, room = 0, BLOCK
            part = record[start : start + room - HEADER]
            start += len(part)
            end = start == len(record)
            kind = FULL if begin and end else FIRST if begin else LAST if end else MIDDLE
            out += struct.pack("<IHB", mask_crc(crc32c(bytes([kind]) + part)), len(part), kind) + part
            at, begin = at + HEADER + len(part), False
            if end:
                break
        yield bytes(out)


def read_records(data: bytes, strict: bool = False) -> Iterator[tuple[bytes | None, str | None]]:
    """(record, None) or (None, what was dropped). A cut-off tail ends the log silently; strict raises on damage."""

    def bad(what: str) -> tuple[None, str]:
        if strict:
            raise Corruption(what)
        return None, what

    held: list[bytes] | None = None
    at = 0
    while at + HEADER <= len(data):
        left = BLOCK - at % BLOCK
        if left < HEADER:
            at += left
            continue
        crc, n, kind = struct.unpack_from("<IHB", data, at)
        if kind == 0 and n == 0:  # preallocated or padded
            at += left
            continue
        if HEADER + n > left:
            yield bad("record reaches past its block")
            held, at = None, at + left
            continue
        if at + HEADER + n > len(data):
            return
        part = data[at + HEADER : at + HEADER + n]
        if unmask_crc(crc) != crc32c(bytes([kind]) + part):
            yield bad("checksum doesn't match")
            held, at = None, at + left
            continue
        at += HEADER + n
        if kind in (FULL, FIRST):
            if held is not None:
                yield bad("record without an end")
            held = [part] if kind == FIRST else None
            if kind == FULL:
                yield part, None
        elif kind in (MIDDLE, LAST):
            if held is None:
                yield bad("fragment without a start")
            else:
                held.append(part)
                if kind == LAST:
                    yield b"".join(held), None
                    held = None
        else:
            yield bad(f"unknown record type {kind}")
            held = None

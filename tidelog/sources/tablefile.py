"""Sorted table files: prefix-shared blocks, filter block, two-level index, footer."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from ..errors import Corruption
from ..functions import codec

MAGIC, TRAILER, FOOTER = 0xDB4775248B80FB57, 5, 48
FILTER_BASE = 11


class BlockBuilder:
    def __init__(self, restart_interval: int) -> None:
        self.every, self.out, self.restarts, self.count, self.last = restart_interval, bytearray(), [0], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count < self.every:
            n = min(len(key), len(self.last))
            differ = int.from_bytes(key[:n], "big") ^ int.from_bytes(self.last[:n], "big")
            shared = n - (differ.bit_length() + 7) // 8
        else:
            self.restarts.append(len(self.out))
            self.count = 0
        self.out += codec.put_uvarint(shared) + codec.put_uvarint(len(key) - shared) + codec.put_uvarint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1

    def size(self) -> int:
        return len(self.out) + 4 * len(self.restarts) + 4

    def finish(self) -> bytes:
        return bytes(self.out) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))


def _entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    key = b""
    while at < end:
        three = data[at : at + 3]
        if len(three) == 3 and three.isascii():  # a byte for each number
            shared, rest, size = three
            at += 3
        else:
            shared, at = codec.get_uvarint(data, at)
            rest, at = codec.get_uvarint(data, at)
            size, at = codec.get_uvarint(data, at)
        if shared > len(key) or at + rest + size > end:
            raise Corruption("bad block entry")
        key = key[:shared] + data[at : at + rest]
        yield key, data[at + rest : at + rest + size]
        at += rest + size


def read_block(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    yield from _entries(data, 0, _restarts(data)[1])


def _restarts(data: bytes) -> tuple[tuple[int, ...], int]:
    """Where entries with whole keys start, and where entries end."""
    if len(data) < 4:
        raise Corruption("block too short")
    (n,) = struct.unpack_from("<I", data, len(data) - 4)
    end = len(data) - 4 - 4 * n
    if end < 0:
        raise Corruption("bad restart count")
    return struct.unpack_from(f"<{n}I", data, end), end


def read_block_from(data: bytes, at_or_after, key_of=lambda k: k) -> Iterator[tuple[bytes, bytes]]:
    """The entries of a block from the first whose ``key_of`` is not below a target: a binary search over restarts, then forward."""
    points, end = _restarts(data)
    low, high = 0, len(points) - 1
    while low < high:
        middle = (low + high + 1) // 2
        shared, at = codec.get_uvarint(data, points[middle])
        size, at = codec.get_uvarint(data, at)
        _, at = codec.get_uvarint(data, at)
        if shared:
            raise Corruption("restart with a shared prefix")
        low, high = (middle, high) if key_of(data[at : at + size]) < at_or_after else (low, middle - 1)
    for key, value in _entries(data, points[low] if points else 0, end):
        if key_of(key) >= at_or_after:
            yield key, value


def read_block_backward(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The entries of a block, last first, a restart's stretch at a time."""
    points, end = _restarts(data)
    for k in range(len(points) - 1, -1, -1):
        yield from reversed(list(_entries(data, points[k], points[k + 1] if k + 1 < len(points) else end)))


def _handle(offset: int, size: int) -> bytes:
    return codec.put_uvarint(offset) + codec.put_uvarint(size)


class FilterPolicy:
    """How a table tells that a block can't hold a key (X2): a name, and bytes made from keys that ``probe`` asks; it may say yes too often."""

    name = "BuiltinBloomFilter2"

    def __init__(self, bits_per_key: int = 10) -> None:
        self.bits = bits_per_key

    def build(self, keys: list[bytes]) -> bytes:
        return codec.bloom_build(keys, self.bits)

    def probe(self, key: bytes, filter_: bytes) -> bool:
        return codec.bloom_probe(key, filter_)


def write_table(entries: Iterable[tuple[bytes, bytes]], block_size: int = 4096, restart_interval: int = 16, compress: bool = True, bloom_bits: int = 0, policy: FilterPolicy | None = None, user_keys: bool = True) -> bytes:
    """A table of entries in order of their (internal) keys; filters cover user keys."""
    policy = policy or (FilterPolicy(bloom_bits) if bloom_bits else None)
    out, index, block = bytearray(), BlockBuilder(1), BlockBuilder(restart_interval)
    filters: list[bytes] = []
    held: list[bytes] = []
    pending: tuple[bytes, bytes] | None = None

    def emit(raw: bytes, pack: bool) -> bytes:
        kind, body = 0, raw
        if pack and len(small := codec.snappy(raw)) < len(raw) - len(raw) // 8:
            kind, body = 1, small
        handle = _handle(len(out), len(body))
        out.extend(body + bytes([kind]) + struct.pack("<I", codec.mask_crc(codec.crc32c(body + bytes([kind])))))
        return handle

    def cut_filters() -> None:
        while len(filters) < len(out) >> FILTER_BASE:
            filters.append(policy.build(held) if held else b"")
            held.clear()

    last = b""
    short_between, short_after = (codec.internal_separator, codec.internal_successor) if user_keys else (codec.separator, codec.successor)
    for key, value in entries:
        if pending:
            index.add(short_between(pending[0], key), pending[1])
            pending = None
        if policy:
            held.append(key[:-8] if user_keys else key)
        block.add(key, value)
        last = key
        if block.size() >= block_size:
            pending = (last, emit(block.finish(), compress))
            if policy:
                cut_filters()
            block = BlockBuilder(restart_interval)
    if block.out:
        pending = (last, emit(block.finish(), compress))
    meta = BlockBuilder(restart_interval)
    if policy:
        cut_filters()
        if held:
            filters.append(policy.build(held))
        offsets, at = [], 0
        for f in filters:
            offsets.append(at)
            at += len(f)
        body = b"".join(filters) + struct.pack(f"<{len(offsets) + 1}I", *offsets, at) + bytes([FILTER_BASE])
        meta.add(f"filter.{policy.name}".encode(), emit(body, False))
    meta_handle = emit(meta.finish(), compress)
    if pending:
        index.add(short_after(pending[0]), pending[1])
    index_handle = emit(index.finish(), compress)
    out += (meta_handle + index_handle).ljust(FOOTER - 8, b"\0") + struct.pack("<Q", MAGIC)
    return bytes(out)


class _Held:
    """A file's bytes in memory, read like a file."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, offset: int) -> bytes:
        return self.data[offset : offset + n]


class Table:
    """Random access to a table file: bytes, or any file with size() and read_at(n, offset). Only the footer, index and filter are held."""

    def __init__(self, data, verify: bool = True, policy: FilterPolicy | None = None) -> None:
        self.file = _Held(data) if isinstance(data, (bytes, bytearray)) else data
        self.length, self.verify, self.policy = self.file.size(), verify, policy or FilterPolicy()
        foot = self.file.read_at(FOOTER, self.length - FOOTER) if self.length >= FOOTER else b""
        if len(foot) < FOOTER or struct.unpack_from("<Q", foot, FOOTER - 8)[0] != MAGIC:
            raise Corruption("not a table file")
        offset, at = codec.get_uvarint(foot)
        size, at = codec.get_uvarint(foot, at)
        index_offset, at = codec.get_uvarint(foot, at)
        index_size, at = codec.get_uvarint(foot, at)
        self.index = [(last, *self._at(handle)) for last, handle in read_block(self.block(index_offset, index_size))]
        self.filters: dict[int, bytes] | None = None
        try:  # a broken filter is no reason to fail
            for name, handle in read_block(self.block(offset, size)):
                if name == f"filter.{self.policy.name}".encode():
                    self._read_filters(self.block(*self._at(handle)))
        except Corruption:
            self.filters = None

    @staticmethod
    def _at(handle: bytes) -> tuple[int, int]:
        offset, at = codec.get_uvarint(handle)
        return offset, codec.get_uvarint(handle, at)[0]

    def block(self, offset: int, size: int) -> bytes:
        if offset + size + TRAILER > self.length:
            raise Corruption("block reaches past the file")
        raw = self.file.read_at(size + TRAILER, offset)
        body, kind = raw[:size], raw[size]
        if self.verify and codec.unmask_crc(struct.unpack_from("<I", raw, size + 1)[0]) != codec.crc32c(body + bytes([kind])):
            raise Corruption("block checksum doesn't match")
        if kind > 1:
            raise Corruption("unknown block compression")
        return codec.snappy(body, unpack=True) if kind else body

    def _read_filters(self, raw: bytes) -> None:
        if len(raw) < 5:
            return
        (end,) = struct.unpack_from("<I", raw, len(raw) - 5)
        if end > len(raw) - 5:
            return
        offsets = struct.unpack_from(f"<{(len(raw) - 5 - end) // 4 + 1}I", raw, end)
        self.filters = {k: raw[a:b] for k, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False))}

    def may_hold(self, user_key: bytes, block_offset: int) -> bool:
        if self.filters is None:
            return True
        f = self.filters.get(block_offset >> FILTER_BASE)
        return True if f is None else bool(f) and self.policy.probe(user_key, f)

    def entries(self, permissive: bool = False, start: bytes | None = None, stop: bytes | None = None, blocks: range | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Entries with user keys in [start, stop] (None: open) of some blocks; only blocks that can hold them are read. An unreadable block
        fails, or is skipped if permissive. Without bounds keys need not be internal keys."""
        for last, offset, size in self.index if blocks is None else self.index[blocks.start : blocks.stop]:
            if start is not None and last[:-8] < start:
                continue
            if start is not None and start == stop and not self.may_hold(start, offset):
                continue
            try:
                data = self.block(offset, size)
                found = list(read_block(data) if start is None else read_block_from(data, start, lambda k: k[:-8]))
            except Corruption:
                if not permissive:
                    raise
                continue
            for key, value in found:
                if stop is not None and key[:-8] > stop:
                    return
                yield key, value

    def backward(self) -> Iterator[tuple[bytes, bytes]]:
        """All entries, last first."""
        for _, offset, size in reversed(self.index):
            yield from read_block_backward(self.block(offset, size))

    def get(self, user_key: bytes, seq: int) -> tuple[int, bytes] | None:
        """(kind, value) of the newest version at or before ``seq``: index, filter, then as few blocks as hold the key."""
        for key, value in self.entries(start=user_key, stop=user_key):
            _, s, kind = codec.parse_internal_key(key)
            if s <= seq:
                return kind, value
        return None

"""Options of a store, with the usual defaults and limits."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import InvalidArgument

KIB, MIB = 1 << 10, 1 << 20


def clip(x: int, low: int, high: int) -> int:
    return min(max(x, low), high)


@dataclass(frozen=True)
class KeyOrder:
    """A custom order of keys (X1): an encoding whose unsigned byte order is that order, as column expressions and for one key."""

    name: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    encode_bytes: Callable[[bytes], bytes]


BYTEWISE = KeyOrder("bytewise", lambda c: c, lambda c: c, lambda k: k)
_UP, _DOWN = "0123456789ABCDEF", "FEDCBA9876543210"
#: Greatest key first: complemented hex digits with an end mark above them all, so that a longer key precedes its prefix.
REVERSE = KeyOrder(
    "reverse-bytewise",
    lambda c: F.concat(F.translate(F.hex(c), _UP, _DOWN), F.lit("G")).cast("binary"),
    lambda c: F.unhex(F.translate(F.regexp_replace(c.cast("string"), "G$", ""), _DOWN, _UP)),
    lambda k: (k.hex().upper().translate(str.maketrans(_UP, _DOWN)) + "G").encode(),
)


@dataclass
class Options:
    create_if_missing: bool = True
    error_if_exists: bool = False
    comparator: KeyOrder | str = BYTEWISE
    write_buffer: int = 8 * MIB
    file_size: int = 4 * MIB
    manifest_size: int = 64 * MIB
    block_size: int = 4 * KIB
    restart_interval: int = 16
    max_open_files: int = 4096
    block_cache: int = 64 * MIB
    compression: str = "snappy"
    bloom_bits: int = 0
    l0_compaction: int = 4
    l0_slowdown: int = 8
    l0_stop: int = 12
    level_multiplier: int = 10
    base_level_bytes: int = 0  # four write buffers unless given
    paranoid: bool = False
    compact_every: int = 0  # ingested runs from one round of compactions to the next; 0: only when level 0 is full
    logger: logging.Logger = field(default_factory=lambda: logging.getLogger("tidelog"))

    def __post_init__(self) -> None:
        if isinstance(self.comparator, str):
            self.comparator = {o.name: o for o in (BYTEWISE, REVERSE)}.get(self.comparator) or KeyOrder(self.comparator, *(lambda c: c,) * 3)
        self.write_buffer = clip(self.write_buffer, 64 * KIB, 1 << 30)
        self.file_size = clip(self.file_size, MIB, 1 << 30)
        self.manifest_size = clip(self.manifest_size, KIB, 1 << 30)
        self.block_size = clip(self.block_size, KIB, 4 * MIB)
        self.max_open_files = clip(self.max_open_files, 74, 50_000)
        self.restart_interval = max(self.restart_interval, 1)
        if self.base_level_bytes <= 0:
            self.base_level_bytes = 4 * self.write_buffer
        if min(self.l0_compaction, self.level_multiplier) < 1:
            raise InvalidArgument("triggers and the level multiplier are positive")
        if not self.l0_compaction <= self.l0_slowdown <= self.l0_stop:
            raise InvalidArgument("compaction trigger <= slow-down <= stop must hold")

"""The codecs that Spark's own expressions can state, and Arrow functions for the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codec


def pack_trailer(seq: str, kind: str) -> Column:
    """seq * 256 + kind as decimal(20, 0): the largest exceeds a signed long."""
    return (F.col(seq).cast("decimal(17,0)") * 256 + F.col(kind)).cast("decimal(20,0)")


def varint_length(number: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(number)) / 7)).cast("long")


def mask_crc(crc: str) -> Column:
    c = F.col(crc)
    return (F.shiftright(c, 15).bitwiseOR(F.shiftleft(c, 17).bitwiseAND(0xFFFFFFFF)) + 0xA282EAD8).bitwiseAND(0xFFFFFFFF)


def filter_index(offset: str) -> Column:
    return F.shiftright(offset, 11)


def clip(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _times(h: str, m: int) -> str:
    """h * m mod 2^32 on longs, without overflow: the multiplier in two halves."""
    return f"((({h}) * {m & 0xFFFF} + (((({h}) * {m >> 16}) & 65535) << 16)) & 4294967295)"


def key_hash(key: str, length: int, seed: int = codec.BLOOM_SEED) -> Column:
    """The filter hash of ASCII keys of one fixed length (a multiple of 4), inside code generation."""
    if length % 4:
        raise ValueError("the native form takes whole words; use key_hash_any")
    m = 0xC6A4A793
    h = str((seed ^ length * m) & codec.MASK32)
    words = [" + ".join(f"(cast(ascii(substring({key}, {4 * i + j + 1}, 1)) as bigint) << {8 * j})" for j in range(4)) for i in range(length // 4)]
    steps = f"array({', '.join(words)})"
    return F.expr(f"aggregate({steps}, cast({h} as bigint), (h, w) -> {_mixed(m)})")


def _mixed(m: int) -> str:
    x = _times("(h + w) & 4294967295", m)
    return f"({x}) ^ shiftright({x}, 16)"


@F.pandas_udf(T.LongType())
def key_hash_any(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: codec.key_hash(bytes(k)))


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return data.map(lambda d: codec.crc32c(bytes(d)))


def bloom_hit(h: str, filter_: str) -> Column:
    """Whether a filter's bytes may hold a key of hash ``h``, inside the JVM: all its probes' bits are set."""
    bits = f"((length({filter_}) - 1) * 8)"
    byte = lambda at: f"cast(conv(hex(substring({filter_}, cast({at} as int), 1)), 16, 10) as int)"
    delta = f"(((({h}) >> 17) | (({h}) << 15)) & 4294967295)"
    at = f"(((({h}) + i * {delta}) & 4294967295) % {bits})"
    probes = byte(f"length({filter_})")
    return F.expr(f"case when length({filter_}) < 2 then false when {probes} > 30 then true else forall(sequence(0, {probes} - 1), i -> getbit({byte(f'{at} div 8 + 1')}, cast({at} % 8 as int)) = 1) end")


@F.pandas_udf(T.BooleanType())
def bloom_probe(keys: pd.Series, filters: pd.Series) -> pd.Series:
    return pd.Series([codec.bloom_probe(bytes(k), bytes(f)) for k, f in zip(keys, filters, strict=True)])


def bloom_build(keys, by: str, bits_per_key: int = 10):
    """(by, filter): one Bloom filter per run; runs are bounded by the file size."""
    import pyarrow as pa

    def build(table: pa.Table) -> pa.Table:
        filter_ = codec.bloom_build([bytes(k) for k in table["user_key"].to_pylist()], bits_per_key)
        return pa.table({by: table[by][:1], "filter": pa.array([filter_], pa.binary())})

    rows = keys.select(by, F.col("user_key").cast("binary").alias("user_key")).distinct()
    return rows.groupBy(by).applyInArrow(build, f"{by} {dict(keys.dtypes)[by]}, filter binary")

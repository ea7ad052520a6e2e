"""Token-id files by bit-plane shuffling.

A chunk holds whole documents. Its ids are cut into blocks of a fixed number of ids; each block
is transposed into byte planes (or bit planes), every plane is compressed by itself with
zstandard, and the chunk's head stores the index of blocks and planes, so that any block can be
read alone. Chunks are rows of a Parquet table written and committed by Spark, in ascending
doc_id order over shards; beside the blob a row holds the chunk's place and its documents.

Edge cases: null texts count as empty; every document ends with the end id, so none is without
ids; null doc_ids come first; rows with equal doc_id are ordered by text, repeated rows each keep
their own place; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fresh_path, in_batches

BLOCK_IDS, CHUNK_IDS, LEVEL = 1 << 14, 1 << 18, 1
_HEAD = struct.Struct("<4sBBIQI")  # magic, version, planes (8: bytes, 1: bits), ids a block, ids, blocks
_BLOCK = struct.Struct("<IQI")  # ids, place of the first plane, crc32 of the block's ids


def _planes(ids: np.ndarray, unit: int) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == 8:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def _joined(planes: list[bytes], n: int, unit: int) -> np.ndarray:
    if unit == 8:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(planes):
        if p:
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def encode_ids(ids: np.ndarray, unit: int = 8, block: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """ids (unsigned 32 bits) as one chunk; unit 8 makes byte planes, 1 bit planes. A plane of zeros takes no room."""
    pack, frames, index, at = zstandard.ZstdCompressor(level=level, write_content_size=True), [], [], 0
    count = 32 // unit
    for start in range(0, len(ids), block):
        part = ids[start : start + block]
        sizes = []
        for p in _planes(part, unit):
            frame = pack.compress(p) if p.strip(b"\0") else b""
            frames.append(frame), sizes.append(len(frame))
        index.append(_BLOCK.pack(len(part), at, zlib.crc32(part.astype("<u4").tobytes())) + struct.pack(f"<{count}I", *sizes))
        at += sum(sizes)
    return _HEAD.pack(b"BPLN", 1, unit, block, len(ids), len(index)) + b"".join(index) + b"".join(frames)


def decode_ids(blob: bytes, blocks: range | None = None) -> np.ndarray:
    """All ids of a chunk, or those of some blocks; a damaged block raises ValueError."""
    magic, version, unit, _, _, n_blocks = _HEAD.unpack_from(blob)
    if magic != b"BPLN" or version != 1:
        raise ValueError("not a bit-plane chunk")
    count, unpack, out = 32 // unit, zstandard.ZstdDecompressor(), []
    step = _BLOCK.size + 4 * count
    body = _HEAD.size + n_blocks * step
    for k in range(n_blocks) if blocks is None else blocks:
        n, at, crc = _BLOCK.unpack_from(blob, _HEAD.size + k * step)
        planes = []
        for size in struct.unpack_from(f"<{count}I", blob, _HEAD.size + k * step + _BLOCK.size):
            planes.append(unpack.decompress(blob[body + at : body + at + size]) if size else b"")
            at += size
        ids = _joined(planes, n, unit)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


_CHUNK = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))])
CHUNK_SCHEMA = "shard int, chunk int, start long, n_ids long, blob binary, doc_ids array<long>, doc_tokens array<long>"


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, path: str, unit: int = 8, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the chunk table to ``path``; returns it as read back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, end, shard = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        parts, ids, lens, held, start, chunk = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, ids, lens, held, start, chunk
            made = batch(_CHUNK, [[shard], [chunk], [start], [held], [encode_ids(np.frombuffer(b"".join(parts), "<u4"), unit)], [ids], [lens]])
            parts, ids, lens, start, chunk, held = [], [], [], start + held, chunk + 1, 0
            return made

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = encode(t.as_py() or "") + end
                parts.append(raw), ids.append(i), lens.append(len(raw) // 4)
                held += len(raw) // 4
                if held >= chunk_ids:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    in_batches(rows, work, CHUNK_SCHEMA).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(CHUNK_SCHEMA).parquet(path)


_DOCS = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for shard, start, blob, ids, lens in zip(*(b.column(c) for c in ("shard", "start", "blob", "doc_ids", "doc_tokens")), strict=True):
            raw, at, at_id = memoryview(decode_ids(blob.as_py()).tobytes()), 0, start.as_py()
            rows: list[list] = [[] for _ in _DOCS]
            for i, n in zip(ids.as_py(), lens.as_py(), strict=True):
                for c, v in zip(rows, (i, shard.as_py(), at_id, n, zlib.crc32(raw[at : at + 4 * n])), strict=True):
                    c.append(v)
                at, at_id = at + 4 * n, at_id + n
            yield batch(_DOCS, rows)


def read_documents(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    The places of the shards come from one row per shard (as many as shuffle partitions, whatever
    the input), the only thing that is broadcast."""
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    bases, at = [], 0
    for r in sorted(totals, key=lambda r: r.shard):
        bases.append((r.shard, at))
        at += r.n
    base = chunks.sparkSession.createDataFrame(bases, "shard int, base long")
    rows = in_batches(chunks.select("shard", "start", "blob", "doc_ids", "doc_tokens"), _read, "doc_id long, shard int, local long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op8_bit_planes(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    return read_documents(write_ids(docs, tokenizer, end_id, fresh_path(docs.sparkSession, "op8")))

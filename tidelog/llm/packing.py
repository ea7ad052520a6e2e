"""Vector best-fit packing of documents into sequences.

Every document's ids end with the end id; only a document longer than a sequence is cut, into full
pieces and a rest. A piece's demand is a vector that its length gives: tokens, documents (1) and attention
cost (length squared); a sequence has a capacity of each. Pieces of one length are
alike, so best-fit decreasing runs over the histogram of lengths (as many classes as a sequence has
tokens, whatever the corpus): open sequences with equal residuals form one group,
the group that scores best takes the next pieces, and groups split as they fill. The plan (groups of sequences with
their lengths) is a small table whose rows are joined back by the rank of a piece within its length.

Ranks are dealt by (length, salt), so a length that a third of all pieces have does not meet in one task.

Edge cases: null and empty texts are one piece with the end id; rows that repeat a doc_id are
packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, in_batches, written

SEQUENCE, SALT_ROWS = 4096, 20_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and how the scores weigh each kind."""

    tokens: int = SEQUENCE
    documents: int = SEQUENCE
    attention: int = SEQUENCE * SEQUENCE
    weights: tuple[float, float, float] = (1.0, 0.25, 0.5)
    score: str = "norm"  # residual norm after the piece (least), or "dot": demand times residual (least that fits)


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, most: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every whole text's ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[list] = [[] for _ in _PIECE]
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = encode(t.as_py() or "") + end
                for k, at in enumerate(range(0, len(raw), 4 * most)):
                    part = raw[at : at + 4 * most]
                    for c, v in zip(rows, (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield batch(_PIECE, rows)

    return in_batches(docs.select("doc_id", "text"), work, "doc_id long, piece int, start long, length int, ids_crc32 long")


@dataclass
class Slot:
    """Pieces of one length with ranks first..first + each * bins - 1: ``each`` go to every sequence from ``bin`` on, at ``offset``."""

    length: int
    first: int
    last: int
    each: int
    bin: int
    offset: int


def plan(histogram: dict[int, int], capacity: Capacity = Capacity()) -> tuple[list[Slot], int]:
    """Best-fit decreasing over lengths; returns the slots and the number of sequences."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weight = np.array(capacity.weights) / full
    left, state = np.zeros((0, 3)), np.zeros((0, 3), np.int64)  # a group's residual; its sequences, the first of them, tokens used
    slots: list[Slot] = []
    bins = 0
    lengths = sorted((n for n in histogram if histogram[n]), reverse=True)
    for length in lengths:
        demand = np.array([length, 1, length * length], float)
        if (demand > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence")
        rest, rank, made = histogram[length], 0, []

        def fill(residual: np.ndarray, count: int, first: int, used: int) -> None:
            """Whole sequences take as many pieces as fit; one more takes what then is left."""
            nonlocal rest, rank
            each = int((residual // demand).min())
            for n_each, n_bins in ((each, min(count, rest // each)), (rest % each if rest // each < count else 0, 1)):
                if n_each and n_bins:
                    slots.append(Slot(length, rank, rank + n_each * n_bins - 1, n_each, first, used))
                    made.append((residual - n_each * demand, (n_bins, first, used + n_each * length)))
                    rank, rest, first, count = rank + n_each * n_bins, rest - n_each * n_bins, first + n_bins, count - n_bins
            if count:
                made.append((residual, (count, first, used)))

        value = -((left * weight) @ (demand * weight)) if capacity.score == "dot" else np.linalg.norm((left - demand) * weight, axis=1)
        value[(left < demand).any(axis=1)] = np.inf
        while rest and len(value) and value[g := int(value.argmin())] < np.inf:
            value[g], whole = np.inf, left[g].copy()
            left[g] = -1
            fill(whole, *(int(x) for x in state[g]))
        if rest:
            new = -(-rest // int((full // demand).min()))
            bins += new
            fill(full, new, bins - new, 0)
        if made:
            left, state = np.r_[left, [m[0] for m in made]], np.r_[state, [m[1] for m in made]]
        open_ = (left >= [lengths[-1], 1, lengths[-1] ** 2]).all(axis=1)
        left, state = left[open_], state[open_]
    return slots, bins


def pack(p: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """``p`` (with doc_id, piece, length; read three times, so a stored table) plus sequence_id and offset."""
    spark = p.sparkSession
    histogram = {r.length: r.n for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length, at most a sequence's tokens
    slots, _ = plan(histogram, capacity)
    salts = -(-max(histogram.values(), default=1) // SALT_ROWS) + 63
    salted = p.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    ranked = salted.withColumn("_rn", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", *(c for c in ("start", "ids_crc32") if c in p.columns))))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = ranked.join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_rn") - 1)
    places = spark.createDataFrame([(s.length, s.first, s.last, s.each, s.bin, s.offset) for s in slots], "_length int, _first long, _last long, _each long, _bin long, _offset long")
    if len(slots) <= 200_000:
        places = F.broadcast(places)
    found = ranked.join(places, (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last")))
    at = F.col("_rank") - F.col("_first")
    return found.select(*p.columns, F.expr("_bin + (_rank - _first) div _each").alias("sequence_id"), (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("int").alias("offset"))


def op6_vector_best_fit(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: Capacity = Capacity()) -> DataFrame:
    return pack(written(pieces(docs, tokenizer, end_id, capacity.tokens), "op6"), capacity)

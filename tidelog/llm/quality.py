"""Quality: a compression classifier.

Two zstandard dictionaries are trained on good and on bad labelled text. A text's feature is
the normalised difference of its compressed sizes, (bad - good) / length; a one-dimensional
logistic regression turns it into a calibrated score.

Bounds (parameters): a dictionary takes at most ``per_class`` labelled rows of its class, the
calibration at most ``per_class`` more of each, and all of them ``FIT_BYTES`` of text at most (whole texts only); rows are
chosen by a seeded hash of doc_id, so reruns agree. Everything else reads all rows. The model (two dictionaries and two weights) has
a fixed size and goes to the workers with the task.

Edge cases: null and empty texts are scored like any text (length 0 counts as 1); where a class
has no labelled row, or too little text for a dictionary, every score is the share of good labels (0.5
without labels); extra columns are ignored, and ones named as a result are replaced; repeated rows get equal scores, and a
labelled doc_id that several rows hold is fitted once, by the least of their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

PER_CLASS, DICT_BYTES, LEVEL, SEED = 2000, 112 << 10, 3, 20240
FIT_BYTES = 64 << 20  # of labelled text that a fit reads


@dataclass
class Model:
    good: bytes
    bad: bytes
    weight: float
    bias: float


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def labelled(labels: DataFrame, column: str, per_class: int, kept_out: F.Column) -> DataFrame:
    """(doc_id, y, part): a bounded sample of usable labels, ``2 * per_class`` rows of each class at most."""
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~kept_out).select("doc_id", F.col(column).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("y").alias("least")).where("y = least").drop("least")
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{SEED}")))
    picked = [rows.where(F.col("y") == c).orderBy(order, "doc_id").limit(2 * per_class) for c in (0, 1)]
    return picked[0].unionByName(picked[1])


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, per_class: int, kept_out: F.Column, most: int = FIT_BYTES) -> DataFrame:
    """(doc_id, y, text): the sample of ``labelled`` with its whole texts, in its order, those that still fit into a class's half of ``most`` bytes."""
    picked = labelled(labels, column, per_class, kept_out)
    sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.max("n").alias("n"))
    fitting, held = [], {0: 0, 1: 0}
    for r in sorted(sized.collect(), key=lambda r: (sample_order(r.doc_id), r.doc_id)):  # 2 * per_class ids of a class at most
        if held[r.y] + r.n <= most // 2:
            held[r.y] += r.n
            fitting.append((r.doc_id, r.y))
    chosen = docs.sparkSession.createDataFrame(fitting, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, balance: float = 0.0) -> np.ndarray:
    """Newton's method; the last weight is the bias. balance: 0 keeps the classes' shares, 1 makes them equal."""
    z = np.c_[x, np.ones(len(x))]
    share = max(y.mean(), 1e-9)
    w = np.where(y == 1, (0.5 / share) ** balance, (0.5 / max(1 - share, 1e-9)) ** balance)
    beta = np.zeros(z.shape[1])
    ridge = np.diag([l2 * len(x)] * (z.shape[1] - 1) + [1e-9])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + ridge, z.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    return tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO)) for d in (good, bad))


def difference(pair: tuple, text: str | None) -> float:
    raw = (text or "").encode()
    return (len(pair[1].compress(raw)) - len(pair[0].compress(raw))) / max(len(raw), 1)


def dictionary(texts: list[str], size: int) -> bytes | None:
    """A dictionary from whole texts, cut into the short samples that its trainer wants."""
    samples = [raw[i : i + 2048] for t in texts for raw in [(t or "").encode()] for i in range(0, len(raw), 2048)]
    total = sum(map(len, samples))
    for limit in (size, total // 8, total // 16):
        try:
            return zstandard.train_dictionary(min(size, limit), samples).as_bytes()
        except zstandard.ZstdError:
            continue
    return b"".join(samples)[-size:] or None


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, dict_bytes: int = DICT_BYTES) -> Model:
    rows = labelled_texts(docs, labels, "quality", per_class, held_out()).collect()  # 4 * per_class rows, FIT_BYTES at most
    rows = sorted(((sample_order(r.doc_id), r.doc_id, r.text or "", r.y) for r in rows), key=lambda r: r[:3])
    fitting, checking = {0: [], 1: []}, []
    for c in (0, 1):
        own = [r for r in rows if r[3] == c]
        cut = min(per_class, -(-len(own) * 2 // 3))
        fitting[c] = [r[2] for r in own[:cut]]
        checking += [(r[2], c) for r in own[cut:]] or [(r[2], c) for r in own]
    good, bad = dictionary(fitting[1], dict_bytes), dictionary(fitting[0], dict_bytes)
    n = len(rows)
    if not good or not bad:
        share = sum(r[3] for r in rows) / n if n else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"", b"", 0.0, math.log(share / (1 - share)))
    pair = compressors(good, bad)
    x = np.array([[difference(pair, t)] for t, _ in checking])
    y = np.array([c for _, c in checking])
    w, b = logistic(x * 100, y, l2=1e-3)
    return Model(good, bad, float(max(w, 0) * 100), float(b))


def sample_order(doc_id: int) -> str:
    import hashlib

    return hashlib.md5(f"{doc_id}:{SEED}".encode()).hexdigest()


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) of ``docs`` with held_out, score and predicted, which replace columns of these names."""
    import zlib

    out = [c for c in (keep or docs.columns) if c not in ("held_out", "score", "predicted")]
    names = [*out, *(c for c in ("doc_id", "text") if c not in out)]
    at_id, at_text = names.index("doc_id"), names.index("text")
    rows = docs.select(*names)
    schema = f"{', '.join(f'`{c}` {rows.schema[c].dataType.simpleString()}' for c in out)}, held_out boolean, score double, predicted int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model.good, model.bad) if model.good else None
        for b in batches:
            x = np.array([difference(pair, t.as_py()) if pair else 0.0 for t in b.column(at_text)], dtype=float)
            p = 1 / (1 + np.exp(-np.clip(model.weight * x + model.bias, -500, 500)))
            held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in b.column(at_id).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in out), pa.array(held, pa.bool_()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*out, "held_out", "score", "predicted"])

    return in_batches(rows, work, schema)


def op10_compression_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels), keep=["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns as before."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model.good, model.bad) if model.good else None
        for b in batches:
            yield b.filter(pa.array([model.weight * (difference(pair, t.as_py()) if pair else 0.0) + model.bias >= 0 for t in b.column(at)], pa.bool_()))

    return in_batches(docs, work, docs.schema)

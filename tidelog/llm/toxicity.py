"""Toxicity: class-conditional Kneser-Ney models.

One interpolated Kneser-Ney bigram model for toxic text and one for ordinary text. Words and pairs count their contexts, that
is the distinct words before them, so many copies of one text add no more than the text itself. With N(w) contexts of a word
in a class, T in all, and n(v w) and H(v) alike for pairs:

    P(w)     = max(N(w) - D, 0) / T + g S(w)            g    = sum of min(N, D) / T
    P(w | v) = max(n(v w) - D, 0) / H(v) + g(v) P(w)    g(v) = sum over w of min(n(v w), D) / H(v)

g and g(v) are each class's own discounted mass. S, the shared backoff, counts the documents of the whole corpus that hold a
word, and is the same for both classes, so an expression that the labelled rows hardly show weighs alike in both. D is 3: a
class's own counts tell from four contexts on (one toxic row in ten leaves the words of ordinary prose with a few chance
contexts each). Words that neither class keeps are one unknown word, so each P sums to one.

A text's features are two differences of log-likelihoods (toxic less ordinary), each divided by its number of words: of the whole
text, and of that window of ``WINDOW`` words where it is greatest, since few words of a toxic text are toxic. A logistic
regression on labelled rows that the counts didn't see calibrates them; the whole text's is the level that the window is
compared with.

Bounds (parameters): labelled rows are a seeded sample of ``2 * per_class`` rows of each class at most, three quarters for
counts and the rest for calibration, and of ``FIT_BYTES`` bytes of text in all; what reaches the driver are the words, pairs and heads above D contexts of that sample. The
shared counts of these words cover every document.

Edge cases: null and empty texts have features zero; without labels of both classes every score is
the share of toxic labels (0.5 without labels); repeated rows count as given; extra columns are ignored, also ones named as a result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, in_batches, written
from .quality import SEED, labelled_texts, logistic

PER_CLASS, D, WINDOW = 4000, 3.0, 3
PRIOR_SHARE = 0.5  # of the prior log odds, beside the balanced calibration
_WORDS = re.compile(r"[^\W_]+").findall


def tokens(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


_COUNT = pa.schema([("key", pa.string()), ("n", pa.int64())])
_TRIPLE = pa.schema([("y", pa.int32()), ("key", pa.string())])


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class's distinct word triples of a batch, joined by blanks; a text's first word follows "^ ^"."""
    for b in batches:
        seen: dict[int, set] = {0: set(), 1: set()}
        for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            w = ["^", "^", *tokens(t.as_py())]
            seen[y].update(map(" ".join, zip(w, w[1:], w[2:], strict=False)))
        for y, c in seen.items():
            if c:
                yield batch(_TRIPLE, [[y] * len(c), list(c)])


class Model:
    """Both classes' probabilities (rows: ordinary, toxic) as arrays over word ids (0: unknown), and the calibration's weights.

    words: N of kept words by class; total: T and the sum of max(N - D, 0) by class; pairs: n of kept pairs by class; heads: H
    and the sum of max(n - D, 0) of their first words by class; corpus: documents of each word, every: sum over all words."""

    def __init__(self, words: dict[str, tuple], total: list[tuple], pairs: dict[tuple[str, str], tuple], heads: dict[str, list[tuple]], corpus: dict[str, int], every: int) -> None:
        self.ids = {w: k for k, w in enumerate(sorted({*words, *heads, *(w for _, w in pairs)}), 1)}
        size = len(self.ids) + 1
        shared = np.full(size, 0.5)
        for w, k in self.ids.items():
            shared[k] += corpus.get(w, 0)
        shared[0] += max(every - sum(corpus.get(w, 0) for w in self.ids), 0)
        shared /= shared.sum()
        own = np.zeros((2, size))
        for w, n in words.items():
            own[:, self.ids[w]] = n
        self.p, self.g = np.zeros((2, size)), np.ones((2, size))
        for y in (0, 1):
            t, kept = total[y]
            self.p[y] = np.maximum(own[y] - D, 0) / max(t, 1) + (1 - kept / max(t, 1)) * shared
            for v, h in heads.items():
                if h[y][0]:
                    self.g[y, self.ids[v]] = 1 - h[y][1] / h[y][0]
        keyed = sorted((self.ids[v] * size + self.ids[w], tuple(max(n[y] - D, 0) / heads[v][y][0] if n[y] > D else 0.0 for y in (0, 1))) for (v, w), n in pairs.items())
        self.size, self.keys = size, np.array([k for k, _ in keyed] + [np.iinfo(np.int64).max])
        self.kept = np.array([n for _, n in keyed] + [(0.0, 0.0)]).T
        self.beta = [0.0, 0.0, 0.0]

    def probabilities(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """P(w | v) of both classes for word ids."""
        key = v * self.size + w
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.kept[:, at], 0.0) + self.g[:, v] * self.p[:, w]

    def features(self, text: str | None) -> list[float]:
        words = tokens(text)
        if not words:
            return [0.0, 0.0]
        get = self.ids.get
        w = np.fromiter((get(x, 0) for x in words), np.int64, len(words))
        p = self.probabilities(np.r_[get("^", 0), w[:-1]], w)
        run = np.cumsum(np.r_[0.0, np.log(p[1] / p[0])])
        n = min(WINDOW, len(w))
        return [float(run[-1] / len(w)), float((run[n:] - run[:-n]).max() / n)]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.beta[:2], self.features(text)) + self.beta[2])
        return 1 / (1 + math.exp(-min(max(z, -500), 500)))


def _kept(rows: DataFrame, key: str) -> tuple[DataFrame, list]:
    """Counts by class (n0, n1) of what exceeds D in a class, and aggregates of the total and the kept mass by class."""
    wide = rows.groupBy(key).agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)))
    return wide.where(f"n0 > {D} or n1 > {D}"), [f(y) for y in (0, 1) for f in (lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"t{y}"), lambda y: F.sum(F.when(F.col("y") == y, F.greatest(F.col("n") - D, F.lit(0.0))).otherwise(0.0)).alias(f"k{y}"))]


def count(rows: DataFrame, docs: DataFrame) -> Model:
    """The model from labelled (y, text) rows and the shared counts of all ``docs``."""
    triples = in_batches(rows.select("y", "text"), _triples, "y int, key string").distinct()
    pairs = written(triples.groupBy("y", F.expr("substring(key, instr(key, ' ') + 1)").alias("key")).agg(F.count("*").alias("n")), "pairs").withColumns({"v": F.substring_index("key", " ", 1), "w": F.substring_index("key", " ", -1)})
    contexts = written(pairs.groupBy("y", "w").agg(F.count("*").alias("n")), "contexts")
    kept, sums = _kept(contexts, "w")
    total = contexts.agg(*sums).first()
    words = {w: n for b in kept.toArrow().to_batches() for w, n in zip(b.column(0).to_pylist(), zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True), strict=True)}  # bounded by the sample
    kept, sums = _kept(pairs, "key")
    told = {tuple(k.split(" ")): n for b in kept.toArrow().to_batches() for k, n in zip(b.column(0).to_pylist(), zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True), strict=True)}
    heads = {r.v: [(r.t0, r.k0), (r.t1, r.k1)] for r in pairs.groupBy("v").agg(*sums).where("k0 > 0 or k1 > 0").collect()}
    vocabulary = rows.sparkSession.sparkContext.broadcast(frozenset({*words, *heads, *(w for _, w in told)}))

    def shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        every = 0
        for b in batches:
            for t in b.column(0):
                own = set(tokens(t.as_py()))
                every += len(own)
                seen.update(vocabulary.value.intersection(own))
        yield batch(_COUNT, [[*seen, " "], [*seen.values(), every]])

    corpus = {k: n for b in in_batches(docs.select("text"), shared_counts, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().to_batches() for k, n in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True)}
    return Model(words, [(total.t0 or 0, total.k0 or 0), (total.t1 or 0, total.k1 or 0)], told, heads, corpus, corpus.pop(" ", 0))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    shares = {r.y: r.n for r in usable.groupBy(F.col("toxic").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n = {y: shares.get(y, 0) for y in (0, 1)}
    prior = math.log((n[1] + 0.5) / (n[0] + 0.5))
    part = F.conv(F.substring(F.md5(F.concat(F.lit("part:"), F.col("doc_id").cast("string"), F.lit(f":{SEED}"))), 1, 4), 16, 10).cast("int") % 4
    rows = written(labelled_texts(docs, labels, "toxic", per_class, held_out()).withColumn("part", part), "labelled")
    model = count(rows.where("part > 0"), docs)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [shipped.value.features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in f], pa.float64()) for k in range(2))], names=["y", "f0", "f1"])

    seen = in_batches(rows.where("part = 0").select("y", "text"), look, "y int, f0 double, f1 double").toPandas()  # 4 * per_class rows at most
    y = seen["y"].to_numpy()
    if len(set(y)) < 2:
        model.beta = [0.0, 0.0, prior]
        return model
    x = seen[["f0", "f1"]].to_numpy()
    order = np.lexsort(x.T)
    beta = logistic(x[order], y[order], l2=1e-3, balance=1.0)
    model.beta = [float(beta[0]), float(beta[1]), float(beta[2]) + PRIOR_SHARE * prior]
    return model


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def op2_kneser_ney(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            p = [shipped.value.score(t.as_py()) for t in b.column(1)]
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            yield batch(_SCORE, [ids, held, p, [int(x >= 0.5) for x in p]])

    return in_batches(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, held_out boolean, score double, predicted int")

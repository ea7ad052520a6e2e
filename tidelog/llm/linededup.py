"""Substring dedup by hashing lines, the sentences within them, and overlapping stretches of words.

A unit is normalised (lower case, runs of white space as one blank), hashed and grouped over all documents; the occurrence with
the smallest (doc_id, offset) stays. There are three kinds:

* a whole line of at least ``UNIT_WORDS`` words goes in every other place (a shorter one is too common to tell a repeat from chance);
* a sentence of a line goes if it stands in a run of repeated sentences (shorter ones between them included) of at least
  ``RUN_WORDS`` words, so a phrase that two clean texts share by chance stays;
* a stretch of ``STRETCH`` words or a few more, from an anchor to an anchor, goes in every other place. Anchors are chosen by the
  words alone: of any ``GAP`` neighbouring pairs of words, the one with the least hash is an anchor. So equal passages have
  equal anchors wherever they start in a sentence, and a passage of ``STRETCH + 3 * GAP`` words (below 50) always holds a whole
  stretch; at each end fewer than ``GAP + 1`` words stay, beyond what its lines and sentences remove.

Digests have 64 bits. A line has two, and both must be repeated; a sentence needs its run; of single stretches about one in ten
million would go by chance at 10^13 units, none at 10^9. A removed span takes the white space after it; what is kept keeps its original offsets.

Texts are cut into words by array operations over whole batches. Only distinct (digest, doc_id) pairs are shuffled; the counts of
a digest merge before their shuffle, the join that tells documents of their repeats is one that Spark splits for a hot
digest, and the repeats of one document meet its text.

Edge cases: null and empty texts have no units (a null text stays null); rows with equal doc_id count as one document,
so they keep the same units; a document without doc_id neither counts nor changes; extra columns are ignored. Where a text
repeats a stretch that overlaps itself (one word over and over), what the first one covers stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

UNIT_WORDS, RUN_WORDS, STRETCH, GAP = 4, 20, 16, 11
PASSAGE_WORDS = 28  # of a removed span that counts as a passage: what at least goes of one of 50 words
CHARS = 1 << 20  # of the texts that one array operation takes; a longer text is taken alone
_SPACE = np.zeros(0x3002, bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
_STOPS = np.zeros(0x3002, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
LINE, SENTENCE, STRETCHED = 0, 1, 2
_KINDS = np.array([0x5851F42D4C957F2D, 0x27BB2EE687B0B0FD, 0x14057B7EF767814F], np.uint64)


class _Hashes(dict):
    """A hash per word, for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h


_HASHES = _Hashes()
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that they have inverses
_POWERS: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64),) * 2] * 2  # their powers and their inverses'


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[k][0]) < n:
        _POWERS[k] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(2 * n, x, np.uint64)]) for x in (_BASES[k], pow(_BASES[k], -1, 1 << 64)))
    return _POWERS[k][0][:n], _POWERS[k][1][:n]


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = best(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return best(x[: len(x) - rest], x[rest:]) if rest else x


@dataclass
class Units:
    """The units of some texts: which text, kind, number of words, first and last place there (code points), digest, and a line's other digest."""

    doc: np.ndarray
    kind: np.ndarray
    words: np.ndarray
    start: np.ndarray
    end: np.ndarray
    digest: np.ndarray
    other: np.ndarray
    following: np.ndarray  # where the word after a unit starts, or the text ends
    lines: np.ndarray  # of each text, the lines with words


def units(texts: list[str], unit_words: int = UNIT_WORDS) -> Units:
    """Lines, sentences, then stretches, each by their place."""
    big = "\n".join(texts)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])  # where every text starts in the whole
    code = np.frombuffer(big.encode(), np.uint8) if big.isascii() else np.minimum(np.frombuffer(big.encode("utf-32-le"), np.uint32), 0x3001)
    edge = np.flatnonzero(np.diff(_SPACE[code], prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    n = len(starts)
    h = np.fromiter(map(_HASHES.__getitem__, big.lower().split()), np.uint64, n)
    doc = np.searchsorted(first, starts, "right") - 1
    line = np.searchsorted(np.flatnonzero(code == 10), starts)
    opens = np.diff(line, prepend=-1) != 0
    a = np.flatnonzero(opens)
    counted = np.bincount(doc[a], minlength=len(texts))
    begins, until, kinds = [], [], []
    stops = np.r_[False, _STOPS[code[ends - 1]]][:n]  # the word before ends a sentence
    for kind, a in ((LINE, a), (SENTENCE, np.flatnonzero(opens | stops))):
        z = np.r_[a[1:], n][: len(a)]
        told = z - a >= unit_words
        begins.append(a[told]), until.append(z[told]), kinds.append(np.full(int(told.sum()), kind))
    if n > GAP:
        pair = (h[:-1] ^ h[:-1] >> np.uint64(29)) * np.uint64(_BASES[0]) + h[1:]
        least = _sliding(pair, GAP, np.minimum)
        least[doc[: len(least)] != doc[GAP:]] = 0  # windows that leave a text choose none
        edges = np.zeros(GAP - 1, np.uint64)
        anchors = np.flatnonzero((_sliding(np.r_[edges, least, edges], GAP, np.maximum) == pair) & (pair > 0))
        after = np.searchsorted(anchors, anchors + STRETCH)
        whole = after < len(anchors)
        b, e = anchors[whole], anchors[after[whole]]
        own = doc[b] == doc[e]
        begins.append(b[own]), until.append(e[own] + 1), kinds.append(np.full(int(own.sum()), STRETCHED))
    a, z, kind = (np.concatenate(x).astype(np.int64) for x in (begins, until, kinds))
    found = []
    for k, mixed in enumerate((h, (h ^ h >> np.uint64(31)) * _KINDS[0])):
        some = slice(None) if not k else slice(0, len(begins[0]))  # the other digest is for lines
        up, down = _powers(k, n + 1)
        sums = np.r_[np.uint64(0), np.cumsum(mixed * up[:n])]
        d = (sums[z[some]] - sums[a[some]]) * down[a[some]] + _KINDS[kind[some]] + (z - a)[some].astype(np.uint64)
        found.append((d ^ d >> np.uint64(32)).view(np.int64))
    d = doc[a]
    after = np.minimum(np.r_[starts, len(big)][z], first[d + 1] - 1)
    return Units(d, kind, z - a, starts[a] - first[d], ends[z - 1] - first[d], *found, after - first[d], counted)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > CHARS:
            yield at, k
            at, held = k, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


_KEYS = pa.schema([("digest", pa.int64()), ("doc_id", pa.int64())])


def _emit(unit_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for p, q in _chunks(texts):
                u = units(texts[p:q], unit_words)
                doc, d = np.r_[u.doc, u.doc[: len(u.other)]], np.r_[u.digest, u.other]
                order = np.lexsort((d, doc))
                doc, d = doc[order], d[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (d[1:] != d[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(d[new]), pa.array(ids[p:q][doc[new]])], schema=_KEYS)

    return work


def _of(doc: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """A digest within a text of the batch."""
    return digest.astype(np.int64).view(np.uint64) ^ doc.astype(np.uint64) * np.uint64(_BASES[1])


def removals(texts: list[str], doc: np.ndarray, digest: np.ndarray, unit_words: int = UNIT_WORDS, run_words: int = RUN_WORDS) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """The lines of each text and the spans to remove, given (doc, digest): what of each text an earlier document holds."""
    u = units(texts, unit_words)
    known, own = _of(doc, digest), _of(u.doc, u.digest)
    before = np.isin(own, known)
    n = len(u.other)
    before[:n] &= np.isin(_of(u.doc[:n], u.other), known)
    order = np.lexsort((u.start, own))
    same = np.zeros(len(order), bool)
    same[1:] = own[order][1:] == own[order][:-1]
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
    again, firsts = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    again[order], firsts[order] = same, lead
    goes = before | again
    start = np.where(before, u.start, np.where(again, np.maximum(u.start, u.following[firsts]), u.start))
    # Sentences: runs of those that go, within a text, and of enough words.
    s = np.flatnonzero(u.kind == SENTENCE)
    new = np.ones(len(s), bool)
    new[1:] = (u.doc[s][1:] != u.doc[s][:-1]) | (goes[s][1:] != goes[s][:-1])
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(s)][: len(at)] - 1
    long = goes[s][at] & (np.add.reduceat(u.words[s], at) >= run_words) if len(at) else np.zeros(0, bool)
    whole = np.flatnonzero(goes & (u.kind != SENTENCE) & (start < u.following))
    docs = np.r_[u.doc[whole], u.doc[s[at[long]]]]
    a, z = np.r_[start[whole], u.start[s[at[long]]]], np.r_[u.following[whole], u.following[s[last[long]]]]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    order = np.lexsort((z, a, docs))
    for i, a, z in zip(docs[order].tolist(), a[order].tolist(), z[order].tolist(), strict=True):
        held = spans[i]
        if held and a <= held[-1][1]:
            held[-1] = (held[-1][0], max(held[-1][1], z))
        else:
            held.append((a, z))
    return u.lines, spans


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_passage_removed", pa.int64()), ("removed", pa.string()), ("kept", pa.string()), ("text", pa.string())])


def _clean(unit_words: int, run_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            lists = b.column(2)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            digests = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.cumsum(np.r_[0, counts])
            for p, q in _chunks([t or "" for t in texts]):
                here = [t or "" for t in texts[p:q]]
                lines, spans = removals(here, np.repeat(np.arange(q - p), counts[p:q]), digests[at[p] : at[q]], unit_words, run_words)
                rows: list[list] = [[] for _ in _RESULT]
                for i, t, n, gone in zip(ids[p:q], texts[p:q], lines.tolist(), spans, strict=True):
                    size = len(t or "")
                    if i is None:
                        gone = []
                    kept, edge = [], 0
                    for a, z in [*gone, (size, size)]:
                        if a > edge:
                            kept.append((edge, a))
                        edge = z
                    text = t if not gone or t is None else "".join(t[a:z] for a, z in kept)
                    for c, v in zip(rows, (i, n, sum(z - a for a, z in gone), sum(z - a for a, z in gone if len(t[a:z].split()) >= PASSAGE_WORDS), ",".join(f"{a}:{z}" for a, z in gone), ",".join(f"{a}:{z}" for a, z in kept), text), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _RESULT, strict=True)], schema=_RESULT)

    return work


def op9_line_dedup(docs: DataFrame, unit_words: int = UNIT_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_units (lines with words), n_removed (code points), n_passage_removed (those of spans of PASSAGE_WORDS words or more, so that
    repeated passages are told from single boilerplate lines), removed and kept spans (start:end of the original), text (what is kept)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    keys = in_batches(rows.where("doc_id is not null and text is not null"), _emit(unit_words), "digest long, doc_id long")
    first = keys.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    later = keys.join(first, "digest").where("doc_id > first")
    by_doc = later.groupBy("doc_id").agg(F.collect_list("digest").alias("repeated"))  # at most its own units
    return in_batches(rows.join(by_doc, "doc_id", "left"), _clean(unit_words, run_words), "doc_id long, n_units long, n_removed long, n_passage_removed long, removed string, kept string, text string")

"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint's 64 bits are majority votes of the XXH64 hashes of its word shingles. Each bit
position gets a non-zero label of r + 1 bits (r: the radius); table v, for each of the 2^(r+1) - 1 non-zero
vectors v, keeps the positions whose label has odd parity with v. Labels of r differing positions span at
most r of r + 1 dimensions, so some v is orthogonal to all of them and that table's masked fingerprints are equal:
every pair within the radius collides in at least one table, none is lost.

Only distinct fingerprints enter the tables, each once per table. A bucket is searched outward from one
member at a time and gives a spanning forest of its links, not its pairs. A bucket over ``BUCKET``
fingerprints is never held: its members are dealt again by r + 1 segments of the bits its table
ignores (a pair within the radius agrees on one of them), and a bucket still over that
is searched in place, at eight bytes a member.

Edge cases: null and empty texts have fingerprint zero and link as any other; texts with fewer words than a shingle
hash their whole sequence; repeated rows share a component; a null doc_id gets a fingerprint and its
component's smallest doc_id (null if it has none); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, in_batches, written
from .graph import connected_components

SHINGLE, RADIUS, SEED, BUCKET = 4, 4, 42, 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z, and blank, tab to carriage return, only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, fp) and long columns to ``keep``: fp holds the fingerprint's bits as a signed long."""
    more = keep or []
    schema = pa.schema([*_FP, *((c, pa.int64()) for c in more)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f), *b.columns[2:]], schema=schema)

    return in_batches(docs.select(F.col("doc_id").cast("long"), "text", *more), work, ", ".join(f"{c} long" for c in schema.names))


def masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """One mask of 64 bits for each table of the cover."""
    rng = np.random.default_rng(seed)
    labels = rng.permutation([1 + k % (2 ** (radius + 1) - 1) for k in range(64)])  # each label about as often
    return [sum(1 << i for i, m in enumerate(labels) if (int(m) & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def segments(mask: int, radius: int) -> list[int]:
    """radius + 1 masks that share out the bits which ``mask`` ignores."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]


def spanning_links(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same fingerprints (distinct, unsigned) as all pairs within the radius do."""
    left, us, vs = np.arange(len(f)), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        edge = np.array([root])
        while len(edge) and len(left):
            now, edge = edge[:64], edge[64:]
            near = np.zeros(len(left), bool)
            for at in range(0, len(left), 1 << 16):
                near[at : at + (1 << 16)] = (np.bitwise_count(f[left[at : at + (1 << 16)]][None, :] ^ f[now][:, None]) <= radius).any(axis=0)
            if near.any():
                found, left = left[near], left[~near]
                us.append(f[found]), vs.append(np.full(len(found), f[root]))
                edge = np.r_[edge, found]
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, f.dtype), np.zeros(0, f.dtype))


_LINK = pa.schema([("t", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])


def _bucket_links(radius: int, most: int | None):
    """Sorted (t, key, fp) rows to links (t null), and the members (t, u = key, v = fp) of buckets over ``most``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = key = fp = None
        over = None  # the bucket whose members now pass through

        def out(tables, u, v):
            return pa.RecordBatch.from_arrays([pa.array(tables, pa.int32()) if tables is not None else pa.nulls(len(u), pa.int32()), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=_LINK)

        def closed(t, key, fp):
            """Links of whole buckets."""
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(t)]
            f = fp.view(np.uint64)
            two = starts[ends - starts == 2]
            near = two[np.bitwise_count(f[two] ^ f[two + 1]) <= radius]
            us, vs = [f[near + 1]], [f[near]]
            for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                u, v = spanning_links(f[a:b], radius)
                us.append(u), vs.append(v)
            return out(None, np.concatenate(us), np.concatenate(vs))

        for b in batches:
            if not b.num_rows:
                continue
            bt, bk, bf = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if over is not None:
                same = (bt == over[0]) & (bk == over[1])
                n = len(bt) if same.all() else int((~same).argmax())
                yield out(bt[:n], bk[:n], bf[:n])
                if n == len(bt):
                    continue
                over, bt, bk, bf = None, bt[n:], bk[n:], bf[n:]
            if t is not None:
                bt, bk, bf = np.r_[t, bt], np.r_[key, bk], np.r_[fp, bf]
            last = (bt != bt[-1]) | (bk != bk[-1])
            n = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # the last bucket may go on
            if n:
                cut = np.flatnonzero(np.r_[True, (bt[1:n] != bt[: n - 1]) | (bk[1:n] != bk[: n - 1])])
                if most is not None and (sizes := np.diff(np.r_[cut, n])).max() > most:
                    wide = np.repeat(sizes > most, sizes)
                    yield out(bt[:n][wide], bk[:n][wide], bf[:n][wide])
                    yield closed(bt[:n][~wide], bk[:n][~wide], bf[:n][~wide]) if not wide.all() else out(None, bf[:0], bf[:0])
                else:
                    yield closed(bt[:n], bk[:n], bf[:n])
            t, key, fp = bt[n:], bk[n:], bf[n:]
            if most is not None and len(t) > most:
                over = (t[0], key[0])
                yield out(t, key, fp)
                t = key = fp = None
        if t is not None and len(t):
            yield closed(t, key, fp)

    return work


def _dealt(keyed: DataFrame, radius: int, most: int | None) -> DataFrame:
    return in_batches(keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp"), _bucket_links(radius, most), "t int, u long, v long")


def links(distinct: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(u, v) over fingerprints: their components are those of all pairs within the radius."""
    cover = masks(radius)
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(cover)))).alias("x")).select("x.t", "x.key", "fp")
    found = written(_dealt(keyed, radius, most), "links")
    near = found.where("t is null").select("u", "v")
    wide = found.where("t is not null")
    if not wide.isEmpty():
        parts = [[_signed(s) for s in segments(m, radius)] for m in cover]
        rows = wide.select("t", F.col("u").alias("key"), F.col("v").alias("fp"), F.element_at(F.array(*(F.array(*map(F.lit, p)) for p in parts)), F.col("t") + 1).alias("p"))
        again = rows.select("t", "key", "fp", F.posexplode("p").alias("s", "m"))
        again = again.select((F.col("t") * (radius + 1) + F.col("s")).alias("t"), F.xxhash64("key", F.col("fp").bitwiseAND(F.col("m"))).alias("key"), "fp")
        near = near.unionByName(_dealt(again, radius, None).select("u", "v"))
    return near


def named(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint of ``fps`` (doc_id, fp; a stored table): the component's smallest fingerprint and doc_id."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    cc = connected_components(links(distinct, radius), "simhash")
    linked = written(cc.withColumnRenamed("node", "fp").join(distinct, "fp"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = linked.join(least, "component").select("fp", "component", "component_id")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))


def op7_simhash(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    fps = written(fingerprints(docs), "fps")
    found = fps.join(named(fps, radius), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row stays, that with the smallest doc_id (null last).

    Rows are told apart by doc_id and a hash of all their columns, so that rows which share a doc_id but not a text
    are kept or dropped each for itself; of wholly equal rows one stays."""
    names = docs.columns
    inner = [c if c in ("doc_id", "text") else f"_in_{k}" for k, c in enumerate(names)]  # clear of the columns that are made here
    rows = docs.toDF(*inner).withColumn("_row", F.xxhash64(*inner))
    fps = written(fingerprints(rows, keep=["_row"]), "fps")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")
    stay = fps.join(named(fps, radius), "fp").groupBy("component").agg(F.min(order).alias("m"), F.count("*").alias("k")).select("m.doc_id", "m._row", "k")
    stay = written(stay, "kept")
    same = (rows["_row"] == stay["_row"]) & rows["doc_id"].eqNullSafe(stay["doc_id"])
    few = rows.join(stay.select("doc_id", "_row"), same, "left_semi")
    if not stay.where("k > 1").isEmpty():  # a row that stays may have equals
        few = few.dropDuplicates(["doc_id", "_row"])
    return few.select(*inner).toDF(*names)

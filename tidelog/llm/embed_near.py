"""Embedding near-duplicates by sorted projection passes.

A pass splits the vectors by seeded random projections, level by level, at the median of what a range holds (of a bounded
seeded sample of the vectors), until a range has ``LEAF`` vectors or fewer; so a crowded region is split about its own
centre and not about the origin. The vectors are ordered by range and those of one range are all compared; a pair counts only if its cosine, in
double precision, reaches the threshold. A range emits links that join parts not yet joined in
its task. The passes' links are united into components. Up to ``LEAF`` vectors of a dimension are one range, hence exact.

There are ``passes`` passes at least, and as many more as the data asks: pairs at the threshold are planted beside sampled
vectors, the share of passes that keeps each together is taken, and passes are added until the expected share of such pairs that no pass keeps together is ``MISS`` at most.

Equal vectors are compared once (one representative with a count). Links are then counted exactly inside
components: the members of a component are dealt into blocks (of 64 up to 256 blocks, then larger ones, 4096 at most),
each pair of blocks is one matrix product that returns a count per member, so a large component costs products but
never emits pairs and no task holds more than two blocks.

A pair is missed only if no pass keeps it in one range and no chain of found links joins it.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
their own component; vectors of unlike dimension never link; rows that repeat a vec_id count as
separate vectors with one id; a null vec_id has a null component unless its vector links; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, written
from .graph import connected_components

THRESHOLD, PASSES, SEED = 0.9, 24, 7
LEAF, SAMPLE, PLANTED, MISS = 1024, 16_384, 1024, 1e-3  # vectors of a range; sampled at least; pairs to measure by; share of pairs that may be missed
BLOCK, BLOCKS, MOST = 64, 256, 4096  # rows of a block; blocks before they grow; rows of the largest


def usable(column: str = "embedding") -> F.Column:
    c = F.col(column)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision; lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dimension(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    dims = np.array(b.column(at).value_lengths())
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        yield int(d), rows, _matrix(b.column(at).take(pa.array(rows)))


class Passes:
    """The splits of every pass for one dimension: a direction for each level, and a bound for each range of a level."""

    def __init__(self, sample: np.ndarray, count: int, least: int, threshold: float, seed: int, leaf: int) -> None:
        d = sample.shape[1]
        self.levels = max(0, int(np.ceil(np.log2(max(count, 1) / leaf))))
        self.rng, self.directions, self.bounds = np.random.default_rng([seed, d]), [], []
        if not self.levels or not len(sample):
            self.levels, self.number = 0, 1
            return
        self._grow(sample, least)
        x = sample[self.rng.permutation(len(sample))[:PLANTED]]
        u = self.rng.standard_normal(x.shape)
        u -= (u * x).sum(axis=1, keepdims=True) * x
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
        kept = np.zeros(len(x))
        while True:
            while self.seen < len(self.directions):
                kept += self.keys(x, self.seen) == self.keys(y, self.seen)
                self.seen += 1
            share = (kept + 0.5) / (self.seen + 1)  # no pair counts as hopeless
            if self.number >= least and ((1 - share) ** self.number).mean() <= MISS:
                break
            self._grow(sample, 8)

    seen = 0

    def _grow(self, sample: np.ndarray, more: int) -> None:
        for _ in range(more):
            g = self.rng.standard_normal((sample.shape[1], self.levels))
            at, node, bounds = sample @ g, np.zeros(len(sample), np.int64), []
            for k in range(self.levels):
                order = np.lexsort((at[:, k], node))
                first = np.searchsorted(node[order], np.arange(1 << k))
                n = np.diff(np.r_[first, len(node)])
                middle = np.zeros(1 << k)
                middle[n > 0] = at[order[(first + n // 2)[n > 0]], k]
                bounds.append(middle)
                node = 2 * node + (at[:, k] >= middle[node])
            self.directions.append(g), self.bounds.append(bounds)
        self.number = len(self.directions)

    def keys(self, x: np.ndarray, p: int) -> np.ndarray:
        """The range of every row in pass ``p``."""
        node = np.zeros(len(x), np.int64)
        if self.levels:
            at = x @ self.directions[p]
            for k, middle in enumerate(self.bounds[p]):
                node = 2 * node + (at[:, k] >= middle[node])
        return node


_KEYED = pa.schema([("pass_key", pa.int64()), ("dim", pa.int32()), ("id", pa.int64()), ("embedding", pa.list_(pa.float64()))])


def plan_passes(vectors: DataFrame, threshold: float, passes: int, seed: int, leaf: int) -> dict[int, Passes]:
    """For every dimension, from a sample of ``vectors`` that is bounded (16 vectors a range, up to 2 ** 18 in all)."""
    counts = {r.dim: r.n for r in vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each dimension
    total = sum(counts.values())
    most = min(max(SAMPLE, total * 16 // leaf), 1 << 18)
    share = min(1.0, most / max(total, 1))
    picked = vectors.where(F.pmod(F.xxhash64("embedding", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding")
    found: dict[int, list[np.ndarray]] = {}
    for b in picked.toArrow().to_batches():
        for d, _, x in _by_dimension(b, 0):
            found.setdefault(d, []).append(x)
    out = {}
    for d, n in counts.items():
        x = np.concatenate(found.get(d, [np.zeros((0, d))]))
        out[d] = Passes(x[np.lexsort(x.T[:2])] if len(x) else x, n, passes, threshold, seed, leaf)
    return out


def _project(plans):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, rows, x in _by_dimension(b, 1):
                take = pa.array(rows)
                ids, vectors = b.column(0).take(take), b.column(1).take(take).cast(pa.list_(pa.float64()))
                plan = plans.value[d]
                for p in range(plan.number):
                    yield pa.RecordBatch.from_arrays([pa.array((p << 40) + plan.keys(x, p)), pa.array(np.full(len(rows), d, np.int32)), ids, vectors], schema=_KEYED)

    return work


class _Forest(dict):
    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = self[x]
        return x


_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _compare(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def flush() -> pa.RecordBatch:
            us, vs = [], []
            ids = np.concatenate([i for i, _ in held])
            x = np.concatenate([v for _, v in held])
            for a in range(0, len(x), 512):
                for z in range(a, len(x), 4096):
                    i, j = np.nonzero(x[a : a + 512] @ x[z : z + 4096].T >= threshold)
                    ahead = a + i < z + j
                    for u, v in zip(ids[a + i[ahead]].tolist(), ids[z + j[ahead]].tolist(), strict=True):
                        ru, rv = forest.root(u), forest.root(v)
                        if ru != rv:
                            forest[max(ru, rv)] = min(ru, rv)
                            us.append(u), vs.append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=_PAIR)

        for b in batches:
            keys, dims, every = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(dims) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if a == z:
                    continue
                here = (int(dims[a]), int(keys[a]))
                if held and here != now:
                    yield flush()
                now = here
                held.append((every[a:z], _matrix(b.column(3).slice(a, z - a))))
        if held:
            yield flush()

    return work


def find_links(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, seed: int = SEED, leaf: int = LEAF) -> DataFrame:
    """(u, v): verified pairs of (id, embedding) rows, enough of them to join what the passes find."""
    plans = vectors.sparkSession.sparkContext.broadcast(plan_passes(vectors, threshold, passes, seed, leaf))
    keyed = in_batches(vectors.select("id", "embedding"), _project(plans), "pass_key long, dim int, id long, embedding array<double>")
    dealt = keyed.repartition("dim", "pass_key").sortWithinPartitions("dim", "pass_key", "id")
    return in_batches(dealt.select("pass_key", "dim", "id", "embedding"), _compare(threshold), "u long, v long").distinct()


def _count(threshold: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64())])

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = _matrix(group["embedding"].chunk(0))
        ids, n, side = (group[c].to_numpy() for c in ("id", "n", "side"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(b)  # a block with itself
        if alone:
            b = a
        left, right = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            s = x[part] @ x[b].T >= threshold
            if alone:
                s[np.arange(len(part)), np.arange(at, at + len(part))] = False
            left[at : at + 512] = s @ n[b]
            right += n[part] @ s
        if alone:
            return pa.Table.from_arrays([pa.array(ids[a]), pa.array(left)], schema=schema)
        return pa.Table.from_arrays([pa.array(np.r_[ids[a], ids[b]]), pa.array(np.r_[left, right])], schema=schema)

    return work


def count_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, links): for each of (component, id, n, embedding), the rows (n each) within its component that reach the threshold."""
    sizes = members.groupBy("component").agg(F.count("*").alias("_k")).select("component", F.greatest(F.least(F.ceil(F.col("_k") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("_k") / MOST)).cast("int").alias("_blocks"))
    dealt = members.join(sizes, "component").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least("_own", j).alias("a"), F.greatest("_own", j).alias("b"), (F.col("_own") > j).cast("int").alias("side")))
    # One key: by component, a and b Spark would keep the join's partitions, a component in each.
    pairs = dealt.select("component", "id", "n", "embedding", F.explode(other).alias("p")).select(F.struct("component", "p.a", "p.b").alias("cell"), "p.side", "id", "n", "embedding")
    return pairs.groupBy("cell").applyInArrow(_count(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def op3_projection_passes(embeddings: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``embeddings``.

    Equal vectors are known by a digest of 128 bits; rows meet their vector's result by it, so no vector is shuffled for that, and Spark splits the copies of a hot one."""
    numbers = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))  # one zero
    rows = embeddings.select(F.col("vec_id").cast("long"), numbers.alias("embedding")).select("*", F.xxhash64("embedding").alias("d1"), F.xxhash64(F.lit(SEED), "embedding").alias("d2"))
    valid = rows.where(usable())
    reps = valid.groupBy("d1", "d2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())
    reps = written(reps, "vectors")  # stored, so the ids stay
    cc = written(connected_components(find_links(reps, threshold, passes), "embeddings"), "components")
    members = cc.withColumnRenamed("node", "id").join(reps, "id")
    links = count_links(members.select("component", "id", "n", "embedding"), threshold)
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = members.select("id", "component").join(least, "component").join(links, "id", "left").select("id", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    every = reps.join(named, "id", "left").select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    found = rows.select("vec_id", "d1", "d2").join(every, ["d1", "d2"], "left")
    out = found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

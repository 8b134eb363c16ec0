"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Nearness is the inner product.  What differs between candidates is the product with the
offset from the mean, so rows are centred and queries are not.  Rows are dealt by the
length of their offset: the shorter half is one range, half of the others the next, and so
on.  In a range every offset gets one more component that brings all to the range's
greatest length, and queries a zero there; the nearest by product are then the nearest by
angle, whatever the lengths.

Vectors are rotated by directions learned on a bounded sample (principal axes, then an
iterative rotation towards the corners of the cube) and cut to sign bits; several
learned rotations give a code of CODE_BITS.  Codes are split into substrings, and every
shard of vectors holds one table a substring, addressed by its value.  A query looks up,
per substring, the values within its share of the Hamming radius; by the pigeonhole
principle no code within the radius is missed.  Codes found are reranked by the exact
inner product.

The index is dealt in shards of SHARD vectors and the stated query set in blocks; each
block visits each shard and brings back its best k, so what is shuffled is k rows a
query and shard, and memory is bounded by a shard and a block.  The radius of a query
in a shard starts small and grows until enough codes are found; nothing is cut off
before ranking, so copies of one vector, however many, are all candidates.

Defined results.  Vectors that are null, all zero, of another length than most, or that
hold null or non-finite components take no part, neither as queries nor as candidates;
so do rows with a null id.  Ties go to the smaller id; rows that repeat an id are
candidates of their own.  A query's own row is not its neighbour.  With fewer candidates
than k all are returned.  An empty table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

#: Rows that fit the rotations (a documented bound), rotations and rounds of fitting.
SAMPLE, ROTATIONS, FIT_ROUNDS = 20_000, 2, 20
#: Bits of a substring of the code.
PART_BITS = 16
#: Rows of a shard of the index and of a block of queries.
SHARD, BLOCK = 16_384, 4096
#: Share of a shard, and least number of codes, that probing must find before ranking.
REACH, LEAST = 0.1, 200
#: Ranges of offset lengths at most, and rows of the sample that the last of them holds at least.
RANGES, LAST = 10, 16


def usable(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.col(vec).isNotNull() & (F.size(v) > 0)
    ok = ok & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(ok, F.lit(False)))


def fit(sample: np.ndarray, rotations: int = ROTATIONS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and projection (dimensions + 1 x bits): learned rotations of the principal axes.

    Directions alone are learned, so long vectors do not outweigh short ones; the last row
    weighs the component that is added to offsets.
    """
    mean = sample.mean(0)
    x = sample - mean
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    z = x @ axes
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(FIT_ROUNDS):
            u, _, vt = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ vt).T
        parts.append(axes @ r)
    projection = np.concatenate(parts, 1)
    return mean, np.concatenate([projection, rng.normal(size=(1, projection.shape[1])) / np.sqrt(len(mean))])


def edges_of(lengths: np.ndarray) -> list[float]:
    """Lengths at which ranges end: of the sample half is below the first, half of the rest below the next."""
    order = np.sort(lengths)
    out: list[float] = []
    at = len(order) // 2
    while len(out) < RANGES - 1 and len(order) - at >= LAST:
        if not out or order[at] > out[-1]:
            out.append(float(order[at]))
        at += (len(order) - at) // 2
    return out


def codes_of(vectors: np.ndarray, projection: np.ndarray, added: np.ndarray | float = 0.0) -> np.ndarray:
    """Rows of packed sign bits, padded to whole substrings."""
    bits = vectors @ projection[:-1] + np.asarray(added).reshape(-1, 1) * projection[-1] > 0
    pad = -bits.shape[1] % PART_BITS
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)


@lru_cache(1)
def probes() -> tuple[np.ndarray, np.ndarray]:
    """All substring differences, those of few bits first, and how many have at most so many bits."""
    masks = np.arange(1 << PART_BITS, dtype=np.uint16)
    bits = np.bitwise_count(masks)
    return masks[np.argsort(bits, kind="stable")], np.cumsum(np.bincount(bits))


class SubstringIndex:
    """Substring tables over the codes of one shard: per value the place of its rows."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view(">u2").astype(np.uint16)
        self.columns = np.ascontiguousarray(self.parts.T)
        self.order, self.starts = [], []
        for j in range(self.parts.shape[1]):
            self.order.append(np.argsort(self.parts[:, j], kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(self.parts[:, j], minlength=1 << PART_BITS))]))

    def lookup(self, part: int, value: np.uint16, reach: int) -> np.ndarray:
        """Rows whose substring is within `reach` of `value`: one look at each such value's place.

        Where there are more such values than rows, the rows are looked at instead.
        """
        masks, upto = probes()
        if upto[min(reach, PART_BITS)] > len(self.codes):
            return np.flatnonzero(np.bitwise_count(self.columns[part] ^ value) <= reach)
        at = (value ^ masks[: upto[min(reach, PART_BITS)]]).astype(np.int64)
        first, end = self.starts[part][at], self.starts[part][at + 1]
        full = end > first
        first, n = first[full], (end - first)[full]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.order[part][np.repeat(first - (ends - n), n) + np.arange(total)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within `radius` of `code`: pigeonhole probing, then a check.

        With m substrings, a code within the radius has a substring within radius // m,
        and of those after the first radius % m + 1, one within radius // m - 1.
        """
        parts = code.view(">u2").astype(np.uint16)
        m = len(parts)
        share, extra = divmod(radius, m)
        mark = np.zeros(len(self.codes), bool)
        for j in range(m):
            reach = share if j <= extra else share - 1
            if reach >= 0:
                mark[self.lookup(j, parts[j], reach)] = True
        found = np.flatnonzero(mark)
        return found[self.distance(code, found) <= radius]

    def distance(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.codes[at] ^ code).sum(1, dtype=np.int64)

    def nearest(self, code: np.ndarray, want: int, first: int) -> tuple[np.ndarray, int]:
        """At least `want` codes, all within the radius that gave them; the radius grows as needed."""
        radius, bits, m = first, 8 * self.codes.shape[1], self.parts.shape[1]
        while True:
            found = self.within(code, radius)
            if len(found) >= min(want, len(self.codes)) or radius >= bits:
                return found, radius
            radius = min(bits, radius + max(2, m // 4))


def exact_scores(candidates: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    total = np.zeros(len(candidates))
    for j in range(candidates.shape[1]):
        total += candidates[:, j] * query[j]
    return total


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _searcher(mean: np.ndarray, projection: np.ndarray, longest: list[float], k: int) -> Callable:
    width = len(mean)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            q_ids, x_ids = (t.column("vec_id").to_numpy() for t in (left, right))
            q, x = (_matrix(t.column("v").combine_chunks(), width) for t in (left, right))
            offset = x - mean
            added = np.sqrt(np.maximum(longest[key[1].as_py()] ** 2 - (offset * offset).sum(1), 0.0))
            index, q_codes = SubstringIndex(codes_of(offset, projection, added)), codes_of(q, projection)
            order = np.argsort(x_ids, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            want = max(LEAST, k + 1, int(REACH * len(x_ids)))
            start, parts = 8 * index.codes.shape[1] // 3, [[], [], []]
            for i in range(len(q_ids)):
                found, radius = index.nearest(q_codes[i], want, start)
                start = max(0, radius - 1)
                found = found[x_ids[found] != q_ids[i]]
                score = exact_scores(x[found], q[i])
                top = np.lexsort((place[found], -score))[:k]
                parts[0].append(np.full(len(top), q_ids[i]))
                parts[1].append(x_ids[found[top]])
                parts[2].append(score[top])
            out = [np.concatenate(p) for p in parts]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The `k` nearest rows of `vectors` found for each row of `queries`: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    good, asked = stored(usable(vectors, id_col, vec), "vectors"), usable(queries, id_col, vec)
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()  # the documented bound
    if not drawn:
        return spark.createDataFrame([], schema)
    lengths = [len(r.v) for r in drawn]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    sample = np.array([r.v for r in drawn if len(r.v) == width])
    mean, projection = fit(sample)
    edges = edges_of(np.sqrt(((sample - mean) ** 2).sum(1)))
    good, asked = (d.filter(F.size("v") == width) for d in (good, asked))
    centre = F.array(*(F.lit(float(c)) for c in mean))
    length = F.sqrt(F.aggregate(F.zip_with("v", centre, lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x))
    good = good.withColumn("length", length).withColumn("range", reduce(add, (F.when(F.col("length") >= e, 1).otherwise(0) for e in edges), F.lit(0)))
    held = {r[0]: (r[1], r[2]) for r in good.groupBy("range").agg(F.count(F.lit(1)), F.max("length")).collect()}  # RANGES rows at most
    shards = {i: max(1, -(-n // SHARD)) for i, (n, _) in held.items()}
    longest = [held.get(i, (0, 0.0))[1] * (1 + 1e-9) for i in range(len(edges) + 1)]
    blocks = max(1, -(-asked.count() // BLOCK))
    spread = lambda count: F.pmod(F.xxhash64("vec_id"), count).cast("int")
    own = reduce(lambda c, i: c.when(F.col("range") == i[0], F.lit(i[1])), shards.items(), F.when(F.lit(False), F.lit(1)))
    # each query visits each shard once
    left = asked.withColumn("block", spread(F.lit(blocks))).withColumn("range", F.explode(F.array(*(F.lit(i) for i in shards)))).withColumn("shard", F.explode(F.sequence(F.lit(0), own - 1)))
    right = good.drop("length").withColumn("shard", spread(own)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["block", "range", "shard"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searcher(mean, projection, longest, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_twentieth(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.filter("vec_id % 20 = 0"))

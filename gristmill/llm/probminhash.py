"""Near-duplicate documents by ProbMinHash over weighted word shingles.

Every shingle of five words, weighted by its count, starts a Poisson process of that
rate; each arrival falls on a random component of the signature, which keeps the
earliest.  A shingle stops when its next arrival is later than the latest component, so
work ends early.  Two signatures agree in a component with the probability Jaccard
similarity of the weighted shingles.  BANDS bands of ROWS components pick candidates;
each candidate pair is verified by the exact probability Jaccard of whole texts.

Documents with equal shingle counts collapse into one node first, so copies are never
paired.  A bucket of n nodes gives n - 1 pairs, with its most central node, not all
pairs; verified links are joined into components.  Only buckets that still hold several
components stay open.  In open buckets of at most SMALL nodes all pairs between components
are verified; nodes of larger ones are blocked by their rarest shingles, a prefix of which
two nodes at the threshold must share one, and all pairs of a block between components
that can still reach the threshold are verified.  After that no pair that meets in a band
is left untried.

Defined results.  Null, empty and blank texts have no shingles and are classes of their
own.  Texts of one to four words are one shingle.  Very long texts are read whole.  Rows
that repeat an id are judged by their own texts.  Of a class the smallest id stays; null
ids stay only in classes without others.  An empty table gives an empty table.  Extra
columns are ignored by the operator and kept by `drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slabs
from .common import attach, likely, ship, stored, tidy

WORDS, THRESHOLD = 5, 0.8
#: 1 - (1 - 0.8 ** 5) ** 24 = 0.99993 of pairs at the threshold meet in a band.
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
SMALL = 16
#: 64-bit words of a node's bit map of shingles.
MAP_LONGS = 16
#: Bits of the cell of a shingle, by which common shingles are told from rare ones.
CELL_BITS = 20
#: Cells whose counts are one row between tasks.
BLOCK_CELLS = 1 << 14
CACHE_WORDS = 50_000
SALT = 256

U = np.uint64
_STEP = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift, multiply, shift, multiply, shift)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order and their counts."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(w))):
        total += mixed(w[j : j + n] + _STEP[j])
    if len(w) < WORDS:
        total += U(len(w))
    return np.unique(mixed(total), return_counts=True)


def signatures(hashes: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """ProbMinHash signatures (documents x COMPONENTS) of elements grouped by `doc`."""
    earliest = np.full(n_docs * COMPONENTS, np.inf)
    winner = np.zeros(n_docs * COMPONENTS, np.uint64)
    time = np.zeros(len(hashes))
    step = 0
    while len(hashes):
        draw = mixed(hashes + U((step * int(_STEP[0]) + int(_STEP[1])) % 2**64))
        time = time - np.log(((draw >> U(11)).astype(float) + 0.5) * 2.0**-53) / weights
        cell = doc * COMPONENTS + (mixed(draw ^ _STEP[2]) % U(COMPONENTS)).astype(np.int64)
        np.minimum.at(earliest, cell, time)
        first = time == earliest[cell]
        winner[cell[first]] = hashes[first]
        on = time < earliest.reshape(n_docs, COMPONENTS).max(1)[doc]
        hashes, weights, doc, time = hashes[on], weights[on], doc[on], time[on]
        step += 1
    return winner.reshape(n_docs, COMPONENTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (documents x BANDS)."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    total = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _STEP[0], parts.shape[:2]).copy()
    for j in range(ROWS):
        total = mixed(total + mixed(parts[:, :, j] + _STEP[j]))
    return total.view(np.int64)


def print_of(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """128-bit fingerprint of a shingle multiset."""
    c = counts.astype(np.uint64)
    a = (mixed(hashes + _STEP[3]) * mixed(c)).sum(dtype=np.uint64)
    b = (mixed(hashes ^ _STEP[4]) * mixed(c + _STEP[0])).sum(dtype=np.uint64)
    return np.array([a, b], "<u8").tobytes()


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets (sorted elements, weights)."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    p, q = x[i].astype(float), y[j].astype(float)
    order = np.argsort(-p / q, kind="stable")
    p, q = p[order], q[order]
    upto = x.sum() - p.sum() + np.cumsum(p)
    after = y.sum() - np.cumsum(q)
    return float((1 / (upto / p + after / q)).sum())


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for slab in slabs(batch.column(1)):
            told = [shingles(t) for t in slab]
            sizes = np.array([len(h) for h, _ in told])
            full = np.flatnonzero(sizes)
            keys = np.zeros((0, BANDS), np.int64)
            if len(full):
                doc = np.repeat(np.arange(len(full)), sizes[full])
                keys = band_keys(signatures(np.concatenate([told[i][0] for i in full]), np.concatenate([told[i][1] for i in full]).astype(float), doc, len(full)))
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            prints = [print_of(h, c) if len(h) else None for h, c in told]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(slab)), batch.column(2).slice(at, len(slab)), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))], names=["doc_id", "text_hash", "node", "keys"])
            at += len(slab)


def _shingler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of wanted nodes; a row whose text is another node's (a repeated id) is left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            nodes, hashes, counts = [], [], []
            for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                h, c = shingles(text or "")
                if len(h) and print_of(h, c) == node:
                    nodes.append(node)
                    hashes.append(h.tobytes())
                    counts.append(c.astype(np.uint32).tobytes() if c.max() > 1 else b"")
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["node", "hashes", "counts"])


def _verifier(threshold: float) -> Callable:
    def read(h: pa.Scalar, c: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint32)
        return hashes, counts if len(counts) else np.ones(len(hashes), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(n) for n in ("ha", "ca", "hb", "cb")]
            score = np.array([similarity(*read(ha, ca), *read(hb, cb)) for ha, ca, hb, cb in zip(*cols)])
            good = pa.array(np.flatnonzero(score >= threshold - 1e-9), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(good), batch.column("b").take(good)], names=["a", "b"])

    return run


#: Pairs or links up to this number take a short way: pairs are broadcast (32 bytes each),
#: links are joined by union-find in one task.  Beyond it both are shuffled.
FEW = 250_000


def verified(pairs: DataFrame, shingled: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose exact similarity reaches `threshold`.

    A node with many pairs is copied to one salt per SALT of them, so no key is hot.
    """
    few = pairs.count() <= FEW
    small = F.broadcast if few else lambda df: df
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    right = shingled.join(small(salts), shingled["node"] == salts["b"]).select("b", "salts", F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    salted = pairs.join(small(salts), "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
    left = shingled.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca")).join(small(salted), "a")
    return left.join(right, ["b", "salt"]).select("a", "b", "ha", "ca", "hb", "cb").mapInArrow(tidy(_verifier(threshold)), "a binary, b binary")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least node of each component by union-find with path halving."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([root(x) for x in nodes], pa.binary())], names=["node", "label"])


def components(links: DataFrame, name: str = "labels", few: int = FEW) -> DataFrame:
    """(node, label) of every linked node: the least node of its component.

    Up to `few` links (32 bytes each) one task joins them.  Beyond that labels spread
    along links and then jump to their label's label, so long chains shrink by halves;
    each round is a table in the shared folder.
    """
    if links.count() <= few:
        return stored(links.select("a", "b").coalesce(1).mapInArrow(_united, "node binary, label binary"), name)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = stored(both.distinct(), name + "-links")
    labels = stored(near.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    while True:
        spread = near.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        nearer = labels.join(spread, "node").select("node", "label", F.least("label", "other").alias("least"))
        jump = nearer.join(labels.select(F.col("node").alias("least"), F.col("label").alias("far")), "least", "left")
        after = stored(jump.select("node", F.least("least", F.coalesce("far", "least")).alias("label"), (F.least("least", F.coalesce("far", "least")) != F.col("label")).alias("moved")), name)
        labels = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return labels


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def first_pairs(bands: DataFrame) -> DataFrame:
    """Every node of a bucket with the one whose buckets are largest in sum."""
    central = bands.join(bands.groupBy("node").agg(F.sum("n").alias("c")), "node")
    centres = central.groupBy("key").agg(F.max(F.struct("c", "node"))["node"].alias("centre"))
    return ordered_pairs(bands.join(centres, "key").select(F.col("node").alias("a"), F.col("centre").alias("b")))


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node: distinct shingles, their total count, and a bit map of 64 * MAP_LONGS bits of them."""
    for batch in batches:
        hashes = [np.frombuffer(h.as_buffer(), np.uint64) for h in batch.column(1)]
        total = [int(np.frombuffer(c.as_buffer(), np.uint32).sum()) if len(c.as_buffer()) else len(h) for h, c in zip(hashes, batch.column(2))]
        bits = np.zeros((len(hashes), 64 * MAP_LONGS), bool)
        for i, h in enumerate(hashes):
            bits[i, (h % U(64 * MAP_LONGS)).astype(np.int64)] = True
        maps = np.packbits(bits, axis=1).view(np.int64)
        sizes = pa.array([len(h) for h in hashes], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(list(total), pa.int64()), *(pa.array(maps[:, j].copy()) for j in range(MAP_LONGS))], names=["node", "d", "t", *(f"m{j}" for j in range(MAP_LONGS))])


def open_buckets(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, n, node, label) of buckets that hold several components; all others are settled."""
    few = F.broadcast if labels.count() <= FEW else lambda df: df
    own = bands.filter("n > 2").join(few(labels), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    still = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    return attach(own, still.select("key", "n"), "key", "n", bands.count())


def small_pairs(buckets: DataFrame) -> DataFrame:
    """All pairs between components in open buckets of at most SMALL nodes."""
    small = buckets.filter(F.col("n") <= SMALL).select("key", "node", "label")
    other = small.select("key", F.col("node").alias("other"), F.col("label").alias("other_label"))
    return small.join(other, "key").filter("label <> other_label and node < other").select(F.col("node").alias("a"), F.col("other").alias("b"))


def _read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for h, c in zip(batch.column(1), batch.column(2)):
        hashes, counts = np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint32)
        yield hashes, counts.astype(np.int64) if len(counts) else np.ones(len(hashes), np.int64)


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - CELL_BITS)).astype(np.int64)


def _cell_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many nodes hold a shingle of each cell, per task: a row per block of cells that it met."""
    total = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        for hashes, _ in _read(batch):
            np.add.at(total, cell_of(hashes), 1)
    blocks, cells, counts = [], [], []
    for i, part in enumerate(total.reshape(-1, BLOCK_CELLS)):
        at = np.flatnonzero(part)
        if len(at):
            blocks.append(i)
            cells.append(at.astype(np.uint16).tobytes())
            counts.append(part[at].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], names=["block", "cells", "counts"])


def _block_adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each block, as counts of all its cells."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            own = total.setdefault(block, np.zeros(BLOCK_CELLS, np.int64))
            own[np.frombuffer(cells.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def cell_counts(told: DataFrame) -> np.ndarray:
    """Nodes of `told` (node, hashes, counts) per cell of their shingles; tasks send blocks of cells, not cells."""
    blocks = told.mapInArrow(tidy(_cell_counter), "block long, cells binary, counts binary").repartition("block")
    out = np.zeros(((1 << CELL_BITS) // BLOCK_CELLS, BLOCK_CELLS), np.int64)
    for block, counts in zip(*blocks.mapInArrow(tidy(_block_adder), "block long, counts binary").toArrow().columns):
        out[block.as_py()] += np.frombuffer(counts.as_buffer(), np.int64)
    return out.reshape(-1).astype(np.int32)


def _prefixer(common: np.ndarray, room: float) -> Callable:
    """Foremost shingles of each node, those of rare cells first, and what x / (1 - x) is before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, out, before = [], [], []
            for i, (hashes, counts) in enumerate(_read(batch)):
                n = common[cell_of(hashes)]
                order = np.lexsort((hashes, n))
                upto = np.cumsum(counts[order]) - counts[order]
                x = upto / (counts.sum() - upto)
                keep = (x <= room) & (n[order] > 1)
                node.append(np.full(int(keep.sum()), i))
                out.append(hashes[order][keep].view(np.int64))
                before.append(x[keep])
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), batch.column(0).take(pa.array(np.concatenate(node))), pa.array(np.concatenate(before))], names=["h", "node", "x"])

    return run


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node: distinct shingles, their total count, and a bit map of 64 * MAP_LONGS bits of them."""
    for batch in batches:
        hashes = [np.frombuffer(h.as_buffer(), np.uint64) for h in batch.column(1)]
        total = [int(np.frombuffer(c.as_buffer(), np.uint32).sum()) if len(c.as_buffer()) else len(h) for h, c in zip(hashes, batch.column(2))]
        bits = np.zeros((len(hashes), 64 * MAP_LONGS), bool)
        for i, h in enumerate(hashes):
            bits[i, (h % U(64 * MAP_LONGS)).astype(np.int64)] = True
        maps = np.packbits(bits, axis=1).view(np.int64)
        sizes = pa.array([len(h) for h in hashes], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(list(total), pa.int64()), *(pa.array(maps[:, j].copy()) for j in range(MAP_LONGS))], names=["node", "d", "t", *(f"m{j}" for j in range(MAP_LONGS))])


def open_buckets(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, n, node, label) of buckets that hold several components; all others are settled."""
    few = F.broadcast if labels.count() <= FEW else lambda df: df
    own = bands.filter("n > 2").join(few(labels), "node", "left").select("key", "n", "node", F.coalesce("label", "node").alias("label"))
    still = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return own.join(still.select("key"), "key")


def small_pairs(buckets: DataFrame) -> DataFrame:
    """All pairs between components in open buckets of at most SMALL nodes."""
    small = buckets.filter(F.col("n") <= SMALL).select("key", "node", "label")
    other = small.select("key", F.col("node").alias("other"), F.col("label").alias("other_label"))
    return small.join(other, "key").filter("label <> other_label and node < other").select(F.col("node").alias("a"), F.col("other").alias("b"))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of each node with their counts and the node's total."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            hashes = [np.frombuffer(h.as_buffer(), np.int64) for h in part.column(1)]
            counts = [np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64) if len(c.as_buffer()) else np.ones(len(h), np.int64) for h, c in zip(hashes, part.column(2))]
            sizes = np.array([len(h) for h in hashes])
            total = np.repeat(np.array([c.sum() for c in counts]), sizes)
            node = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
            yield pa.RecordBatch.from_arrays([node, pa.array(np.concatenate(hashes)), pa.array(np.concatenate(counts)), pa.array(total)], names=["node", "h", "c", "total"])


def rest_pairs(nodes: DataFrame, shingled: DataFrame, threshold: float) -> DataFrame:
    """All pairs of `nodes` (node, label) with different labels that can reach `threshold`.

    If shares x and y of two nodes lie in shingles that the other lacks, their similarity
    is at most 1 / (1 + x / (1 - x) + y / (1 - y)).  With shingles in one order, all before
    the first common one are such; so it is enough to look at pairs in the block of a
    shingle before which both sums of x / (1 - x) together are at most 1 / `threshold` - 1.
    The order is by how often a shingle's cell occurs, rare ones first (any order is right;
    2 ** CELL_BITS counts, the proven bound of what is broadcast, make blocks small).  Bits
    that differ in the nodes' bit maps bound the number of common shingles, and so both
    shares, once more.  In a block all nodes outside its largest component meet all nodes,
    in salted parts; the join itself makes only pairs that both bounds allow.
    """
    room = 1 / threshold - 1 + 1e-6
    told = stored(shingled.join(nodes, "node", "left_semi").select("node", "hashes", "counts"), "near-told")
    common = cell_counts(told)
    prefix = stored(told.mapInArrow(tidy(_prefixer(common, room)), "h long, node binary, x double").join(nodes, "node"), "near-prefixes")
    per = prefix.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"))
    blocks = per.groupBy("h").agg(F.max(F.struct("n", "label"))["label"].alias("chief"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    held = attach(prefix, blocks.drop("labels"), "h", "n", prefix.count()).withColumn("salts", F.ceil(F.col("n") / SALT).cast("int"))
    longs = [f"m{j}" for j in range(MAP_LONGS)]
    outlines = told.mapInArrow(tidy(_outlines), "node binary, d long, t long, " + ", ".join(f"{m} long" for m in longs))
    held = stored(held.join(outlines, "node"), "near-blocks")
    own, theirs = ["x", "d", "t", *longs], ["y", "e", "u", *(f"n{j}" for j in range(MAP_LONGS))]
    dealt = held.select("h", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.col("node").alias("b"), F.col("label").alias("other"), *(F.col(c).alias(n) for c, n in zip(own, theirs)))
    strays = held.filter("label <> chief").select("h", F.col("node").alias("a"), "label", *own, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    apart = reduce(add, (F.bit_count(F.col(f"m{j}").bitwiseXOR(F.col(f"n{j}"))) for j in range(MAP_LONGS)))
    common = (F.col("d") + F.col("e") - apart) / 2  # at most; the k most frequent of d shingles hold at most k + t - d
    spare = F.greatest(F.lit(1.0), F.col("t") / (common + F.col("t") - F.col("d"))) + F.greatest(F.lit(1.0), F.col("u") / (common + F.col("u") - F.col("e")))
    fit = (F.col("label") != F.col("other")) & (F.col("x") + F.col("y") <= room) & (common >= 1) & (spare - 2 <= room)
    return ordered_pairs(strays.join(dealt, ["h", "salt"]).filter(fit).select("a", "b"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), class_size, kept."""
    return classified(docs, id_col, text, threshold).drop("text_hash")


def classified(docs: DataFrame, id_col: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """`near_classes` with the hash of each row's text, which tells rows of one id apart."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = base.withColumn("text_hash", F.xxhash64("text"))
    signed = stored(hashed.mapInArrow(tidy(_signer), "doc_id long, text_hash long, node binary, keys array<long>"), "near-signed")
    nodes = stored(signed.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "near-nodes")
    banded = nodes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bands = stored(banded.join(shared, "key").select("key", "node", "n"), "near-bands")

    wanted = nodes.select("node", "rep").join(bands.select("node").distinct(), "node", "left_semi")
    reps = likely(base, F.col("doc_id"), wanted.select("rep"), nodes.count())
    texts = wanted.join(reps, wanted["rep"].eqNullSafe(reps["doc_id"])).select("node", "text")
    shingled = stored(texts.mapInArrow(tidy(_shingler), "node binary, hashes binary, counts binary").dropDuplicates(["node"]), "near-shingles")

    pairs = stored(first_pairs(bands), "near-pairs")
    links = stored(verified(pairs, shingled, threshold), "near-links")
    labels = components(links)
    buckets = stored(open_buckets(bands, labels), "near-open")
    if not buckets.isEmpty():
        pairs = small_pairs(buckets)
        large = buckets.filter(F.col("n") > SMALL).select("node", "label").distinct()
        if not large.isEmpty():
            pairs = pairs.unionByName(rest_pairs(stored(large, "near-open"), shingled, threshold))
        pairs = stored(pairs.distinct(), "near-pairs")
        found = stored(verified(pairs, shingled, threshold), "near-links")
        if not found.isEmpty():
            labels = components(links.unionByName(found))

    labelled = nodes.select("node", "n", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = labelled.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
    member = stored(labelled.join(classes, "label").select("node", "n", "class_id", "class_size"), "near-classes")
    known = attach(signed.filter("node is not null").select("doc_id", "text_hash", "node"), member, "node", "n", signed.count())
    alone = signed.filter("node is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return known.select("doc_id", "text_hash", "class_id", "class_size").unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows that a class's smallest id stands for; each row goes or stays by its own text."""
    gone = classified(docs, id_col, text).filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    own = docs[id_col].cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(docs[text].cast("string")) == F.col("__hash"))
    return docs.join(stored(gone, "near-gone"), own, "left_anti")

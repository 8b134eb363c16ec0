"""Token-id shards compressed by a grammar (Re-Pair), with random-access decoding.

Documents are dealt in ranges of doc_id; each range is encoded, cut into shards and
compressed: the most frequent pairs of neighbouring ids are replaced by nonterminals,
again and again until no pair occurs LEAST times, each shard on its own.  The PAIRS most
frequent pairs of a round are replaced together; of places that overlap every other one is
replaced, and what is left waits for the next round.  A shard holds its rules, the expansion length
of every symbol that starts a document, and the compressed symbols, so one document
decodes without the others.

Shard format (little endian): magic `RPR1`; uint32 counts of documents, rules and
symbols, and of the first rule's number; document ids (int64) with a null mask (uint8);
per document its first symbol (uint32) and its number of ids (uint32); the rules (two
uint32 each); the rules' expansion lengths (uint32); the symbols (uint16 while every
number fits, else uint32).  No symbol spans two documents.

Shards are rows (shard key, bytes) of a table in the shared folder, so any store that
Spark writes can hold them.

Defined results.  Null and empty texts: the end id alone.  Very long texts: whole, in
one shard.  Repeated rows: each is stored; rows that repeat an id are in the order of
their texts' hashes, and dealt apart.  Strings of the file's special tokens are ordinary
text.  Null ids come first.  An empty table gives an empty table.  Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, slabs
from .common import roomy, ship, stored, tidy

#: Entries of a generation of the encoder's chunk cache; as many stay for a worker's next task.
CACHE_ENTRIES = 750_000
#: Ids of one shard, at least one document.
SHARD_IDS = 1 << 20
#: Pairs replaced in a round, and the least count of a pair: each round costs a pass, so
#: a pair must repay more than the 12 bytes of its rule.
PAIRS, LEAST = 512, 32
#: Rows of a task's range of doc_id.
RANGE_ROWS = 5_000
MAGIC = b"RPR1"


def frequent_pairs(left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the most frequent pairs and, per position, the index of its pair or -1.

    A table of hashed counts finds the positions that can matter; only those are
    counted exactly: one pair of each hash by its hash, others with that hash by sorting.
    """
    mixed = left * np.uint32(2654435761)
    mixed ^= right * np.uint32(2246822519)
    mixed >>= np.uint32(14)
    hashed = mixed.astype(np.intp)
    hashed[np.flatnonzero(~ok)] = 1 << 18
    counts = np.bincount(hashed, minlength=(1 << 18) + 1)
    counts[1 << 18] = 0
    floor = max(LEAST, int(np.partition(counts, -2 * PAIRS)[-2 * PAIRS]))
    often = np.flatnonzero(counts >= floor)
    slot = np.full((1 << 18) + 1, -1, np.int32)
    slot[often] = np.arange(len(often), dtype=np.int32)
    which = slot.take(hashed)
    at = np.flatnonzero(which >= 0)
    which = which.take(at)
    codes = left.take(at).astype(np.uint64) << np.uint64(32) | right.take(at)
    chief = np.zeros(len(often), np.uint64)
    chief[which] = codes
    stray = np.flatnonzero(chief[which] != codes)
    more, place = np.unique(codes[stray], return_inverse=True)
    which[stray] = len(chief) + place
    pairs = np.concatenate([chief, more])
    n = np.bincount(which, minlength=len(pairs))
    order = np.argsort(-n, kind="stable")[:PAIRS]
    order = order[n[order] >= LEAST]
    rank = np.full(len(pairs), -1, np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    which = rank[which]
    kept = np.flatnonzero(which >= 0)
    return pairs[order], np.stack([at[kept], which[kept]])


def compress(ids: np.ndarray, starts: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n, 2) and the first symbol of each document."""
    x = ids.astype(np.uint32)
    head = np.zeros(len(x) + 1, bool)
    head[starts] = True
    head = head[: len(x)]
    rules: list[np.ndarray] = []
    made = first_rule
    while len(x) > 1:
        pairs, (at, which) = frequent_pairs(x[:-1], x[1:], ~head[1:])
        if not len(pairs):
            break
        fresh = np.concatenate([[True], np.diff(at) != 1])  # of overlapping places every other one is replaced
        since = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        since = np.flatnonzero(since & 1 == 0)
        at, which = at[since], which[since]
        x[at] = (made + which).astype(np.uint32)
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)  # places are read several times faster than a mask
        x, head = x.take(keep), head.take(keep)
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        made += len(pairs)
    return x, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), np.flatnonzero(head).astype(np.uint32)


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    n = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        n[i] = (n[a - first_rule] if a >= first_rule else 1) + (n[b - first_rule] if b >= first_rule else 1)
    return n


def pack(doc_ids: list[int | None], arrays: list[np.ndarray], first_rule: int) -> bytes:
    sizes = np.array([len(a) for a in arrays], np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]
    symbols, rules, heads = compress(np.concatenate(arrays), starts, first_rule)
    wide = first_rule + len(rules) > 1 << 16
    return b"".join([
        MAGIC, struct.pack("<4I", len(arrays), len(rules), len(symbols), first_rule),
        np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        heads.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), rules.astype("<u4").tobytes(),
        rule_lengths(rules, first_rule).astype("<u4").tobytes(), symbols.astype("<u4" if wide else "<u2").tobytes(),
    ])


class Shard:
    """A shard read back; `document(i)` decodes one document alone, `all_ids()` everything."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        n, r, s, self.first_rule = struct.unpack_from("<4I", blob, 4)
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        ids, none = take("<i8", n), take("u1", n)
        self.doc_ids = [None if x else d for d, x in zip(ids.tolist(), none.tolist())]
        self.heads, self.sizes = take("<u4", n), take("<u4", n)
        self.rules, self.lengths = take("<u4", 2 * r).reshape(r, 2), take("<u4", r)
        self.symbols = take("<u4" if self.first_rule + r > 1 << 16 else "<u2", s)
        if at != len(blob):
            raise ValueError("shard is cut or has trailing bytes")
        expansions: list[np.ndarray] = []
        for a, b in self.rules.tolist():
            expansions.append(np.concatenate([expansions[p - self.first_rule] if p >= self.first_rule else np.array([p], np.uint32) for p in (a, b)]))
        self.flat = np.concatenate([np.arange(self.first_rule, dtype=np.uint32), *expansions])
        self.n = np.concatenate([np.ones(self.first_rule, np.int64), self.lengths.astype(np.int64)])
        self.start = np.cumsum(self.n) - self.n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.n[symbols]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[symbols] - (ends - n), n) + np.arange(total)]

    def document(self, i: int) -> np.ndarray:
        end = self.heads[i + 1] if i + 1 < len(self.heads) else len(self.symbols)
        return self.expand(self.symbols[self.heads[i] : end])

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols)


def _writer(path: str, pattern: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy()
        c = codec(path, pattern, CACHE_ENTRIES, CACHE_ENTRIES)
        first_rule = len(c.lengths) + 1
        end = np.array([end_id], np.uint32)
        docs: list[int | None] = []
        hashes: list[int] = []
        arrays: list[np.ndarray] = []
        size = part = 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([docs[0]], pa.int64()), pa.array([hashes[0]], pa.int64()), pa.array([part], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(docs, arrays, first_rule)], pa.binary())], names=["first_id", "first_hash", "part", "n_ids", "shard"])

        for batch in batches:
            ids, own, at = batch.column(0).to_pylist(), batch.column(2).to_pylist(), 0
            for slab in slabs(batch.column(1)):
                for a in c.encode(slab):
                    docs.append(ids[at])
                    hashes.append(own[at])
                    arrays.append(np.concatenate([a, end]).astype(np.uint32))
                    size += len(a) + 1
                    at += 1
                    if size >= SHARD_IDS:
                        yield shard()
                        docs, hashes, arrays, size, part = [], [], [], 0, part + 1
        if docs:
            yield shard()
        c.trim()

    return tidy(run)


def write_shards(docs: DataFrame, path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Encode, compress and write `docs` in ascending doc_id order; returns the shard table.

    Ranges hold whole runs of equal rows, so (first_id, first_hash, part) orders shards.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    order = (F.asc_nulls_first("doc_id"), F.asc("text_hash"))
    dealt = own.repartitionByRange(max(1, -(-docs.count() // RANGE_ROWS)), *order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(_writer(path, pattern, end_id), "first_id long, first_hash long, part long, n_ids long, shard binary"), "token-shards")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = Shard(blob.as_buffer().to_pybytes())
            starts = np.cumsum(s.sizes, dtype=np.int64) - s.sizes
            crc = [zlib.crc32(s.document(i).astype("<u4", copy=False)) for i in range(len(s.sizes))]
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(starts + start), pa.array(s.sizes.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(np.diff(np.append(s.heads, len(s.symbols)).astype(np.int64)))], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_symbols"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the shards: start, number of ids with the end id, and their crc32.

    The running sum of shard sizes is over one row per shard (a million ids).
    """
    ship(shards.sparkSession)
    order = Window.orderBy(F.asc_nulls_first("first_id"), "first_hash", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("first_id", "first_hash", "part", "n_ids").withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).drop("n_ids")
    same = shards["first_id"].eqNullSafe(before["first_id"]) & (shards["first_hash"] == before["first_hash"]) & (shards["part"] == before["part"])
    return shards.join(before, same).select("start", "shard").mapInArrow(tidy(_reader), "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")

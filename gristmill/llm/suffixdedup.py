"""Repeated passages by sparse suffix arrays.

A suffix is kept only where its first GRAM words have the smallest hash among WINDOW
neighbouring positions (a minimiser).  That choice depends on the words alone, so any two
equal passages of GRAM + WINDOW - 1 = MIN_WORDS words keep a suffix at the same place.
Suffixes whose first GRAM words occur once are dropped after counting; the others are
sorted over the cluster, by their first GRAM words and then word by word, and compared
with their neighbours; a match is extended to the right and to the left of the kept
position.  Matches of MIN_WORDS words or more are repeats, and those of one document
that touch join into spans.

Neighbours share the longest right part, not always the longest left part.  So where more
than two suffixes have one gram, the windows of MIN_WORDS words around the kept place that
some other suffix's right part allows are counted by their hashes as well.  A window that
the suffix before has too is left to that one.

Suffixes are sorted by range, with the document and place as last keys: a passage that
a third of all documents share is spread over as many tasks as its size asks for.  Rows
at the ends of sorted partitions, two a partition, are compared on the driver.  Each
suffix carries WINDOW words after its first GRAM and WINDOW - 1 words before it, which
is enough, since kept suffixes of a passage are at most WINDOW words apart.

Defined results.  Words are runs without white space.  Null, empty and short texts have
no repeats.  Very long texts are read whole.  A passage that repeats inside one document
counts as well.  Rows that repeat an id have the spans of their own texts, listed under
that id once for each text.  Rows with a null id take no part.  An empty table gives an empty table.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slabs
from .common import attach, likely, ship, stored, tidy
from .probminhash import _STEP, U, mixed, word_hashes

MIN_WORDS = 50
GRAM, WINDOW = 20, 31
LEFT, RIGHT = WINDOW - 1, WINDOW
#: Suffixes of a sorted partition.
SORTED_ROWS = 100_000


def word_codes(text: str) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the GRAM words from each position on."""
    n = len(codes) - GRAM + 1
    total, power, scrambled = np.zeros(n, np.uint64), 1, mixed(codes)
    for j in range(GRAM):
        total += scrambled[j : j + n] * U(power)
        power = power * 0x9E3779B97F4A7C15 % 2**64
    return mixed(total)


def sliding(x: np.ndarray, width: int, choose) -> np.ndarray:
    """`choose` (minimum or maximum) over every run of `width` values, by doubling."""
    n, have, out = len(x) - width + 1, 1, x
    while 2 * have <= width:
        out = choose(out[:-have], out[have:])
        have *= 2
    return choose(out[:n], out[width - have : width - have + n])


def anchors(grams: np.ndarray) -> np.ndarray:
    """Positions whose gram is the smallest of some WINDOW neighbours (all of equal ones)."""
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    low = sliding(grams, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([pad, low, pad]), WINDOW, np.maximum) == grams)


def grams_at(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """`gram_hashes` at some positions only."""
    total, power = np.zeros(len(places), np.uint64), 1
    for j in range(GRAM):
        total += mixed(codes[places + j]) * U(power)
        power = power * 0x9E3779B97F4A7C15 % 2**64
    return mixed(total)


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for slab in slabs(batch.column(1)):
            row, place, gram = [], [], []
            for i, text in enumerate(slab, at):
                codes = word_codes(text)
                if len(codes) >= MIN_WORDS:
                    grams = gram_hashes(codes)
                    own = anchors(grams)
                    row.append(np.full(len(own), i))
                    place.append(own)
                    gram.append(grams[own])
            at += len(slab)
            if row:
                at_rows = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at_rows), batch.column(2).take(at_rows), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(gram).view(np.int64))], names=["doc_id", "text_hash", "place", "gram"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words after and before each kept suffix's gram, as strings of 32-bit word codes."""

    def cut(keys: list, out: list[list]) -> pa.RecordBatch:
        ids, hashes = zip(*keys) if keys else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), *(pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary())))], names=["doc_id", "text_hash", "place", "gram", "right", "left"])

    for batch in batches:
        keys, out = [], [[], [], [], []]
        for i in range(batch.num_rows):
            codes = word_codes(batch.column(2)[i].as_py() or "")
            told = sorted((s["place"], s["gram"]) for s in batch.column(3)[i].as_py() if s["place"] + GRAM <= len(codes))
            stands = grams_at(codes, np.array([p for p, _ in told], np.int64)).view(np.int64).tolist()
            short = (codes >> U(32)).astype(">u4")
            key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            for (place, gram), there in zip(told, stands):
                if gram == there:  # else a text whose hash is another's
                    keys.append(key)
                    out[0].append(place)
                    out[1].append(gram)
                    out[2].append(short[place + GRAM : place + GRAM + RIGHT].tobytes())
                    out[3].append(short[max(0, place - LEFT) : place][::-1].tobytes())
            if len(keys) >= 20_000:
                yield cut(keys, out)
                keys, out = [], [[], [], [], []]
        yield cut(keys, out)


def shared_prefix(column: list[bytes], width: int) -> np.ndarray:
    """Words that each context shares with the next one in the list."""
    sizes = np.array([len(x) // 4 for x in column])
    codes = np.frombuffer(b"".join([x.ljust(4 * width, b"\0") for x in column]), np.uint32).reshape(len(column), width)
    same = np.ones((len(column) - 1, width + 1), bool)
    same[:, :width] = codes[:-1] == codes[1:]
    same[:, width] = False
    return np.minimum(np.argmin(same, 1), np.minimum(sizes[:-1], sizes[1:]))


def extents(gram: np.ndarray, right: list[bytes], left: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words before and after each suffix's place that repeats with a neighbour cover."""
    ahead, back = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    if len(gram) > 1:
        n_right, n_left = GRAM + shared_prefix(right, RIGHT), shared_prefix(left, LEFT)
        good = (gram[:-1] == gram[1:]) & (n_right + n_left >= MIN_WORDS)
        for side in (slice(None, -1), slice(1, None)):
            ahead[side] = np.maximum(ahead[side], np.where(good, n_right, 0))
            back[side] = np.maximum(back[side], np.where(good, n_left, 0))
    return back, ahead


def window_keys(gram: np.ndarray, right: list[bytes], left: list[bytes]) -> np.ndarray:
    """Hashes (suffixes x LEFT + 1) of the MIN_WORDS words from `o` words before each place on."""

    def sums(column: list[bytes], step: np.uint64) -> np.ndarray:
        codes = np.frombuffer(b"".join([x[: 4 * LEFT].ljust(4 * LEFT, b"\0") for x in column]), np.uint32).reshape(len(column), LEFT)
        out = np.zeros((len(column), LEFT + 1), np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + step * np.arange(1, LEFT + 1, dtype=np.uint64)), 1, out=out[:, 1:])
        return out

    offsets = mixed(_STEP[2] * np.arange(1, LEFT + 2, dtype=np.uint64))
    return mixed(mixed(gram.view(np.uint64))[:, None] + sums(left, _STEP[0]) + sums(right, _STEP[1])[:, ::-1] + offsets).view(np.int64)


def windows(gram: np.ndarray, right: list[bytes], left: list[bytes], first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, words before the place, and key of windows to count, of suffixes `first` to `last` - 1.

    What is beyond the list's ends is unknown, and no window is left out for it.
    """
    n = len(gram)
    same = gram[:-1] == gram[1:]
    shared = np.where(same, shared_prefix(right, RIGHT), -1) if n > 1 else np.zeros(0, np.int64)
    back = np.where(same, shared_prefix(left, LEFT), -1) if n > 1 else shared
    far = np.array([RIGHT])
    reach = np.maximum(np.concatenate([far, shared]), np.concatenate([shared, far]))
    before, after = np.concatenate([[True], same]), np.concatenate([same, [True]])
    two = np.zeros(n, bool)  # groups of two suffixes, which are compared already
    two[1:-2] |= after[1:-2] & ~before[1:-2] & ~after[2:-1]
    two[2:-1] |= before[2:-1] & ~after[2:-1] & ~before[1:-2]
    sizes = [np.array([len(x) // 4 for x in c]) for c in (left, right)]
    wanted = np.zeros(n, bool)
    wanted[first:last] = True
    at = np.flatnonzero(wanted & ~two & (reach >= 0))
    o = np.arange(LEFT + 1)
    need = MIN_WORDS - GRAM - o
    good = (need <= np.minimum(reach, sizes[1])[at, None]) & (o <= sizes[0][at, None])
    good &= ~((need <= np.concatenate([[-1], shared])[at, None]) & (o <= np.concatenate([[-1], back])[at, None]))
    rows, o = np.nonzero(good)
    return at[rows], o, window_keys(gram[at], [right[i] for i in at], [left[i] for i in at])[rows, o]


_COLUMNS = ("doc_id", "text_hash", "place", "gram", "right", "left")


def _comparer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of sorted suffixes with their neighbours, and windows to count; then the partition's two end rows.

    The last row waits for the next batch, which shows what follows it.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["doc_id", "text_hash", "lo", "hi", "part", "place", "gram", "right", "left"]
    first = last = None

    def counted(rows: pa.Table, lo: int, hi: int) -> pa.RecordBatch:
        at, o, keys = windows(rows.column("gram").to_numpy(), rows.column("right").to_pylist(), rows.column("left").to_pylist(), lo, hi)
        none = pa.nulls(len(at))
        start = (rows.column("place").to_numpy()[at] - o).astype(np.int32)
        own = [rows.column(c).take(pa.array(at)).combine_chunks() for c in _COLUMNS[:2]]
        return pa.RecordBatch.from_arrays([*own, pa.array(start), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int32()), pa.array(keys), none.cast(pa.binary()), none.cast(pa.binary())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        seen = 0 if last is None else last.num_rows
        first = rows.slice(0, 1) if first is None else first
        if last is not None:
            rows = pa.concat_tables([last, rows])
        last = rows.slice(max(0, rows.num_rows - 2))
        back, ahead = extents(rows.column("gram").to_numpy(), rows.column("right").to_pylist(), rows.column("left").to_pylist())
        hit = np.flatnonzero(ahead)
        place = rows.column("place").to_numpy()[hit]
        none = pa.nulls(len(hit))
        own = [rows.column(c).take(pa.array(hit)).combine_chunks() for c in _COLUMNS[:2]]
        yield pa.RecordBatch.from_arrays([*own, pa.array((place - back[hit]).astype(np.int32)), pa.array((place + ahead[hit]).astype(np.int32)), *(none.cast(t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names)
        yield counted(rows, max(0, seen - 1), rows.num_rows - 1)
    if last is not None:
        yield counted(last, last.num_rows - 1, last.num_rows)
        ends = first if last.num_rows < 2 else pa.concat_tables([first, last.slice(last.num_rows - 1)])  # a row alone is one end, not two
        none = pa.nulls(ends.num_rows).cast(pa.int32())
        yield pa.RecordBatch.from_arrays([*(ends.column(c).combine_chunks() for c in _COLUMNS[:2]), none, none, pa.array([part] * ends.num_rows, pa.int32()), *(ends.column(c).combine_chunks() for c in _COLUMNS[2:])], names=names)


def suffixes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Kept suffixes whose gram occurs again: doc_id, place, gram, contexts."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    kept = stored(base.mapInArrow(tidy(_finder), "doc_id long, text_hash long, place int, gram long"), "suffix-anchors")
    again = kept.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    places = attach(kept, again, "gram", "n", kept.count()).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("place", "gram")).alias("places"))
    places = stored(places, "suffix-places")
    near = likely(base, F.col("doc_id"), places.select("doc_id"), places.count())
    around = near.join(places, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "places").mapInArrow(tidy(_contexts), "doc_id long, text_hash long, place int, gram long, right binary, left binary")
    return stored(around, "suffix-contexts")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of words that occur elsewhere: doc_id, start_word, end_word, n_words."""
    ship(docs.sparkSession)
    order = ["gram", "right", "doc_id", "place", "text_hash"]
    context = suffixes(docs, id_col, text)
    parts = max(1, -(-context.count() // SORTED_ROWS))
    sorted_ = context.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*_COLUMNS)
    found = stored(sorted_.mapInArrow(tidy(_comparer), "doc_id long, text_hash long, lo int, hi int, part int, place int, gram long, right binary, left binary"), "suffix-matches")
    ends = found.filter("part is not null").select("part", *_COLUMNS).collect()  # two rows a partition
    ends.sort(key=lambda r: (r.part, r.gram, bytes(r.right), r.doc_id, r.place, r.text_hash))
    back, ahead = extents(np.array([r.gram for r in ends], np.int64), [bytes(r.right) for r in ends], [bytes(r.left) for r in ends])
    more = [(r.doc_id, r.text_hash, int(r.place - b), int(r.place + a)) for r, b, a in zip(ends, back, ahead) if a]
    ranges = found.filter("part is null and hi is not null").select("doc_id", "text_hash", "lo", "hi")
    counted = found.filter("part is null and hi is null").select("doc_id", "text_hash", "lo", F.col("gram").alias("key"))
    again = counted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = counted.count()
    if total:
        ranges = ranges.unionByName(attach(counted, stored(again, "suffix-windows"), "key", "n", total).select("doc_id", "text_hash", "lo", (F.col("lo") + MIN_WORDS).alias("hi")))
    if more:
        ranges = ranges.unionByName(docs.sparkSession.createDataFrame(more, "doc_id long, text_hash long, lo int, hi int"))
    earlier = Window.partitionBy("doc_id", "text_hash").orderBy("lo", "hi")
    reach = F.max("hi").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    island = ranges.withColumn("new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1))).withColumn("span", F.sum("new").over(earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy("doc_id", "text_hash", "span").agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word")).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))

"""Byte-level BPE encoding and decoding over Arrow batches.

The `tokenizers` library does the merging.  Text is cut where the split pattern
always cuts, so that each distinct chunk is merged once per worker and then looked
up; the byte table maps every byte to a printable character for the library and
back again for decoding.

Defined results.  Null text: no ids, decoded to empty bytes.  Empty text: the same.
Very long texts are encoded whole.  Repeated rows and null ids: each row is encoded
on its own.  An empty table gives an empty table.  Extra input columns are not
carried unless named in `keep`; a kept column that clashes with an output name is
refused with a ValueError.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, tidy

#: Entries of each of the two generations of a task's chunk cache; a worker keeps half as
#: many for its next task (the first seen, so mostly frequent ones) unless told another number.
CACHE_ENTRIES = 60_000
#: White space other than blanks and line feeds.
ODD_SPACE = tuple(c for c in map(chr, range(0x10000)) if re.match(r"[^\S \n]", c))
#: Bytes of text handled together.
SLAB = 1 << 21


@lru_cache(1)
def byte_table() -> list[str]:
    """Character of each byte: printable Latin-1 stands for itself, the rest follow 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def merges_of_ranks(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens whose union is a token, in the order in which unions rank."""
    found = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                found.append((rank, a, b, token[:i], token[i:]))
    found.sort()
    return [(x[3], x[4]) for x in found]


class ChunkCache(dict):
    """Ids of chunks as bytes; a chunk that is in neither generation is merged on the spot."""

    def __init__(self, make: Callable[[str], bytes], word: Callable[[str], bytes], old: dict[str, bytes]):
        super().__init__({"": b""})
        self.make, self.word, self.old = make, word, old

    def __missing__(self, chunk: str) -> bytes:
        value = self.old.get(chunk)
        if value is None:
            body = chunk[1:]
            value = self.word(body) if chunk[0] == " " and body.isascii() and body.isalpha() else self.make(chunk)
        self[chunk] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary file, with a bounded two-generation cache."""

    def __init__(self, path: str, pattern: str, entries: int = CACHE_ENTRIES, kept: int | None = None):
        import regex
        from tokenizers import Tokenizer, models

        chars = byte_table()
        self.byte_of = {ord(c): b for b, c in enumerate(chars)}
        self.char_of = dict(enumerate(chars))
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            vocab = model["vocab"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            whole = bool(model.get("ignore_merges"))
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            show = lambda raw: "".join(chars[b] for b in raw)
            vocab = {show(k): v for k, v in ranks.items()}
            merges = [(show(a), show(b)) for a, b in merges_of_ranks(ranks)]
            whole = True
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=whole, cache_capacity=0))
        self.tokenize = self.tokenizer.model.tokenize
        self.find = regex.compile(pattern).findall
        self.bytes_of = {i: bytes(self.byte_of[ord(c)] for c in t) for t, i in vocab.items() if all(ord(c) in self.byte_of for c in t)}
        self.dtype = np.dtype("<u2") if max(vocab.values(), default=0) < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        size = max(self.bytes_of, default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        for i, raw in self.bytes_of.items():
            self.lengths[i] = len(raw)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1] if size else np.zeros(0, np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.entries, self.kept = entries, entries // 2 if kept is None else kept
        blank, tokenize, code = chars[32], self.tokenize, self.code
        self.word = lambda body: array(code, [x.id for x in tokenize(blank + body)]).tobytes()
        self.cache = ChunkCache(self.merge, self.word, {})

    def chunks(self, text: str) -> list[str]:
        """Parts of `text` that the pattern never matches across.

        A blank before a word starts a match of its own, and so does a line feed between
        words.  Texts with longer runs of white space are cut by the pattern itself.
        """
        if "  " in text or "\n\n" in text or " \n" in text or text[-1:] in (" ", "\n") or "\0" in text or any(map(text.__contains__, ODD_SPACE)):
            return self.find(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def merge(self, chunk: str) -> bytes:
        """Ids of one chunk: its pieces' ids, each piece merged by the library's model."""
        if chunk[0] == " ":
            body = chunk[1:]
            if body.isalpha():
                return self.piece(chunk)
            if body[:-1].isalpha() and body[-1] in ".,":
                return self.cache[chunk[:-1]] + self.cache[body[-1]]
        pieces = self.find(chunk)
        return self.piece(chunk) if len(pieces) == 1 else b"".join([self.cache[w] for w in pieces])

    def piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha() and piece[0] == " ":
            shown = self.char_of[32] + piece[1:]
        else:
            shown = piece.encode("utf-8").decode("latin-1").translate(self.char_of)
        return array(self.code, [x.id for x in self.tokenize(shown)]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        get = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(get, self.chunks(t))), self.dtype) for t in texts]
        if len(self.cache) > self.entries:
            self.cache.old = {}
            self.cache = ChunkCache(self.merge, self.word, self.cache)
        return out

    def trim(self) -> None:
        """Keep a bounded part of the cache between tasks."""
        self.cache = self.cache.old or self.cache
        self.cache.old = {}
        while len(self.cache) > self.kept:
            self.cache.popitem()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of `ids`; they need not be whole characters until all are joined."""
        n = self.lengths[ids]
        total = int(n.sum())
        if not total:
            return b""
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(total)
        return self.flat[at].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points [start, end) that each id touches; ids that split a character share it."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return char[starts].astype(np.int32), (char[ends - 1] + 1).astype(np.int32)


@lru_cache(1)
def codec(path: str, pattern: str, entries: int = CACHE_ENTRIES, kept: int | None = None) -> Codec:
    return Codec(path, pattern, entries, kept)


def slabs(texts: pa.Array) -> Iterator[list[str]]:
    """Runs of texts of about SLAB characters, at least one text each; null is empty."""
    run: list[str] = []
    size = 0
    for at in range(0, len(texts), 256):
        for t in texts.slice(at, 256).to_pylist():
            run.append(t or "")
            size += len(run[-1])
            if size >= SLAB:
                yield run
                run, size = [], 0
    if run:
        yield run


def int_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _encoder(path: str, pattern: str, keep: list[str], offsets: bool) -> Callable:
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            at = 0
            for slab in slabs(batch.column(len(keep))):
                ids = c.encode(slab)
                cols = [batch.column(i).slice(at, len(slab)) for i in range(len(keep))] + [int_lists(ids)]
                names = [*keep, "ids"]
                if offsets:
                    spans = [c.offsets(t, i) for t, i in zip(slab, ids)]
                    cols += [int_lists([s[0] for s in spans]), int_lists([s[1] for s in spans])]
                    names += ["starts", "ends"]
                at += len(slab)
                yield pa.RecordBatch.from_arrays(cols, names=names)
        c.trim()

    return run


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False) -> DataFrame:
    """`keep` columns and `ids array<int>` of each row of `df`; `starts`/`ends` on request."""
    if {"ids", "starts", "ends"} & set(keep):
        raise ValueError("ids, starts and ends are output names; rename the input's columns")
    ship(df.sparkSession)
    ints = T.ArrayType(T.IntegerType(), False)
    fields = [df.schema[k] for k in keep] + [T.StructField("ids", ints, False)]
    fields += [T.StructField(n, ints, False) for n in ("starts", "ends")] * offsets
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(tidy(_encoder(path, pattern, list(keep), offsets)), T.StructType(fields))


def _decoder(path: str, pattern: str, names: list[str]) -> Callable:
    where = names.index("ids")

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            lists = batch.column(where)
            values = lists.values.to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            out = [c.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    return run


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """`df` with `decoded binary`: the bytes of its `ids`, characters split between ids restored."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType(), False)])
    return df.mapInArrow(tidy(_decoder(path, pattern, df.columns)), schema)


def digests(df: DataFrame) -> DataFrame:
    """Digest columns of encoded and decoded rows; `n_split` is kept where it is there."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *(["n_split"] if "n_split" in df.columns else []),
    )


def _round_tripper(path: str, pattern: str) -> Callable:
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            at = 0
            for slab in slabs(batch.column(1)):
                ids = c.encode(slab)
                spans = [c.offsets(t, i) for t, i in zip(slab, ids)]
                split = [int((start[1:] < end[:-1]).sum()) for start, end in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(slab)), int_lists(ids), pa.array([c.decode(i) for i in ids], pa.binary()), pa.array(split, pa.int64())], names=["doc_id", "ids", "decoded", "n_split"])
                at += len(slab)
        c.trim()

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode whole texts, decode the ids, and return the digests of both.

    `n_split` counts neighbouring ids whose offsets share a character that is split
    between them.  Encoder and decoder run one behind the other in the same worker.
    """
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.BinaryType(), False), T.StructField("n_split", T.LongType(), False)])
    return digests(docs.select("doc_id", F.col("text").cast("string").alias("__text")).mapInArrow(tidy(_round_tripper(path, pattern)), schema))

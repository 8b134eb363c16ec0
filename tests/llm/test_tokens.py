import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from gristmill.llm import bpe, tokenstore

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  a  b   c \n\n  d ", "x ", "\n \n a", "it's I'LL 12a34 ½²", "\x1c a\x1e \x85b\xa0c  d​　", "😀 fin̈e <|endoftext|>", "a\t b \t c", "日本語 テキスト １２", "\x00", "word " * 5000, "the same", "the same"]


def rows(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", None)], "doc_id long, text string, ids_sha256 string")


def test_round_trip_equals_tiktoken(spark):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(rows(spark), RANKS, P.PATTERN).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_offsets_share_split_characters(spark):
    out = bpe.encode(spark.createDataFrame([(1, "é😀 a")], "doc_id long, text string"), RANKS, P.PATTERN, offsets=True).collect()[0]
    assert (out.starts[-1], out.ends[-1]) == (2, 4)
    assert sorted(set(out.starts)) == [0, 1, 2]
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, ids int"), RANKS, P.PATTERN, keep=("doc_id", "ids"))


def test_shards_read_back(spark):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    shards = tokenstore.write_shards(rows(spark), JSON, P.PATTERN)
    got = sorted(tokenstore.read_shards(shards).collect(), key=lambda r: r.start)
    want = [(None, "no id"), *enumerate(TEXTS)]
    assert [r.doc_id for r in got] == [w[0] for w in want]
    start = 0
    for r, (_, t) in zip(got, want):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = tokenstore.write_shards(rows(spark).limit(0), JSON, P.PATTERN)
    assert tokenstore.read_shards(empty).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    arrays = [np.append(rng.zipf(1.3, n) % 300, 0).astype(np.uint32) for n in (0, 1, 5, 40_000, 3, 20_000)] + [np.full(9001, 7, np.uint32)]
    shard = tokenstore.Shard(blob := tokenstore.pack(list(range(7)), arrays, 300))
    assert len(shard.rules) > 100 and len(shard.symbols) < sum(map(len, arrays)) / 1.5
    assert np.array_equal(shard.all_ids(), np.concatenate(arrays))
    for i in range(7):
        assert np.array_equal(shard.document(i), arrays[i])
    for bad in (blob[:-1], blob + b"x", b"XXXX" + blob[4:]):
        with pytest.raises(ValueError):
            tokenstore.Shard(bad)


def test_round_trip_of_odd_tables(spark):
    got = {r.doc_id: r for r in bpe.round_trip(spark.createDataFrame([(1, "é😀 a"), (2, "plain words"), (3, None)], "doc_id long, text string"), RANKS, P.PATTERN).collect()}
    ids = bpe.encode(spark.createDataFrame([(1, "é😀 a")], "doc_id long, text string"), RANKS, P.PATTERN, offsets=True).collect()[0]
    assert got[1].n_split == sum(a < b for a, b in zip(ids.starts[1:], ids.ends[:-1])) > 0
    assert (got[2].n_split, got[3].n_split, got[3].n_tokens) == (0, 0, 0)
    assert bpe.round_trip(rows(spark).limit(0), RANKS, P.PATTERN).count() == 0


def test_rows_that_repeat_an_id_are_dealt_apart(spark):
    told = [(5, f"text {i % 40}") for i in range(200)] + [(None, f"none {i}") for i in range(30)] + [(1, "first"), (9, "last")]
    df = spark.createDataFrame(told, "doc_id long, text string")
    tok = Tokenizer.from_file(JSON)
    got = sorted(tokenstore.read_shards(tokenstore.write_shards(df, JSON, P.PATTERN)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 30 + [1] + [5] * 200 + [9]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted(zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in told)
    assert sorted(r.ids_crc32 for r in got) == want


def test_pairs_of_one_hash_are_counted_apart():
    """The most frequent pairs and their places equal plain counting, also where two pairs share a hash."""
    from collections import Counter

    import numpy as np

    from gristmill.llm import tokenstore as ts

    hashed = {}
    for a in range(1, 1200):
        for b in range(1, 600):
            hashed.setdefault(((a * 2654435761 % 2**32) ^ (b * 2246822519 % 2**32)) >> 14, []).append((a, b))
        if a >= 60 and sum(len(x) > 1 for x in hashed.values()) > 40:
            break
    same = [x[:2] for x in hashed.values() if len(x) > 1][:40]
    units = [p for i, two in enumerate(same) for p, n in zip(two, (50 + i, 40)) for _ in range(n)]
    x = np.array([v for i in np.random.default_rng(3).permutation(len(units)) for v in (*units[i], 0)], np.uint32)
    ok = (x[:-1] != 0) & (x[1:] != 0)
    pairs, (at, which) = ts.frequent_pairs(x[:-1], x[1:], ok)
    want = Counter(int(a) << 32 | int(b) for a, b, c in zip(x[:-1], x[1:], ok) if c)
    told = Counter(pairs[which].tolist())
    assert set(pairs.tolist()) == {p for p, n in want.items() if n >= ts.LEAST} and all(told[p] == want[p] for p in told)
    assert all(pairs[w] == np.uint64(int(x[i]) << 32 | int(x[i + 1])) for i, w in zip(at.tolist(), which.tolist()))


def test_a_worker_keeps_chunks_as_told():
    """The store's encoder keeps a whole generation for the next task, and does not copy it again."""
    import public_tokenizers

    from gristmill.llm import bpe

    c = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 100, 100)
    c.encode([" ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90))])
    c.encode([" ".join(f"v{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90))])
    c.trim()
    kept = dict(c.cache)
    assert 50 < len(kept) <= 100 and " wbk" in kept
    c.encode([" ".join(f"u{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90))])
    c.trim()
    assert len(c.cache) <= 100 and kept.items() <= c.cache.items()

import random
from collections import Counter

import numpy as np

from gristmill.llm import suffixdedup as sd


def brute(texts):
    """Word positions covered by runs of 50 words that occur twice."""
    seen = Counter()
    words = {i: (t or "").split() for i, t in texts}
    for w in words.values():
        seen.update(tuple(w[k : k + 50]) for k in range(len(w) - 49))
    out = {}
    for i, w in words.items():
        hit = set()
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] > 1:
                hit.update(range(k, k + 50))
        if hit:
            out[i] = hit
    return out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    fresh = lambda n: [word() for _ in range(n)]
    passages = [fresh(n) for n in (50, 51, 60, 90, 49, 200)]
    out = []
    for i in range(300):
        w = fresh(rng.randint(0, 150))
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passages[0 if i % 2 else rng.randrange(len(passages))]
        out.append(" ".join(w))
    out += [out[5], out[6], None, "", " ".join(passages[3] + fresh(5) + passages[3]), "x " * 130, " ".join(passages[5][:120] + fresh(30) + passages[5][90:])]
    out.append(" ".join(fresh(20_000)))
    return list(enumerate(out))


def test_minimisers_cover_every_window():
    rng = np.random.default_rng(1)
    g = rng.integers(1, 2**60, 500).astype(np.uint64)
    g[100:200] = 7
    a = set(sd.anchors(g).tolist())
    for s in range(len(g) - sd.WINDOW + 1):
        low = g[s : s + sd.WINDOW].min()
        assert {p for p in range(s, s + sd.WINDOW) if g[p] == low} <= a
    assert len(sd.anchors(g[:30])) == 0


def test_spans_match_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "z") for i, t in texts] + [(None, texts[0][1], "z")], "doc_id long, text string, place string")
    got = {}
    for r in sd.repeated_spans(df).collect():
        assert r.n_words == r.end_word - r.start_word >= 50
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == brute(texts)
    assert sd.repeated_spans(df.limit(0)).count() == 0


def test_passages_that_end_in_a_common_line(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    fresh = lambda n: [word() for _ in range(n)]
    line, texts = fresh(30), []
    for n in (50, 55, 60):
        for _ in range(40):
            passage = fresh(n - 30) + line
            texts += [" ".join(fresh(30) + passage + fresh(30)) for _ in range(2)]
    texts += [" ".join(fresh(40) + line + fresh(40)) for _ in range(300)]
    texts = list(enumerate(texts))
    got = {}
    for r in sd.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == brute(texts) and len(got) == 240


def test_suffixes_alone_in_their_partitions(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    fresh = lambda n: [word() for _ in range(n)]
    common = fresh(20)  # too short to count, but its grams occur twice
    texts = [(i, " ".join(fresh(60) + common + fresh(60))) for i in range(2)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert sd.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string")).count() == 0
        held_rows, sd.SORTED_ROWS = sd.SORTED_ROWS, 1  # one suffix in each partition
        try:
            assert sd.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string")).count() == 0
            got = {}
            for r in sd.repeated_spans(spark.createDataFrame(corpus()[:60], "doc_id long, text string")).collect():
                got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
            assert got == brute(corpus()[:60])
        finally:
            sd.SORTED_ROWS = held_rows
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_rows_that_repeat_an_id(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    fresh = lambda n: [word() for _ in range(n)]
    passage = fresh(60)
    rows = [(7, " ".join(fresh(30) + passage)), (7, " ".join(fresh(200))), (7, " ".join(fresh(10) + passage)), (8, " ".join(fresh(90)))]
    got = sorted(tuple(r) for r in sd.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(7, 10, 70, 60), (7, 30, 90, 60)]

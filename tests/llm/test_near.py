import random
from collections import Counter

import numpy as np

from gristmill.llm import probminhash as pm


def brute_similarity(a, b):
    def grams(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = grams(a), grams(b)
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    return total


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(60, 200))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out + ["one two", "one two", "", None, "   ", "x y " * 3000, "x y " * 3100, "z " * 10]


def test_exact_similarity_matches_definition():
    rng = random.Random(1)
    for _ in range(40):
        a = " ".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        b = " ".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        assert abs(pm.similarity(*pm.shingles(a), *pm.shingles(b)) - brute_similarity(a, b)) < 1e-9


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 2**63, 300).astype(np.uint64)
    x, y = rng.integers(1, 6, 250), rng.integers(1, 6, 250)
    a, b = np.sort(h[:250]), np.sort(h[50:])
    want = pm.similarity(a, x, b, y)
    hits = []
    for r in range(40):
        salt = np.uint64(r * 7919)
        s = pm.signatures(np.concatenate([a ^ salt, b ^ salt]), np.concatenate([x, y]).astype(float), np.repeat([0, 1], 250), 2)
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - want) < 0.02


def test_classes_match_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[0], "c"), (3, texts[3], "c")]
    got = pm.near_classes(spark.createDataFrame(rows, "doc_id long, text string, class_id string")).collect()
    assert len(got) == len(rows)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if a and texts[j] and a.split() and texts[j].split() and abs(len(a) - len(texts[j])) < 2000 and brute_similarity(a, texts[j]) >= 0.8 - 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    for r in got:
        if r.doc_id is not None:
            assert r.class_id == find(r.doc_id)
            assert r.kept == (find(r.doc_id) == r.doc_id)
    assert next(r for r in got if r.doc_id is None).class_id == find(0)
    assert pm.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    name = lambda i: bytes([i // 256, i % 256])
    links = spark.createDataFrame([(name(i), name(i + 1)) for i in range(0, 40)] + [(name(100), name(200))], "a binary, b binary")
    for few in (0, 10**6):  # spread over the cluster, and in one task
        got = {bytes(r.node): bytes(r.label) for r in pm.components(links, few=few).collect()}
        assert {got[name(i)] for i in range(41)} == {name(0)} and got[name(200)] == name(100)


def test_large_buckets_are_compared_whole(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common, texts = [word() for _ in range(304)], []
    for _ in range(150):  # 0.78 to all others, 0.81 to the own partner
        pair = [word() for _ in range(7)]
        texts += [" ".join(common + pair + [word() for _ in range(36)]) for _ in range(2)]
    assert brute_similarity(texts[0], texts[1]) >= 0.805 and brute_similarity(texts[0], texts[2]) < 0.795
    got = pm.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i in range(300)}


def test_copies_are_dropped_by_row(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, other, third = ([word() for _ in range(100)] for _ in range(3))
    near = " ".join(base[:-1] + ["end"])
    base, other, third = map(" ".join, (base, other, third))
    rows = [(1, base), (None, near), (None, other), (7, near), (7, third), (None, ""), (7, None)]
    left = pm.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, base), (None, other), (7, third), (None, ""), (7, None)], key=str)


def test_cells_are_counted_in_blocks(spark):
    """Counts equal plain ones, and a task sends a bounded number of rows however many shingles it reads."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = [(bytes([i]), rng.integers(0, 2**64, 4000, np.uint64)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows]), pa.array([h.tobytes() for _, h in rows]), pa.array([b""] * len(rows))], names=["node", "hashes", "counts"])
    assert sum(b.num_rows for b in pm._cell_counter(iter([batch]))) <= 64
    told = spark.createDataFrame([(n, h.tobytes(), b"") for n, h in rows], "node binary, hashes binary, counts binary").repartition(7)
    want = np.bincount(np.concatenate([(h >> np.uint64(44)).astype(np.int64) for _, h in rows]), minlength=1 << 20)
    assert (pm.cell_counts(told) == want).all() and not pm.cell_counts(told.filter("false")).any()

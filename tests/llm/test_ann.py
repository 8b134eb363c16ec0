import numpy as np

from gristmill.llm import ann


def brute(rows, queries, k=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for q, v in queries:
        score = ann.exact_scores(x, np.array(v, float))
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(10, 32))
    data = [(i, (centers[i % 10] * 0.4 + rng.normal(size=32)).astype(np.float32).astype(float).tolist()) for i in range(3000)]
    data += [(5000 + i, data[7][1]) for i in range(400)]  # copies of one vector
    df = spark.createDataFrame([(a, b, "x") for a, b in data], "vec_id long, embedding array<double>, rank string")
    got = ann.every_twentieth(df).collect()
    want = brute(data, [d for d in data if d[0] % 20 == 0])
    assert len(got) == 20 * len(want)
    hits, by = 0, {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        keys = [(-r.score, r.vec_id) for r in rows]
        assert keys == sorted(keys)
        score = dict(want[q])
        hits += len(score.keys() & {r.vec_id for r in rows})
        assert all(score[r.vec_id] == r.score for r in rows if r.vec_id in score)
    assert hits / len(got) >= 0.9


def test_pigeonhole_probing_misses_nothing():
    rng = np.random.default_rng(3)
    codes = np.packbits(rng.random((500, 64)) > 0.5, axis=1)
    index = ann.SubstringIndex(codes)
    for radius in (0, 5, 17, 22, 26, 31):
        for q in codes[:20]:
            want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius)
            assert np.array_equal(index.within(q, radius), want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (20, [1.0, 1.0]), (40, []), (1, [2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.every_twentieth(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 1, 3.0), (0, 3, 20, 3.0), (20, 1, 0, 3.0), (20, 2, 1, 2.5), (20, 3, 1, 2.5)]
    assert ann.every_twentieth(df.limit(0)).count() == 0


def test_recall_whatever_the_lengths(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 48))
    spread = np.exp(rng.normal(size=(3000, 1)))
    for vectors in (x / np.sqrt((x * x).sum(1, keepdims=True)), x * spread, x + 3, x * spread + 1):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.every_twentieth(df).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q, found in got.items():
            score = vectors @ vectors[q]
            score[q] = -np.inf
            hits += len(found & set(np.argsort(-score)[:20].tolist()))
        assert len(got) == 150 and hits / (20 * 150) >= 0.95

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_near import brute_similarity

import corpus_pipeline as cp
from gristmill.llm import cotrain, mixing

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    train, held = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    rows = cotrain.classify(docs, train).join(held, "doc_id").collect()
    assert len(rows) > 100
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.95
    assert np.mean([r.kept for r in rows if r.quality]) > 0.97


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    n = 6000
    y = (rng.random(n) < 0.5).astype(float)
    text = np.where(rng.random((n, 1)) < 0.3, 0, 4 * (y[:, None] - 0.5)) + rng.normal(size=(n, 6))
    meta = np.where(rng.random((n, 1)) < 0.3, 0, 4 * (y[:, None] - 0.5)) + rng.normal(size=(n, 6))
    own, pool, test = slice(0, 60), slice(60, 3000), slice(3000, n)
    fold = np.arange(60) % 4 == 0
    model = cotrain.cotrain(text[own], meta[own], y[own], text[pool], meta[pool], fold)
    alone = cotrain.cotrain(text[own], meta[own], y[own], text[:0], meta[:0], fold)
    right = lambda m: ((m.combined(m.text.log_odds(text[test]), m.meta.log_odds(meta[test])) > 0) == y[test]).mean()
    assert right(model) >= right(alone) and right(model) > 0.9


def test_odd_documents_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (None, "", "en", "y"), (2, "a b " * 60_000, None, "z"), (2, "a", None, "z")], "doc_id long, text string, lang string, score string")
    none = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = cotrain.classify(docs, none).collect()
    assert len(got) == 4 and all(r.kept and r.score is None for r in got)
    many = spark.createDataFrame([(i, ("good words here " if i % 2 else "BAD!! ") * (i % 9 + 5), "en", "s") for i in range(200)], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = cotrain.classify(many.unionByName(docs), labels).collect()
    assert len(got) == 204 and all(r.kept == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id > 2)
    assert cotrain.classify(docs.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in cp.STAGES:
        rows = stage(spark, docs, SF)
        out.append(rows.collect())
        docs = spark.createDataFrame(out[-1], rows.schema)
    return out


def test_each_stage_against_brute_force(stages, spark):
    raw, good, single, apart, mixed, ids = stages
    model = cotrain.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    a = model.text.log_odds(np.array([cotrain.text_features(r.text) for r in raw]))
    b = model.meta.log_odds(np.array([cotrain.meta_features(r.source, r.lang, r.n_chars) for r in raw]))
    assert {r.doc_id for r in good} == {r.doc_id for r, z in zip(raw, model.combined(a, b)) if z >= 0}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([r.doc_id in {g.doc_id for g in good} for r in raw if quality.get(r.doc_id) == 1]) > 0.95

    best = {}
    for r in good:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in single} == set(best.values())

    links = [(x.doc_id, y.doc_id) for i, x in enumerate(single) for y in single[:i] if len(x.text) < 6000 > len(y.text) and len(set(x.text.split()) & set(y.text.split())) * 2 > len(set(x.text.split())) and brute_similarity(x.text, y.text) >= 0.8 - 1e-9]
    parent = {r.doc_id: r.doc_id for r in single}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in links:
        parent[max(find(x), find(y))] = min(find(x), find(y))
    assert {r.doc_id for r in apart} == {i for i in parent if find(i) == i}

    sizes, taken = Counter(), Counter()
    for r in apart:
        sizes[r.source] += len(r.text.split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
    names = sorted(sizes)
    target = mixing.water_fill([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    longest = max(len(r.text.split()) for r in apart)
    assert all(abs(taken[s] - t) <= longest for s, t in zip(names, target))
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2 and {r.doc_id for r in mixed} <= {r.doc_id for r in apart}

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, hashlib.sha256(",".join(map(str, enc.encode_ordinary(r.text))).encode()).hexdigest()) for r in mixed)
    assert Counter((r.doc_id, r.ids_sha256) for r in ids) == want


def test_run_equals_stages(stages, spark):
    assert Counter(map(tuple, cp.run(spark, SF).collect())) == Counter(map(tuple, stages[-1]))


def test_stages_on_odd_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    long = " ".join(f"{r.text}" for r in base) * 20
    rows += [(None, None, None, None, None), (None, "", "en", None, 0), (None, base[0].text, None, "web", 5), (base[1].doc_id, base[2].text + " more words", "en", None, 9), rows[3], rows[3], (9000, long, "en", "web", len(long)), (9001, "  \n ", None, "web", 3)]
    names = ["score", "kept", "keep_id", "group_size", "text_sha256", "size", "target", "taken", "copies", "class_id", "text_hash"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *(f"own {n}" for n in names)) for r in rows], schema)
    for n in (len(rows), 0):
        df = docs.limit(n)
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, df, str(tmp_path))
            got = out.collect()
            if k == len(cp.STAGES) - 1:
                break
            assert out.columns == docs.columns
            assert all(r[c] == f"own {c}" for r in got for c in names)
            assert n == 0 or 0 < len(got)
            df = spark.createDataFrame(got, docs.schema)
        assert n or not got
        assert Counter(r.doc_id for r in got)[9000] <= 2

import hashlib
from collections import Counter, defaultdict

import pytest

from gristmill.llm import exactdedup, mixing

SCHEMA = "doc_id long, text string, kept string, source string"


def test_exact_dedup_matches_brute_force(spark):
    data = [(i, f"t{i % 7}" if i % 3 else f"own {i}", "x", "s") for i in range(300)] + [(400, None, None, None), (401, "", "y", None), (None, "t1", "z", "s"), (None, "only null id", "z", "s"), (7, "t0", "q", "s")]
    data += [(500, "twin", "a", "s"), (500, "twin", "a", "s")] + [(600, "long " * 50_000, "a", "s")]
    got = exactdedup.exact_dedup(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    groups = defaultdict(list)
    for d in data:
        groups[d[1] or ""].append(d[0])
    want = {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text or ""]
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text or "" for r in got if r.kept) == dict.fromkeys(groups, 1)


def test_exact_dedup_hot_group_and_empty(spark):
    data = [(i, "hot" if i % 3 else str(i), "x", "s") for i in range(3000)]
    got = exactdedup.exact_dedup(spark.createDataFrame(data, SCHEMA))
    assert got.filter("kept").count() == 1001
    assert got.filter("text = 'hot' and kept").collect()[0].group_size == 2000
    assert exactdedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unique_rows_pass_without_shuffle(spark):
    df = spark.createDataFrame([(i, f"text {i}", "x", "s") for i in range(2000)] + [(9999, "text 5", "x", "s")], SCHEMA)
    assert exactdedup.flagged(df).filter("__maybe").count() < 20


def test_water_fill_stops_and_reshares():
    assert mixing.water_fill([10, 1000, 1000], [5, 2, 1], 900, 2) == pytest.approx([20, 880 * 2 / 3, 880 / 3])
    assert mixing.water_fill([10, 10], [1, 1], 1000, 2) == [20, 20]
    assert mixing.water_fill([], [], 0, 2) == []


def test_flow_routes_overlap_and_prefers_first_copies():
    # pattern {a}: 10 words, {a,b}: 10 words, {b}: 10; a wants 20, b wants 10: no repetition is needed
    flows = mixing.route([10, 10, 10], [[0], [0, 1], [1]], [20, 10])
    assert [sum(f.values()) for f in flows] == [10, 10, 10]
    assert flows[1].get(0, 0) == 10
    # brute force: the least convex cost over all integer routings of a tiny network
    best = None
    for x in range(0, 9):
        for y in range(0, 9):
            give = [12 - x, x + y, 9 - y]
            if min(give) < 0 or max(give) > 8:
                continue
            cost = sum(max(0, g - 4) for g in give)
            best = cost if best is None else min(best, cost)
    flows = mixing.route([4, 4, 4], [[0], [0, 1], [1]], [12, 9])
    assert sum(max(0, sum(f.values()) - 4) for f in flows) == best


@pytest.mark.parametrize("n", [0, 1, 400])
def test_mix_comes_near_targets(spark, n):
    data = [(i, "w " * (1 + i * 37 % 90), "x", f"s{i % 5}" if i % 3 else "hot") for i in range(n)] + [(1000, None, "x", None), (None, "a b", "y", None), (5, "", "z", "s1")] * (n > 1)
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(data)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len((r.text or "").split()) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    names = mixing.code_point_order(list(size))
    want = mixing.water_fill([size[x] for x in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2)
    for x, w in zip(names, want):
        assert target[x] == pytest.approx(w)
        assert abs(taken[x] - w) <= 46
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_overlapping_sources(spark):
    data = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["b", "a"] if i % 3 == 1 else ["b"]) for i in range(90)] + [(99, "w", None), (98, "w", [])]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source array<string>"), weights={"a": 2, "b": 1, None: 0}, share=1.0).collect()
    assert len(got) == 92 and sum(r.taken for r in got) == pytest.approx(900, abs=12)


def test_many_patterns_give_the_same_mix(spark, monkeypatch):
    data = [(i, "w " * (1 + i * 37 % 90), "x", f"s{i % 23}" if i % 3 else "hot") for i in range(700)] + [(1000, None, "x", None), (None, "a b", "y", None)]
    df = spark.createDataFrame(data, SCHEMA)
    lists = spark.createDataFrame([(i, "w " * 10, ["a"] if i % 3 == 0 else ["b", "a"] if i % 3 == 1 else ["b"]) for i in range(90)] + [(200 + i, "w v", [f"z{i % 9}"]) for i in range(60)] + [(99, "w", None)], "doc_id long, text string, source array<string>")
    want, tied = Counter(map(tuple, mixing.mix(df).collect())), {r.doc_id: r.taken for r in mixing.mix(lists).collect()}
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    got = mixing.mix(df)
    assert set(got.columns) == set(mixing.mix(df.limit(0)).columns)
    cols = mixing.mix(df.limit(3)).columns
    at = cols.index("target")
    cut = lambda rows: Counter((*r[:at], round(r[at], 6), *r[at + 1 :]) for r in rows)
    assert cut(map(tuple, got.select(cols).collect())) == cut(want.elements())
    assert {r.doc_id: r.taken for r in mixing.mix(lists).collect()} == tied
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    with pytest.raises(ValueError):
        mixing.mix(lists).collect()

import pytest

from gristmill.functions.text import round_half_up
from gristmill.operators import numbers as N
from gristmill.sources import files, packed

GOOD = "NSTORE1\n1\nR\tr0001\tp\tp=m*v\tmomentum\t\t2\nV\tm\tkg\t\nV\tv\tm/s\t3\nEND\t1\n"


def test_store_reads_back():
    (r,) = packed.parse_store(GOOD)
    assert r["formula"] == "p=m*v" and [v["var"] for v in r["vars"]] == ["m", "v"] and r["vars"][1]["cval"] == "3"


@pytest.mark.parametrize("text, code", [
    ("X" + GOOD, "magic"), (GOOD.replace("\n1\n", "\nx\n", 1), "count"), (GOOD.replace("END\t1", "END\t2"), "end_count"), (GOOD.split("END")[0], "no_end"),
    (GOOD.replace("V\tv\tm/s\t3\n", ""), "missing_variable"), (GOOD.replace("V\tm\tkg", "V\t\tkg"), "empty_variable"), (GOOD.replace("V\tm\tkg", "V\tm\t"), "empty_unit"),
    (GOOD.replace("\t2\nV", "\t9\nV"), "too_many_variables"), (GOOD.replace("V\tm", "Q\tm"), "tag"), (GOOD.replace("\t2\nV", "\t0\nV"), "stray_variable"),
])
def test_broken_stores_have_codes(spark, tmp_path, text, code):
    with pytest.raises(packed.Broken, match=code):
        packed.parse_store(text)
    (tmp_path / "s.txt").write_text(text)
    rows = packed.read_store(spark, f"file://{tmp_path}").collect()
    assert [r.error for r in rows] == [code]


def test_tokenizer_pack():
    data = ([(3, "<end>")], [(0, b"a"), (1, b"\xff"), (2, b"a\xff")], [(b"a", b"\xff")])
    text = packed.pack_tokenizer(*data)
    assert packed.parse_tokenizer(text) == data
    for bad, code in ((text.replace("M\t0", "M\t1"), "merge_order"), (text.replace("\n3\n", "\n4\n", 1), "count"), (text.replace("END", ""), "no_end"), ("?" + text, "magic")):
        with pytest.raises(packed.Broken, match=code):
            packed.parse_tokenizer(bad)


def test_publish_never_replaces(spark, tmp_path):
    df = spark.range(3)
    files.publish(df, f"file://{tmp_path}/t")
    with pytest.raises(Exception):
        files.publish(df, f"file://{tmp_path}/t")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.cnxml").write_text("<x/>")
    assert files.read_markup(spark, f"file://{tmp_path}/deep").count() == 1


def test_rounding_and_quantising_edges(spark):
    assert [r[0] for r in spark.createDataFrame([(2.5,), (-2.5,), (0.49,)], "x double").select(round_half_up(__import__("pyspark").sql.functions.col("x"))).collect()] == [3, -2, 0]
    from pyspark.sql import functions as F

    row = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(N.quantise(F.col("v"))[1].alias("q")).collect()[0]
    assert row.q == [0, 0]
    ids = spark.createDataFrame([([5, 101, 6, 102, 7],), ([6, 102, 7],), ([1, 2],), ([102, 101],)], "v array<int>").select(N.loss_mask(F.col("v"), 101, 102).alias("m"))
    assert [r.m for r in ids.collect()] == [[1, 0, 0, 0, 1], [0, 0, 1], [1, 1], [0, 0]]

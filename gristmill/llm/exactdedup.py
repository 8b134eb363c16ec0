"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every text into two independent bit tables and finds the cells that
two or more rows hit; what is shuffled is cell numbers, combined before the shuffle.
Pass two tests every row against those cells: a row with a cell of its own in either
table is certainly unique and passes straight through.  Only possibly repeated rows are
shuffled, by the SHA-256 of their text, which alone decides equality.

The tables have about 16 cells a row, up to MAX_CELLS, so what is broadcast (the
repeated cells, as bitmaps) is at most 2 * MAX_CELLS / 8 bytes = 32 MB at any size.
Beyond that, more unique rows look repeated and are shuffled; results stay exact.

Defined results.  Null text equals empty text.  Texts are equal when identical.  Of
equal texts the row with the largest id stays; null ids come below all others.  Rows
repeated with the same id and text form one group of which one row stays.  An empty
table gives an empty table.  Extra columns are carried, but for the names of the output
(`keep_id`, `group_size`, `kept`, `text_sha256`), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, bitmaps, cells_for, hit, null_low, stored

OUT = ("keep_id", "group_size", "kept", "text_sha256")


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _cells(hashed: Column, cells: int) -> list[Column]:
    return [hashed.bitwiseAND(cells - 1), F.shiftrightunsigned(hashed, 32).bitwiseAND(cells - 1)]


def repeated_cells(df: DataFrame, text: str, cells: int) -> DataFrame:
    """(which table, bitmap number, bitmap) of the cells that several rows hit."""
    a, b = _cells(F.col("h"), cells)
    at = df.select(F.xxhash64(_text(text)).alias("h")).select(F.explode(F.array(a, b + F.lit(cells))).alias("cell"))
    twice = at.groupBy("cell").count().filter("count > 1")
    which = (F.col("cell") >= cells).cast("int")
    return bitmaps(twice.select(which.alias("which"), F.col("cell").bitwiseAND(cells - 1).alias("cell")), "which")


def flagged(df: DataFrame, text: str = "text", rows: int | None = None) -> DataFrame:
    """`df` with `__maybe`: false where no other row can have the same text."""
    rows = df.count() if rows is None else rows
    cells = cells_for(rows)
    bits = stored(repeated_cells(df, text, cells), "repeated-cells")
    out = df.withColumn("__h", F.xxhash64(_text(text)))
    for which, cell in enumerate(_cells(F.col("__h"), cells)):
        out = hit(out, cell, bits.filter(F.col("which") == which), f"__hit{which}")
    return out.withColumn("__maybe", F.col("__hit0") & F.col("__hit1")).drop("__h", "__hit0", "__hit1")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `df` with keep_id, group_size, kept and text_sha256."""
    df = df.drop(*[c for c in OUT if c != id_col])
    rows = df.count()
    marked = flagged(df, text, rows)
    sha = F.sha2(_text(text), 256)
    id_type = df.schema[id_col].dataType
    alone = marked.filter(~F.col("__maybe")).drop("__maybe").withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True), "text_sha256": sha})

    maybe = marked.filter("__maybe").drop("__maybe").withColumn("text_sha256", sha)
    groups = stored(
        maybe.groupBy("text_sha256").agg(F.max(null_low(F.col(id_col))).alias("top"), F.count(F.lit(1)).alias("group_size")).select("text_sha256", F.col(f"top.{id_col}").cast(id_type).alias("keep_id"), "group_size"),
        "exact-groups",
    )
    limit = max(2, rows // HOT_SHARE)  # at most HOT_SHARE groups reach it
    hot = F.broadcast(groups.filter(F.col("group_size") >= limit))
    cold = groups.filter(F.col("group_size") < limit)
    joined = maybe.join(hot, "text_sha256").unionByName(maybe.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(cold, "text_sha256"))

    best = F.col(id_col).eqNullSafe(F.col("keep_id"))
    losers = joined.filter(~best).withColumn("kept", F.lit(False))
    once = Window.partitionBy("text_sha256").orderBy(F.lit(1))
    winners = joined.filter(best).withColumn("kept", F.row_number().over(once) == 1)
    return alone.unionByName(losers).unionByName(winners)


def digests(docs: DataFrame) -> DataFrame:
    """Result of the registered query: one row per document."""
    return exact_dedup(docs.select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

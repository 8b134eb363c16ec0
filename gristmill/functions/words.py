"""Word and n-gram columns.  Words are runs without blank, tab, line feed or return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern of a word.
WORD = r"[^ \t\n\r]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def letters(text: Column, least: int = 3) -> Column:
    """Lower-case runs of at least `least` ASCII letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0))


def grams(of: str, n: int) -> Column:
    """Runs of `n` neighbouring words of the array column `of`, joined by blanks.

    The words must be a column of their own, or each run would find all words again.
    """
    size = F.size(of)
    places = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(of, i, n), " "))


def gram_keys(of: str, n: int) -> Column:
    """Runs of `n` neighbouring words of the array column `of`, each as 128 bits of hash.

    Two runs share a key with a chance of 2 ** -128 times the square of their number.
    """
    size = F.size(of)
    places = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))
    told = lambda i: [F.get(of, i + k) for k in range(n)]
    return F.transform(places, lambda i: F.struct(F.xxhash64(*told(i)).alias("a"), F.xxhash64(F.lit(n), *told(i)).alias("b")))

"""Ranking of documents for questions: exact and fuzzy words, coverage, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import letters


def postings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word) for every distinct word of a row."""
    return df.select(key, F.explode(F.array_distinct(letters(F.col(text)))).alias("word"))


def idf(words: DataFrame, rows: int) -> DataFrame:
    """Integer weight 16 * (bits of N div df) / 2 of each word."""
    df = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return df.select("word", "n", F.expr(f"cast(16 * length(bin({rows} div n)) div 2 as bigint)").alias("weight"))


#: Question words up to this number (some 30 bytes each) are broadcast; beyond it they are shuffled.
FEW_WORDS = 1_000_000


def ranked(questions: DataFrame, docs: DataFrame, key: str, doc: str, weights: DataFrame, k: int) -> DataFrame:
    """Top `k` documents per question by summed weights; ties to the smaller id.

    Question words meet document words in one equi-join; questions are never crossed
    with documents.  Few question words are broadcast, so document words, common ones
    too, stay where they are; the rank filter runs before the shuffle (group limit).
    """
    asked = few(questions)(questions.join(weights, "word"))
    score = docs.join(asked, "word").groupBy(key, doc).agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("matched"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), doc)
    return score.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def few(words: DataFrame):
    return F.broadcast if words.count() <= FEW_WORDS else lambda df: df


def asked_only(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """Document words that some question has."""
    return docs.join(few(questions)(questions.select("word").distinct()), "word", "left_semi")


def term_score(text: Column, term: str, base: int) -> Column:
    """Null without the term; a whole word adds 300, a prefix 150, late places cost up to 200."""
    low = F.lower(text)
    whole, prefix = low.rlike(f"(^|[^a-z]){term}([^a-z]|$)"), low.rlike(f"(^|[^a-z]){term}")
    bonus = F.when(whole, 300).when(prefix, 150).otherwise(0)
    place = F.locate(term, low) - 1
    return F.when(place >= 0, F.lit(base) + bonus - F.least(F.expr("cast(0 as int)") + F.floor(place / 10).cast("int"), F.lit(200)))

"""Readers and writers around Spark's own: JSON lines, markup trees, run logs, atomic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "head string, kind string, text string, ans string, bare boolean, scrambled boolean"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Corpus documents, one JSON object a line; a missing kind is ANSWER."""
    return spark.read.schema(DOCUMENT).json(path).withColumn("kind", F.coalesce("kind", F.lit("ANSWER")))


def read_markup(spark: SparkSession, root: str, pattern: str = "*.cnxml") -> DataFrame:
    """(path, value) of every matching file below `root`."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.input_file_name().alias("path"), "value")


def parse_runs(logs: DataFrame, marker: str = "== run") -> DataFrame:
    """Key/value pairs of the last block of each log that holds any."""
    blocks = logs.select(F.posexplode(F.split("value", marker)).alias("block", "body"))
    pairs = blocks.select("block", F.explode(F.arrays_zip(F.regexp_extract_all("body", F.lit(r"(\w+)=([^\s]+)"), F.lit(1)).alias("k"), F.regexp_extract_all("body", F.lit(r"(\w+)=([^\s]+)"), F.lit(2)).alias("v"))).alias("p"))
    return pairs.groupBy(F.col("p.k").alias("key")).agg(F.max_by("p.v", "block").alias("value"))


def publish(df: DataFrame, path: str) -> None:
    """Write a table that becomes visible at once and never replaces another."""
    df.write.mode("errorifexists").parquet(path)

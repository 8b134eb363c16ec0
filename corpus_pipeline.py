"""From raw documents to token ids: quality, exact and near dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of `documents`; the last one returns the encoded documents.  A
document that the mix takes twice is there twice afterwards.

Defined results.  Null and empty texts are scored like all others and count as one text;
one such row stays.  They hold no word, so the mix never takes them.  Very long texts are
read whole.  Null ids come below all others in exact dedup, and stay in near dedup only
where no row with an id is near.  Rows that repeat an id are judged by their own texts;
of equal rows one stays, until the mix repeats it.  A null source is a source of its own,
missing metadata count as null.  An empty table gives an empty table at every stage.
Extra columns are carried, also those whose names a stage uses for its own results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, cotrain, exactdedup, mixing, probminhash
from gristmill.llm.common import stored, table


def beside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work(docs)` with the columns of `docs`; its own columns named like `names` are kept aside meanwhile."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in names}
    return work(docs.withColumnsRenamed(aside)).select(*(F.col(aside[c]).alias(c) if c in aside else F.col(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"))
    return beside(docs, cotrain.OUT, lambda d: cotrain.score(d, model).filter("kept"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return beside(docs, exactdedup.OUT, lambda d: exactdedup.exact_dedup(d).filter("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the smallest doc_id stays."""
    return probminhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    repeat = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return beside(docs, mixing.OUT, lambda d: mixing.mix(d).filter("copies > 0").withColumn("__copy", repeat))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with a decoded round trip, as digests."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mixing", mixture),
    ("byte-level BPE", encoded),
]

#: Fitted classifiers, signatures and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs, f"pipeline-{i}"), sf_dir)
    return docs

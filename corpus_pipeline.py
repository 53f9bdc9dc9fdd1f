"""From raw documents to token ids. Each stage reads all that the one before it kept.

Defined results of all stages: null texts count as empty; texts of any length are read whole; an empty table gives an empty
table; further columns are carried as they came whatever their names (not by the last stage, which returns ids); nulls in any
other column are ordinary values, and rows without an id are documents of their own. What each does with empty texts, ties
and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediaqc.llm import bpe, exact_dedup, mixing, near_dedup, quality
from mediaqc.llm.common import cut, documents, forget

#: No SQL can express the classifier, the shuffled mix and the encoding.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Empty texts are judged as one like any other; a tail equal to the threshold stays; repeated rows are judged alike.
    """
    return quality.score(docs, quality.production(spark, docs, sf_dir), carry=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest, then the smallest id, null ids last; of repeated rows one.

    Empty texts and those of white space only are one group.
    """
    return exact_dedup.keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id; of rows that repeat an id one.

    Texts without words and rows without an id are like nothing and stay.
    """
    return near_dedup.keep_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or repeated.

    Texts without words are not taken; the null source is one of its own; repeated rows count one by one.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, with digests of the ids and of the bytes decoded from them.

    An empty text has no ids; repeated rows repeat.
    """
    return bpe.round_trip(docs, *bpe.vocabulary(), with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix_sources", mix),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is deleted when the next one is written; that of the last but one stays, as the result reads it."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            found = cut(found, name)
            forget(docs)
        docs = found
    return docs

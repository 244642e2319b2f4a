"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``.  Texts of any length are taken whole; an empty table stays
empty through all stages; further columns, whatever their names, are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from protolith.llm import bpe, exact, language, mix, near
from protolith.llm._common import ship, table, written

TOKENIZER = "word_bpe_49k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found.

    Null, empty and letterless texts go, and so does every text where no row has a label
    to learn from; all else stays, ambiguous texts, null ids and repeated rows included.
    """
    ship(spark)
    return language.with_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: most code points, then the smallest id, a null id last.

    Null and blank texts are one group; of rows that repeat an id and a text one stays.
    """
    ship(spark)
    return exact.distinct_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), the smallest id.

    Texts without words and rows without an id are linked with nothing and stay; of the
    texts of a repeated id, one may stay and another go.
    """
    ship(spark)
    return near.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it.

    Texts without words are taken 0 times; a null source is a source of its own; rows that
    agree in id, source and text all have the positions of the first.
    """
    ship(spark)
    return mix.curriculum(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's whole text as counts and digests, a row for each time it is taken; null text is empty."""
    ship(spark)
    return bpe.digests(docs, bpe.build_lexicon(docs, public_tokenizers.path(TOKENIZER)), TOKENIZER)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mix_sources", mix_stage), ("bpe", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Not SQL: the stages learn, hash and merge.  tests/llm/ holds run() against a brute-force version.
ORACLE_SQL = None

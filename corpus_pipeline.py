"""Documents to packed sequences: languages, near duplicates, repeated passages, source weights, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as Parquet before the next one reads it. All
but the last return the columns of `documents`, in order and with their types, and other columns that docs may have pass by, whatever their names.

Cases, the same for all stages: an empty table gives an empty table; nulls may stand in any column; repeated rows are documents of their own
until a stage drops them; very long texts are read whole. What each stage does with them is in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, ngram_join, packing, repeats
from millrace.llm.common import crc_mod, scratch, staged, unstage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus' own labels teach.

    Null, empty and letterless texts go; rows without a label or an id are judged but teach nothing; where no row teaches, all stay."""
    return langid.kept(docs, langid.train(docs, crc_mod("doc_id", 3) != 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Texts without words are like nothing and stay; of rows equal in id and text one stays; a row without an id stays unless its group has an id."""
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat anywhere; n_chars follows the text.

    A null text stays null with n_chars null; a text that repeats whole stays as an empty one."""
    cut = repeats.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, which may be never.

    Null texts count as empty ones, whose rate is that of their posterior; rows equal in id and text have one rate."""
    return mixing.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is an empty one, which is its end id alone."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", source_weights),
    ("packing", packed_sequences),
]

#: The stages learn models and hash bytes, which SQL can't say; tests hold near duplicates, passages and packing against brute force and
#: the learned stages against held-out labels and their own fixed models.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the corpus. What a stage wrote on its way goes when its result is written, and a result when the next is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch() as keep:
            after = keep(staged(stage(spark, docs, sf_dir), name))
        if k:
            unstage(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

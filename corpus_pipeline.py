"""The corpus pipeline: raw documents to packed training windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.queries import vocabulary

#: Words that a Python worker remembers with their ids. The same workers serve all stages, so it is small.
MEMO = 100_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, as the classifier learned it from the labels; all, where there are none to learn from.

    Null and empty texts are scored as texts without words, equal texts share their fate, and an empty
    table gives an empty one. All columns stay, whatever their names, here and in the next three stages.
    """
    from docloom.llm.quality import fit_quality, keep_quality

    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the document with the smallest id; one, where rows repeat it.

    Null texts are empty ones and equal each other; an empty table gives an empty one.
    """
    from docloom.llm.exact_dedup import drop_duplicates

    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that shingles of five words link at a similarity of 0.8, one document.

    Texts without words are linked with nothing and stay; an empty table gives an empty one.
    """
    from docloom.llm.neardup import drop_near_duplicates

    return drop_near_duplicates(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights, some documents twice and some not at all.

    A null source is one of its own. Null and empty texts have no words and are not drawn; an empty
    table gives an empty one.
    """
    from docloom.llm.mixing import mixed_documents

    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 4096 tokens, with the ids, from all rows that are left; ``item`` tells two draws of a document apart.

    Null and empty texts are their end id alone, long texts are cut into windows, an empty table gives none.
    """
    from docloom.llm.packing import pack_documents

    return pack_documents(docs, vocabulary("word_bpe_49k.json"), with_ids=True, memo=MEMO)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Tokenisation and trained models are not expressible in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again as the next one's input."""
    from docloom.llm.common import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

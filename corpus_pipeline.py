"""The training-data pipeline: each stage works on all that the one before kept.

language ID -> exact dedup -> near dedup -> benchmark decontamination -> packing. The first four return the columns of
documents; the last returns a row for each piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import Scratch
from tidelog.llm.decontam import drop_contaminated
from tidelog.llm.exact_dedup import drop_copies
from tidelog.llm.langid import keep_known
from tidelog.llm.near_dedup import one_of_each
from tidelog.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: without those of null text, without a letter, or that no learned language codes shorter than no model does."""
    return keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space: the longest, then the smallest doc_id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document left, with its place in a sequence of at most 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is stored in the shared folder and read again.

    What a stage stored on its way goes when its result is stored, a stage's result when the next one's is, and the last
    one with the session.
    """
    docs, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        kept = len(Scratch.made)
        docs = results.save(stage(spark, docs, sf_dir), name)
        Scratch.forget(kept)
        if k:
            results.drop(STAGES[k - 1][0])
    return docs


#: Language ID and SimHash have no SQL; run() is tested stage by stage against brute-force versions.
ORACLE_SQL = None

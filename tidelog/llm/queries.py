"""Thin queries over the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.pii import derived_key, surrogates

    return surrogates(table(spark, sf_dir, "documents"), derived_key("a phrase for tests; keep a production key secret"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_OP3 = r"""
with t as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as h from documents),
r as (select *, row_number() over (partition by h order by n desc, doc_id) as k from t)
select doc_id, first_value(doc_id) over (partition by h order by k) as keep_id,
  count(*) over (partition by h) as group_size, k = 1 as kept, h as text_sha256 from r
"""


def oracle_sql() -> dict[str, str]:
    from tidelog.llm.line_dedup import ORACLE

    return {"op3_exact_dedup": _OP3, "op5_line_dedup": ORACLE}

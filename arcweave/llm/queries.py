"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcweave.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcweave.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcweave.llm.winnow import compare_edited

    return compare_edited(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcweave.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcweave.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcweave.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of the setting spark.arcweave.pii.key; where it is unset, with one that everybody knows, for test tables alone."""
    from arcweave.llm.pii import pseudonymize_documents

    key = spark.conf.get("spark.arcweave.pii.key", None) or "public key of the test tables"
    return pseudonymize_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcweave.llm.quality_rules import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcweave.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcweave.llm.classifier import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_html_extract, op3_winnow, op4_line_dedup, op5_token_count, op6_mix, op7_pii, op8_quality_rules, op9_pack, op10_classifier)}


def oracle_sql() -> dict[str, str]:
    from arcweave.llm import line_dedup

    return {"op4_line_dedup": line_dedup.SQL}

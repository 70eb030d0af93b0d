"""From raw documents to packed training sequences, as five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's documents. All but the last
return the columns of ``documents``.

Every stage takes nulls in any column, empty and very long texts, repeated rows,
an empty table and further columns as its operator defines, and says below what
becomes of them. Tables that a stage leaves in the shared folder go when the next
stage begins, whose input is written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.line_dedup import dedup_lines
from arcweave.llm.mixing import mixed_documents
from arcweave.llm.packing import pack_documents
from arcweave.llm.quality_rules import filter_quality
from arcweave.llm.queries import BYTE_BPE, vocabulary
from arcweave.llm.simhash import drop_near_duplicates
from arcweave.llm.text import has_word
from arcweave.plans.lineage import drop_folders, materialize, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders of the tables that the stage before has left.
_left: list[str] = []


def _after(before: str | None) -> Callable[[Stage], Stage]:
    """A stage that frees what the one before it left; the first stage frees nothing."""

    def of(work: Stage) -> Stage:
        @wraps(work)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if before:
                drop_folders(spark, _left, unless=docs)
            _left.clear()
            with recorded() as made:
                out = work(spark, docs, sf_dir)
            _left.extend(made)
            return out

        return run_stage

    return of


@_after(None)
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the weak supervision of the quality rules rejects go, empty and null texts among them."""
    return filter_quality(docs)


@_after("quality_rules")
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: later occurrences of repeated passages go; so do documents of which no word is left.

    A null text stays null, an empty one empty; ``n_chars`` follows the text.
    """
    done = dedup_lines(docs)
    left = done.where((F.col("n_removed") == 0) | has_word(F.col("text")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_after("line_dedup")
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group of near-duplicates stays, that of the smallest id, null ids last.

    Texts without a word, null ones included, are one group.
    """
    return drop_near_duplicates(docs)


@_after("simhash_near_dedup")
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents are taken as often as their source's target weight asks; null sources are one source, and texts without words count 0."""
    return mixed_documents(docs)


@_after("source_mixing")
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: tokenised documents are packed into sequences; a null text is an empty one, and copies are packed once each."""
    return pack_documents(docs, vocabulary(BYTE_BPE))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Tokenisation and the draws of the mix can't be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

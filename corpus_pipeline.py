"""From raw documents to packed training sequences, stage by stage.

Every stage reads what its predecessor kept, written as Parquet, and calls one operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from subscope.llm import exact, language, mixing, packing, simhash
from subscope.llm.common import staged, table
from subscope.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the rejected ones go.

    A row is judged by its text, lang and source and the pages that name its doc_id; null or
    empty texts have no language of their own and are judged by the rest. Repeated rows stay
    repeated, other columns are kept whatever their names, no documents give none.
    """
    return language.in_known_languages(spark, docs, sf_dir)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts.

    White space does not count, null counts as empty. The longest stays, then the smallest
    doc_id (null last), one of identical rows. Columns are kept whatever their names.
    """
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates.

    Texts without words, null ones too, have fingerprint zero and are near each other. The
    smallest doc_id stays (null last), one of identical rows. Columns are kept whatever
    their names, no documents give none.
    """
    return simhash.without_near_duplicates(docs)


def mixing_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: documents as often as their source's target takes them, by position.

    Null is a source of its own; texts without words are taken as often as others near them
    and add nothing. Rows that repeat have plans of their own, ties go by doc_id, text and
    row. Columns are kept whatever their names, no documents give none.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document of the mix in the training sequences.

    Sequences are numbered in the order of the mix, which is that of the rows in their
    files. A null or empty text is the end token alone, repeated rows are packed as often as
    they come, other columns are ignored, no documents give no sequences.
    """
    return packing.packing_in_order(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_by_weight),
    ("packing", best_fit_packing),
]

#: Fingerprints, trigram models and tokens have no form in SQL; the tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

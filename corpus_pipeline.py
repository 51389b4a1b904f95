"""The corpus pipeline: language ID, near duplicates, secrets, packing, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import jaccard, langid, packing, secret_scan
from rasterloom.session import clear, cut, ensure_importable, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts stay; it is trained on a bounded sample of the docs' own labels (lang).

    Cases: null and empty texts and texts without letters go. Long texts are scored whole. Rows without doc_id or lang and repeated rows are judged by their text like any other; ties go to the language first by name. Without any label nothing is accepted. Columns, clashing names among them, stay as they are. Empty table: empty result.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each near-duplicate group stays, and every document without a group.

    Cases: rows without doc_id, text or words stay. Long texts count whole. Of rows equal in doc_id and text one stays; a doc_id with several texts keeps each. Extra columns stay, whatever their names. Empty table: empty result.
    """
    return jaccard.first_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in text are masked, and n_chars follows where the text changed.

    Cases: null and empty texts stay as they are. Long texts are scanned whole. Repeated rows are each masked. Extra columns stay, whatever their names. Empty table: empty result.
    """
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its bucket, batch and slot: the columns of packing.pack.

    Cases: null and empty texts have length 0. A text longer than the budget is a batch of its own, whole. Rows without doc_id come first; repeated rows are packed each, ties in doc_id by length. Other columns are left behind. Empty table: empty result.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packed)]

#: Scoring, min-wise search and the tokenizer aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and reread as the next one's docs. What a stage wrote on its way is deleted once its result stands."""
    ensure_importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
            clear(spark, mark, keep=1)
    return docs

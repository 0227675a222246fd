"""The training-data pipeline: five corpus operators, each on all that its predecessor kept.

Every stage takes documents (doc_id, text, lang, n_chars and any other columns, whatever their names) and
stands null ids, null and empty texts, repeated rows and an empty table: those that a stage does not
name it keeps as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborline.llm import bpe, decontam, quality, secrets, simhash
from arborline.llm.common import finished, remove, scratch_scope
from arborline.llm.queries import table, vocabulary


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model of trusted text does not reject.

    Null and empty texts stay, as they show nothing bad; documents with null ids are judged but never
    trusted; repeated rows stay or go together; without trusted documents all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies: the one with the smallest id.

    Null and empty texts are copies of one another; a null id comes after all others and goes only as an
    exact copy; rows that repeat an id and its text are one document and stay together.
    """
    return simhash.first_of_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null and empty texts stay, as they hold nothing; ids play no part, repeated rows stay or go together;
    null and blank items are none, and an empty benchmark keeps all.
    """
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked.  Null and empty texts stay as they are."""
    return secrets.redact(docs, vocabulary())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's tokens and of the text they decode to, one row for each document.

    Null and empty texts have no tokens and the digests of nothing; ids pass through, null or repeated.
    """
    return bpe.bpe_digests(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder, each written and read again; what a stage no longer
    needs is deleted, and the last one's table is what stays."""
    docs, written = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with scratch_scope(spark) as scope:
            docs = finished(stage(spark, docs, sf_dir), f"stage{k}", scope)
        if written is not None:
            remove(spark, written)
        (written,) = scope
    return docs


#: No SQL expresses the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None

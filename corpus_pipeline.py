"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Quality classifier, near-dedup, benchmark decontamination, redaction of personal data,
and piece encoding with decoding. The first four return the columns of ``documents``; the last
adds piece ids and has the decoded text.

Every stage reads whole texts, however long, takes null and empty texts, null and repeated ids and repeated rows, gives an empty
result for an empty table, and keeps all other columns of its input, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm import decontam, pieces, privacy, quality, simhash
from roadloom.llm.common import landed, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    A null or empty text is judged as the empty text; equal texts stay or go together; a score of exactly 0.5 stays, and
    so does every document where there are no labels of both kinds.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate component (null ids last).

    Of rows with that id and fingerprint, the one with the least text stays, then the one whose other columns hash least. All null
    and empty texts are near each other.
    """
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item or an edited copy of it.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark drops nothing.
    """
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in each text by their kind; n_chars is the new length.

    Null texts stay null and keep their n_chars; of added spans that overlap, the likelier one counts.
    """
    return privacy.redacted(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and in its place the text that they decode to.

    Null and empty texts have no ids and decode to the empty text. Columns named as the new ones (ids, n_tokens, n_bytes,
    ids_crc32, round_trip) are replaced.
    """
    return pieces.encoded(docs, carry=[c for c in docs.columns if c != "text"], decoded="text")


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii redaction", privacy_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: Learned scores, alignments and pieces are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

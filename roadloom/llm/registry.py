"""Queries of the text operators by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm import decontam, lm, pieces, privacy, quality, sharding, simhash, tokenfiles, topk, urls
from roadloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"))


ORACLES["op3_url_filter"] = urls.oracle()


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and slot for every document."""
    return sharding.assign(table(spark, sf_dir, "documents"))


ORACLES["op7_sharding"] = sharding.ORACLE


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.group_documents(table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item or an edited copy of it."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return privacy.scan(table(spark, sf_dir, "documents"))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, decoded again."""
    return pieces.encoded(table(spark, sf_dir, "documents"), carry=["doc_id"])


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files and read back."""
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"))


@query
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return topk.search(table(spark, sf_dir, "embeddings"))


ORACLES["op8_topk"] = topk.ORACLE


@query
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document."""
    return lm.score_documents(table(spark, sf_dir, "documents"))

"""The registered queries of the text operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.llm import collapse, maincontent, mixture, near, quality, reading, residue, sql, tokens
from pagestrata.runtime import table, written


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), tokens.vocabulary())


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found(table(spark, sf_dir, "page_data"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.found(table(spark, sf_dir, "page_data"))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.copy_counts(table(spark, sf_dir, "page_data"), "page_id", collapse.PAGE_ROLES)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maincontent.found(table(spark, sf_dir, "page_data"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.found(table(spark, sf_dir, "page_data"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.found(table(spark, sf_dir, "page_data"))


def _mixture(spark: SparkSession, sf_dir: str, of_corpus: bool = False) -> tuple[DataFrame, DataFrame]:
    """Copies and shares; of_corpus asks for as many tokens as all documents have, so that small sources are clamped."""
    documents = table(spark, sf_dir, "documents")
    sized = written(tokens.count_tokens(documents, tokens.vocabulary(), keep=["source"]), "token-sizes")
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] if of_corpus else None
    return mixture.mix(sized, table(spark, sf_dir, "mix_targets"), budget)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p9_corpus_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir, of_corpus=True)[0]


def p9_corpus_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir, of_corpus=True)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_copies": p4_copies,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_corpus_mix": p9_corpus_mix,
    "p9_corpus_shares": p9_corpus_shares,
    "p10_found": p10_found,
}
ORACLE: dict[str, str] = sql.ORACLE

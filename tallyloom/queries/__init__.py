"""Registered queries and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from . import business, checks, claims, evaluation, evidence, judgments, ledger, operations, ranking, records, retrieval, statements, stores, streams, texts  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid_rank(spark, sf_dir)

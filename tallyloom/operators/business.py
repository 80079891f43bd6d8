"""Joins and roll-ups of the business tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(parents: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each parent with its latest row (or nulls), by an aggregate that combines before the shuffle."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r"))
    return parents.join(last, key, "left").select(*parents.columns, *[F.col(f"r.{c}").alias(c) for c in rows.columns if c != key])


def first_per_key(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key and the value that comes first."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def grouped_count(rows: DataFrame, by: str, allowed: tuple[str, ...], limit: int = 200, where: Column | None = None) -> DataFrame:
    """label and value by one of the ``allowed`` columns, most frequent first."""
    if by not in allowed:
        raise ValueError(f"grouping by {by} is not allowed")
    rows = rows if where is None else rows.filter(where)
    return rows.groupBy(F.col(by).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("value")).orderBy(F.col("value").desc(), "label").limit(max(1, min(limit, 200)))


def status_shares(rows: DataFrame, status: str, known: tuple[str, ...]) -> DataFrame:
    """status ('other' where unknown), value, denominator."""
    named = rows.select(F.when(F.col(status).isin(*known), F.col(status)).otherwise("other").alias("status"))
    counts = named.groupBy("status").agg(F.count(F.lit(1)).alias("value"))
    whole = named.agg(F.count(F.lit(1)).alias("denominator"))
    return counts.join(F.broadcast(whole))  # one row


def exactly_one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have exactly one distinct value, with it."""
    return rows.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("n")).filter("n = 1").drop("n")


def last_wins(rules: DataFrame, key: str, priority: str, position: str) -> DataFrame:
    """A union by key: the row of greatest priority, at the first position where the key was seen."""
    rest = [c for c in rules.columns if c not in (key, position)]
    return rules.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(priority, position)).alias("r"), F.min(position).alias(position)).select(key, position, *[F.col(f"r.{c}").alias(c) for c in rest])


def signature_contexts(tokens: DataFrame, contexts: DataFrame) -> DataFrame:
    """source, context by shared tokens: only tokens of exactly one context count, and then only sources that
    lead to exactly one. ``tokens``: source, token; ``contexts``: token, context."""
    sure = exactly_one(contexts, "token", "context")
    return exactly_one(tokens.join(sure, "token").select("source", "context"), "source", "context")

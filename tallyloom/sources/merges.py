"""Keyed merges of tables without an ACID format: a new version of a table from the old and its changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """A row for each key: the one of the greatest version. Changes are combined before the shuffle, so a key
    that changes often is no hot key."""
    rest = [c for c in base.columns if c not in keys]
    latest = base.unionByName(changes).groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in base.columns])


def append_numbered(rows: DataFrame, key: str, order: list[str], lasts: DataFrame) -> DataFrame:
    """``rows`` with sequence, going on from each key's ``last``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("n", n).join(lasts, key, "left").withColumn("sequence", (F.col("n") + F.coalesce("last", F.lit(0))).cast("long")).drop("n", "last")


def two_way_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a, only_b, equal: rows of one table that the other lacks, repeats counted, from one full join of
    counts."""
    count = lambda df, n: df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(n))
    x = count(a, "na").join(count(b, "nb").withColumnsRenamed({c: f"_{c}" for c in b.columns}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in a.columns], "full")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return x.agg(F.coalesce(F.sum(F.greatest(na - nb, F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(nb - na, F.lit(0))), F.lit(0)).alias("only_b")).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))

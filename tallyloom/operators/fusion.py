"""Rank fusion, merging of candidate lists, reserves and quotas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rank_in(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def reciprocal_ranks(routes: DataFrame, keys: list[str], k: int = RRF_K, tie: str = "desc", **more: Column) -> DataFrame:
    """keys, id, rrf, best, routes, rank from rows (keys, route, id, rank, score): the sum of 1 / (k + rank),
    in order of rrf and best score, ties to larger ids ('desc') or smaller ('asc'). Ranks are as given: those
    of rows that a threshold has dropped stay unused. ``more``: further aggregates of a candidate by name."""
    fused = routes.groupBy(*keys, "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.max("score").alias("best"), F.count_distinct("route").alias("routes"), *[c.alias(n) for n, c in more.items()])
    last = F.col("id").desc() if tie == "desc" else F.col("id").asc()
    return rank_in(fused, keys, [F.col("rrf").desc(), F.col("best").desc(), last])


def merge_lists(dense: DataFrame, lexical: DataFrame, keys: list[str]) -> DataFrame:
    """Two lists (keys, id, rrf, sources) as one: rrf summed where both have a candidate, sources united."""
    return merged_rows(dense.select(*keys, "id", "rrf", "sources").unionByName(lexical.select(*keys, "id", "rrf", "sources")), keys)


def merged_rows(lists: DataFrame, keys: list[str]) -> DataFrame:
    """As merge_lists() of lists that are rows of one table. Lists that one search has found are not parted before,
    since each part would search again."""
    return lists.groupBy(*keys, "id").agg(F.round(F.sum("rrf"), 9).alias("rrf"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def concatenated(routes: DataFrame, keys: list[str], order: dict[str, int]) -> DataFrame:
    """keys, id, route, place: routes one after another by ``order``, each in its ranks; the first of an id counts."""
    at = F.struct(F.try_element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("route")), "rank")
    first = routes.groupBy(*keys, "id").agg(F.min_by("route", at).alias("route"), F.min(at).alias("at"))
    return rank_in(first, keys, ["at"], "place").drop("at")


def with_reserves(pool: DataFrame, special: DataFrame, keys: list[str], reserve: int, double_count: bool = False) -> DataFrame:
    """``pool`` (keys, id, rrf) and the first ``reserve`` of ``special`` (keys, id, rrf, route_rank, score) by
    route rank, score and id. A reserved candidate that the pool has already counts once, or twice with
    ``double_count``."""
    held = rank_in(special, keys, [F.col("route_rank").asc(), F.col("score").desc(), F.col("id").asc()], "place").filter(F.col("place") <= reserve).select(*keys, "id", "rrf")
    if not double_count:
        held = held.join(pool.select(*keys, "id"), [*keys, "id"], "left_anti")
    return pool.select(*keys, "id", "rrf").unionByName(held).groupBy(*keys, "id").agg(F.round(F.sum("rrf"), 9).alias("rrf"))


def with_reserves_of(routes: DataFrame, keys: list[str], route: str, pool: int, reserve: int, k: int = RRF_K, double_count: bool = False) -> DataFrame:
    """As with_reserves() where both are of the same ``routes`` (keys, route, id, rank, score), which are read once: the
    ``pool`` first rows of reciprocal_ranks(), and the ``reserve`` first of ``route``."""
    placed = rank_in(routes, [*keys, "route"], [F.col("rank").asc(), F.col("score").desc(), F.col("id").asc()], "place")
    held = F.sum(F.when((F.col("route") == route) & (F.col("place") <= reserve), F.round(1.0 / (k + F.col("rank")), 9)))
    fused = reciprocal_ranks(placed, keys, k, held=held)
    pooled = F.col("rrf") + F.coalesce("held", F.lit(0.0)) if double_count else F.col("rrf")
    inside = F.col("rank") <= pool
    return fused.filter(inside | F.col("held").isNotNull()).select(*keys, "id", F.round(F.when(inside, pooled).otherwise(F.col("held")), 9).alias("rrf"))


def typed_quota(ranked: DataFrame, keys: list[str], quotas: dict[str, int], default: int = 0) -> DataFrame:
    """The first rows of each type by rank, as many as its quota."""
    limit = F.coalesce(*[F.when(F.col("type") == t, n) for t, n in quotas.items()], F.lit(default))
    return rank_in(ranked, [*keys, "type"], [F.col("rank").asc()], "place").filter(F.col("place") <= limit).drop("place")


def typed_quota_with_unknown(ranked: DataFrame, key: str, tables: int, sections: int) -> DataFrame:
    """As typed_quota() for 'table' and 'section', in rank order; a row of another type takes a section's
    place while no more sections than tables are taken, and else a table's. What went before decides, so
    each query's list, which retrieval has bounded, is walked in order."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        left, kept = {"table": tables, "section": sections}, []
        taken = {"table": 0, "section": 0}
        for i, t in pdf.sort_values("rank")["type"].items():
            t = t if t in left else "section" if taken["section"] <= taken["table"] else "table"
            if taken[t] < left[t]:
                taken[t] += 1
                kept.append(i)
        return pdf.loc[kept]

    return ranked.groupBy(key).applyInPandas(walk, ranked.schema)


def route_preserving_top(ranked: DataFrame, keys: list[str], per_type: int, preserve: int) -> DataFrame:
    """``per_type`` rows of each type: the first ``preserve`` of each route, then the best by score."""
    own = rank_in(ranked, [*keys, "type", "route"], [F.col("rank").asc(), F.col("id")], "in_route")
    held = own.withColumn("held", (F.col("in_route") <= preserve).cast("int"))
    filled = rank_in(held, [*keys, "type"], [F.col("held").desc(), F.col("score").desc(), F.col("id")], "place")
    return filled.filter(F.col("place") <= per_type).drop("in_route", "held", "place")


def merge_pools(pools: DataFrame, keys: list[str], k: int = RRF_K) -> DataFrame:
    """keys, sha, id, rrf, rank from (keys, pool, source, id, text, rank): candidates of equal text are one,
    each pool and source counts once, by its first rank."""
    hashed = pools.withColumn("sha", F.sha2("text", 256))
    once = hashed.groupBy(*keys, "sha", "pool", "source").agg(F.min("rank").alias("rank"), F.min("id").alias("id"))
    fused = once.groupBy(*keys, "sha").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.min("id").alias("id"))
    return rank_in(fused, keys, [F.col("rrf").desc(), F.col("id").desc()])


def round_robin(rows: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """One row of each group a round, groups in order, ``limit`` in all."""
    # No later round than the limit can be reached, so a large group is cut before it is sorted.
    return rank_in(rows, [group], [F.col(order)], "round").filter(F.col("round") <= limit).orderBy("round", group).limit(limit)

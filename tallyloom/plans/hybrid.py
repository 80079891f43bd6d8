"""Hybrid search: dense and lexical routes, fusion, a reranker, quotas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fusion, lexical, vectors

Reranker = Callable[[DataFrame], DataFrame]


def search(
    asked: DataFrame,
    rows: DataFrame,
    docs: DataFrame,
    size: int,
    route_k: int = 30,
    rrf_k: int = fusion.RRF_K,
    dense_threshold: float = -1.0,
    rerank: Reranker | None = None,
    rerank_threshold: float = 0.2,
    quotas: dict[str, int] | None = None,
    default_quota: int = 8,
) -> DataFrame:
    """query_id, id, type, rrf, score, rank. ``asked``: query_id, v, text; ``rows``: id, v; ``docs``: id, text, type.

    Ranks are given before the dense threshold and keep their gaps. A reranker takes (query_id, id, type, rrf,
    score, pool_rank) and adds ``rerank_score``; the quota is applied in its order and the threshold after it,
    with nothing filled in. Without one the fused order stands. A hit's score is its best dense one where it
    has one.
    """
    dense = vectors.knn(asked.select(F.col("query_id").alias("id"), F.col("v").alias("v")), rows.select(F.col("id").alias("id"), F.col("v").alias("v")), route_k, size).withColumn("route", F.lit("dense")).filter(F.col("score") >= dense_threshold)
    # Equal query texts are searched once.
    who = asked.select("query_id", "text")
    texts = who.groupBy("text").agg(F.min("query_id").alias("text_id"))
    found = lexical.bm25(docs.withColumnRenamed("id", "doc_id"), texts.select(F.col("text_id").alias("query_id"), "text"), route_k)
    who = who.join(texts, "text").select("query_id", "text_id")
    words = found.withColumnRenamed("query_id", "text_id").join(who, "text_id").drop("text_id").withColumn("route", F.lit("lexical"))
    routes = dense.unionByName(words)
    fused = fusion.reciprocal_ranks(routes, ["query_id"], rrf_k).withColumnRenamed("rank", "pool_rank")
    near = dense.groupBy("query_id", "id").agg(F.max("score").alias("dense"))
    pool = fused.join(near, ["query_id", "id"], "left").withColumn("score", F.coalesce("dense", "best"))
    pool = pool.join(docs.select("id", "type"), "id").select("query_id", "id", "type", "rrf", "score", "pool_rank")
    order = F.col("pool_rank").asc()
    if rerank:
        pool = rerank(pool)
        order = F.col("rerank_score").desc()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "pool_rank"))
    kept = fusion.typed_quota(pool.withColumn("rank", place), ["query_id"], quotas or {}, default_quota)
    if rerank:
        kept = kept.filter(F.col("rerank_score") >= rerank_threshold)
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return kept.withColumn("rank", final).select("query_id", "id", "type", "rrf", "score", "rank")

"""Retrieval metrics: cases are benchmark items, gold evidence is every document that contains an item's
text, and rankings are BM25 and token overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evalmetrics, lexical, matching
from .registry import query, table
from .retrieval import _BM25, _WORDS

_BASE = f"""WITH {_WORDS}, m AS (SELECT avg(len(w)) AS mean FROM docs WHERE len(w) > 0),
rb AS (SELECT query_id AS case_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round({_BM25}, 6) AS score FROM posts JOIN terms USING (token) JOIN dfs USING (token), n, m GROUP BY query_id, id)),
ro AS (SELECT query_id AS case_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(count(*)::DOUBLE, 6) AS score FROM posts JOIN terms USING (token) GROUP BY query_id, id)),
gold AS (SELECT item_id AS case_id, doc_id % 3 AS group_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
best AS (SELECT case_id, group_id, min(rank) AS best_rank FROM gold LEFT JOIN (SELECT * FROM rb WHERE rank <= 40) r USING (case_id, id) GROUP BY case_id, group_id),
besto AS (SELECT case_id, group_id, min(rank) AS best_rank FROM gold LEFT JOIN (SELECT * FROM ro WHERE rank <= 40) r USING (case_id, id) GROUP BY case_id, group_id) """


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _ranking(spark, sf_dir, kind: str = "bm25") -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lexical.bm25(docs, _asked(spark, sf_dir), 40) if kind == "bm25" else lexical.weighted_overlap(docs, {"text": 1}, _asked(spark, sf_dir), 40)
    return found.withColumnRenamed("query_id", "case_id")


def _gold(spark, sf_dir) -> DataFrame:
    found = matching.containing(table(spark, sf_dir, "documents"), _asked(spark, sf_dir).withColumnRenamed("query_id", "pattern_id"))
    return found.select(F.col("pattern_id").alias("case_id"), (F.col("id") % 3).alias("group_id"), "id")


def _best(spark, sf_dir, kind: str = "bm25") -> DataFrame:
    return evalmetrics.best_ranks(_gold(spark, sf_dir), _ranking(spark, sf_dir, kind))


@query("SELECT item_id AS pattern_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contains_join(spark, sf_dir) -> DataFrame:
    """Documents that contain a pattern."""
    return matching.containing(table(spark, sf_dir, "documents"), _asked(spark, sf_dir).withColumnRenamed("query_id", "pattern_id"))


@query(_BASE + "SELECT case_id, group_id, best_rank FROM best")
def best_rank_per_group(spark, sf_dir) -> DataFrame:
    """A18, J13."""
    return _best(spark, sf_dir)


@query(_BASE + ", per AS (SELECT k, case_id, count(*) AS groups, min(best_rank) AS first, count(*) FILTER (best_rank <= k) AS h FROM best, (SELECT unnest([1, 3, 5, 10, 20, 40]) AS k) GROUP BY k, case_id) SELECT k::BIGINT AS k, count(*) AS cases, round(count(*) FILTER (h > 0)::DOUBLE / count(*), 6) AS any_hit, round(sum(h)::DOUBLE / sum(groups), 6) AS group_recall, round(count(*) FILTER (h = groups)::DOUBLE / count(*), 6) AS strict_recall, round(sum(CASE WHEN first <= k THEN 1.0::DOUBLE / first ELSE 0 END) / count(*), 6) AS mrr FROM per GROUP BY k".replace(", per AS", "SELECT * FROM (WITH per AS", 1) + ")")
def recall_at_k(spark, sf_dir) -> DataFrame:
    """A13, A15-A17, A19-A21, A24-A26, A38."""
    return evalmetrics.recall_at(_best(spark, sf_dir))


@query(_BASE + "SELECT CASE WHEN best_rank = 1 THEN '1' WHEN best_rank <= 3 THEN '2-3' WHEN best_rank <= 5 THEN '4-5' WHEN best_rank <= 10 THEN '6-10' WHEN best_rank <= 20 THEN '11-20' WHEN best_rank <= 30 THEN '21-30' WHEN best_rank > 30 THEN '>30' ELSE 'missing' END AS band, count(*) AS groups FROM best GROUP BY 1")
def rank_bands(spark, sf_dir) -> DataFrame:
    """A29."""
    return _best(spark, sf_dir).groupBy(evalmetrics.rank_band(F.col("best_rank")).alias("band")).agg(F.count(F.lit(1)).alias("groups"))


@query(_BASE + ", a AS (SELECT case_id, min(best_rank) AS ra FROM best GROUP BY 1), b AS (SELECT case_id, min(best_rank) AS rb FROM besto GROUP BY 1), j AS (SELECT * FROM a FULL JOIN b USING (case_id)) SELECT k::BIGINT AS k, count(*) FILTER (NOT x AND y) AS wins, count(*) FILTER (x AND NOT y) AS losses, count(*) FILTER (x AND y) AS both_hit, count(*) FILTER (NOT x AND NOT y) AS both_miss, wins - losses AS net, (SELECT round(avg(ra - rb), 6) FROM j) AS mean_delta FROM (SELECT k, coalesce(ra <= k, false) AS x, coalesce(rb <= k, false) AS y FROM j, (SELECT unnest([1, 5, 10]) AS k)) GROUP BY k".replace(", a AS", "SELECT * FROM (WITH a AS", 1) + ")")
def paired_win_loss(spark, sf_dir) -> DataFrame:
    """Overlap against BM25."""
    first = lambda kind: _best(spark, sf_dir, kind).groupBy("case_id").agg(F.min("best_rank").alias("rank"))
    return evalmetrics.paired(first("bm25"), first("overlap"), (1, 5, 10))


@query("WITH x AS (SELECT quality, toxic FROM labels) SELECT quality AS expected, toxic AS actual, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM x), 4) AS share FROM x GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir) -> DataFrame:
    """A33, A34, A36."""
    return evalmetrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(_BASE + ", s AS (SELECT k, case_id, count(*) AS n, count(DISTINCT sha256(text)) AS d FROM rb JOIN documents ON doc_id = id, (SELECT unnest([8, 30]) AS k) WHERE rank <= k GROUP BY k, case_id) SELECT k::BIGINT AS k, count(*) AS queries, round(avg(n), 6) AS mean_slots, round(avg(n - d), 6) AS mean_duplicates, count(*) FILTER (n > d) AS with_duplicates FROM s GROUP BY k".replace(", s AS", "SELECT * FROM (WITH s AS", 1) + ")")
def duplicate_slots(spark, sf_dir) -> DataFrame:
    """Equal texts among the first hits."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"))
    return evalmetrics.duplicate_slots(_ranking(spark, sf_dir).join(d, "id"), (8, 30), "case_id", "sha")


@query(_BASE + "SELECT count(*) AS gold_items, round(avg(r), 6) AS macro_recall, round(avg((r > 0)::INT), 6) AS coverage FROM (SELECT group_id, avg(coalesce(best_rank <= 10, false)::INT) AS r FROM best GROUP BY group_id)")
def macro_recall(spark, sf_dir) -> DataFrame:
    """A30."""
    return evalmetrics.macro_recall(_best(spark, sf_dir), 10, "group_id")


@query(_BASE + ", g AS (SELECT 'all' AS level, 'all' AS key, best_rank FROM best UNION ALL SELECT 'group_id', group_id::VARCHAR, best_rank FROM best UNION ALL SELECT 'parity', (case_id % 2)::VARCHAR, best_rank FROM best) SELECT level, key, count(*) AS groups, count(*) FILTER (best_rank <= 10) AS hits, round(count(*) FILTER (best_rank <= 10)::DOUBLE / count(*), 6) AS recall FROM g GROUP BY level, key".replace(", g AS", "SELECT * FROM (WITH g AS", 1) + ")")
def recall_slices(spark, sf_dir) -> DataFrame:
    """Recall over all and by slices."""
    return evalmetrics.sliced(_best(spark, sf_dir).withColumn("parity", F.col("case_id") % 2), 10, ["group_id", "parity"])


@query("SELECT count(*) AS cases, count(DISTINCT item_id) AS ids, count(*) FILTER (length(text) < 20) AS short, count(*) - count(DISTINCT sha256(text)) AS repeated, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty FROM benchmark")
def dataset_integrity(spark, sf_dir) -> DataFrame:
    """Counts and uniqueness of the evaluation set."""
    b = table(spark, sf_dir, "benchmark")
    return b.agg(F.count(F.lit(1)).alias("cases"), F.count_distinct("item_id").alias("ids"), F.count_if(F.length("text") < 20).alias("short"), (F.count(F.lit(1)) - F.count_distinct(F.sha2("text", 256))).alias("repeated"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"))

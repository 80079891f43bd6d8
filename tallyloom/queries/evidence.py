"""Evidence units over documents as chunks: file is source, one in four documents is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, lexical
from .registry import query, table
from .retrieval import _BM25, _WORDS, _queries


def chunks(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.col("source").alias("file"), F.when(F.floor(i / 20) % 4 == 0, "table").otherwise("section").alias("type"), F.when(F.floor(i / 20) % 4 == 0, F.floor(i / 80) % 9).alias("table_no"), (i % 13).alias("page"),
        "text", F.array((i % 9).cast("long"), ((i + 3) % 9).cast("long")).alias("refs"), F.when(i % 5 != 0, "approved").otherwise("pending").alias("status"),
    )


_CHUNKS = "c AS (SELECT doc_id AS id, source AS file, CASE WHEN doc_id // 20 % 4 = 0 THEN 'table' ELSE 'section' END AS type, CASE WHEN doc_id // 20 % 4 = 0 THEN doc_id // 80 % 9 END AS table_no, doc_id % 13 AS page, text, [doc_id % 9, (doc_id + 3) % 9] AS refs, CASE WHEN doc_id % 5 <> 0 THEN 'approved' ELSE 'pending' END AS status FROM documents)"


@query(f"WITH {_CHUNKS} SELECT id // 80 AS volume, file, table_no, string_agg(id::VARCHAR, ',' ORDER BY page, id) AS members, sha256(string_agg(text, chr(10) || chr(10) ORDER BY page, id)) AS sha FROM c WHERE type = 'table' GROUP BY id // 80, file, table_no")
def group_concat_ordered(spark, sf_dir) -> DataFrame:
    """Continued tables as one, in page order. A volume is eighty chunks, so a table's parts stay few
    however many documents there are."""
    c = chunks(spark, sf_dir).filter("type = 'table'").withColumn("volume", F.floor(F.col("id") / 80))
    g = evidence.grouped_tables(c, ["volume", "file", "table_no"])
    return g.select("volume", "file", "table_no", F.array_join(F.transform("members", lambda i: i.cast("string")), ",").alias("members"), F.sha2("text", 256).alias("sha"))


@query(f"WITH {_WORDS}, {_CHUNKS}, m AS (SELECT avg(len(w)) AS mean FROM docs WHERE len(w) > 0), rk AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round({_BM25}, 6) AS score FROM posts JOIN terms USING (token) JOIN dfs USING (token), n, m GROUP BY query_id, id)), k AS (SELECT query_id, rk.id, rank, file, refs, type FROM rk JOIN c ON c.id = rk.id WHERE rank <= 10), a AS (SELECT query_id, rank, file, unnest(refs) AS table_no, unnest([0, 1]) AS pos FROM k WHERE type = 'section'), e AS (SELECT query_id, t.id, min(rank * 10 + pos) AS best FROM a JOIN c t ON t.type = 'table' AND t.file = a.file AND t.table_no = a.table_no WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = a.query_id AND k.id = t.id AND k.type = 'section') GROUP BY query_id, t.id) SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY best, id) AS place FROM e) WHERE place <= 5")
def reference_expand(spark, sf_dir) -> DataFrame:
    """Tables that a query's section hits refer to, five at most, in the order of hits."""
    c = chunks(spark, sf_dir)
    hits = lexical.bm25(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), 10).select("query_id", "id", "rank").join(c.select("id", "file", "refs", "type"), "id")
    return evidence.referenced_tables(hits.filter("type = 'section'"), c.filter("type = 'table'"))


@query(f"WITH {_CHUNKS} SELECT id, CASE WHEN doc_id IS NULL THEN 'gone' ELSE status END AS reason FROM (SELECT vec_id AS id FROM embeddings UNION ALL SELECT 1000000 + vec_id FROM embeddings WHERE label = 0) i LEFT JOIN (SELECT id AS doc_id, status FROM c) ON id = doc_id WHERE doc_id IS NULL OR status <> 'approved'")
def stale_index_anti(spark, sf_dir) -> DataFrame:
    """Index rows whose chunk is gone or not approved."""
    e = table(spark, sf_dir, "embeddings")
    index = e.select(F.col("vec_id").alias("id")).unionAll(e.filter("label = 0").select((F.col("vec_id") + 1000000).alias("id")))
    c = chunks(spark, sf_dir)
    reason = c.select(F.col("id").alias("c_id"), "status")
    stale = lexical.stale(index, c)
    return stale.join(reason, F.col("id") == F.col("c_id"), "left").select("id", F.coalesce("status", F.lit("gone")).alias("reason"))


@query(f"WITH {_CHUNKS} SELECT c.id FROM c LEFT JOIN (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN sha256('old') ELSE sha256(text) END AS sha FROM embeddings JOIN documents ON doc_id = vec_id) ON vec_id = c.id WHERE c.status = 'approved' AND sha256(c.text) IS DISTINCT FROM sha")
def pending_documents(spark, sf_dir) -> DataFrame:
    """Chunks whose text is not the one indexed."""
    c = chunks(spark, sf_dir).withColumn("sha", F.sha2("text", 256))
    index = c.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id").select("id", F.when(F.col("id") % 3 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("sha")).alias("sha"))
    return lexical.pending(c.filter("status = 'approved'").select("id", "sha"), index).select("id")


@query(f"WITH {_CHUNKS} SELECT count(*) FILTER (status = 'approved') AS approved, count(vec_id) FILTER (status = 'approved') AS embedded, count(*) FILTER (status = 'approved' AND vec_id IS NULL) AS pending FROM c LEFT JOIN embeddings ON vec_id = id")
def index_status(spark, sf_dir) -> DataFrame:
    """T18, T19."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    j = chunks(spark, sf_dir).join(e, F.col("vec_id") == F.col("id"), "left")
    ok = F.col("status") == "approved"
    return j.agg(F.count_if(ok).alias("approved"), F.count_if(ok & F.col("vec_id").isNotNull()).alias("embedded"), F.count_if(ok & F.col("vec_id").isNull()).alias("pending"))


_TAGS = "t AS (SELECT *, list_filter([CASE WHEN length(text) < 200 THEN 'short_text' END, CASE WHEN length(text) > 20000 THEN 'very_long_text' END, CASE WHEN contains(text, '\\') THEN 'latex_residue' END, CASE WHEN type = 'table' AND page = 0 THEN 'table_missing_title' END, CASE WHEN status <> 'approved' THEN 'not_approved' END], lambda x: x IS NOT NULL) AS tags FROM c)"


def _audits(spark, sf_dir) -> DataFrame:
    n = F.length("text")
    rules = {"short_text": n < 200, "very_long_text": n > 20000, "latex_residue": F.contains("text", F.lit("\\")), "table_missing_title": (F.col("type") == "table") & (F.col("page") == 0), "not_approved": F.col("status") != "approved"}
    return chunks(spark, sf_dir).withColumn("tags", evidence.quality_tags(rules))


@query(f"WITH {_CHUNKS}, {_TAGS} SELECT file, count(*) AS total, count(*) FILTER (NOT list_has_any(tags, ['latex_residue', 'not_approved'])) AS indexable, count(*) FILTER (list_has_any(tags, ['latex_residue', 'table_missing_title'])) AS needs_review, sum(len(tags))::BIGINT AS issues FROM t GROUP BY file")
def quality_rollup(spark, sf_dir) -> DataFrame:
    """F07, A10, A11, K07."""
    return evidence.quality_rollup(_audits(spark, sf_dir), ["file"])


@query(f"WITH {_CHUNKS}, {_TAGS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY tag")
def issue_counts(spark, sf_dir) -> DataFrame:
    """A10, A28, A37."""
    return evidence.issue_counts(_audits(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT coalesce(type, 'unknown') AS type, count(*) AS n FROM c WHERE status = 'approved' AND file IN ('src1', 'src2', 'src3') GROUP BY 1")
def scoped_evidence(spark, sf_dir) -> DataFrame:
    """Approved chunks of a list of files by type."""
    c = chunks(spark, sf_dir).filter((F.col("status") == "approved") & F.col("file").isin("src1", "src2", "src3"))
    return c.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))

"""Vector, lexical and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import segment
from ..operators import fusion, lexical, vectors
from ..plans import hybrid
from .registry import query, table

_WORDS = """docs AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pM\\pN]+'), lambda x: x <> '') AS w FROM documents),
posts AS (SELECT id, len(w) AS length, token, count(*) AS tf FROM (SELECT id, w, unnest(w) AS token FROM docs) GROUP BY id, len(w), w, token),
dfs AS (SELECT token, count(*) AS df FROM posts GROUP BY token),
terms AS (SELECT item_id AS query_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pM\\pN]+'), lambda x: x <> '')) AS token FROM benchmark) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents)"""
_BM25 = "sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))"
_KNN = """SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0"""


def ranked_sql(score: str, k: int, order: str = "score DESC, id") -> str:
    return f"SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM ({score})) WHERE rank <= {k}"


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(ranked_sql(_KNN, 10))
def knn_topk(spark, sf_dir) -> DataFrame:
    """Ten nearest rows of each query vector."""
    rows = _vectors(spark, sf_dir)
    return vectors.knn(rows.filter("id % 20 = 0"), rows, 10, 64)


@query("SELECT count(*) AS total_candidates, count(*) FILTER (len(embedding) = 64) AS scored FROM embeddings")
def vector_decode_counts(spark, sf_dir) -> DataFrame:
    """Vectors of a wrong length count as candidates and are not scored."""
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("total_candidates"), F.count_if(F.size("embedding") == 64).alias("scored"))


@query(f"WITH {_WORDS}, m AS (SELECT avg(len(w)) AS mean FROM docs WHERE len(w) > 0), s AS (SELECT query_id, id, round({_BM25}, 6) AS score FROM posts JOIN terms USING (token) JOIN dfs USING (token), n, m GROUP BY query_id, id) " + ranked_sql("SELECT * FROM s", 10))
def bm25_topk(spark, sf_dir) -> DataFrame:
    """Explicit BM25 over whole texts."""
    return lexical.bm25(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), 10)


_FIELDED = f"""WITH {_WORDS}, f AS (SELECT doc_id AS id, unnest([{{'w': 1.0::DOUBLE, 't': text}}, {{'w': 4.0::DOUBLE, 't': source}}, {{'w': 2.0::DOUBLE, 't': lang}}]) AS f FROM documents),
fw AS (SELECT id, f.w AS weight, list_filter(regexp_split_to_array(lower(coalesce(f.t, '')), '[^\\pL\\pM\\pN]+'), lambda x: x <> '') AS w FROM f),
lens AS (SELECT id, sum(len(w)) AS length FROM fw GROUP BY id), fm AS (SELECT avg(length) AS mean FROM lens WHERE length > 0),
fp AS (SELECT id, token, sum(weight) AS tf FROM (SELECT id, weight, unnest(w) AS token FROM fw) GROUP BY id, token), fd AS (SELECT token, count(*) AS df FROM fp GROUP BY token),
asked AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, token FROM terms UNION ALL SELECT item_id, 'en' FROM benchmark)),
s AS (SELECT query_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM fp JOIN asked USING (token) JOIN fd USING (token) JOIN lens USING (id), n, fm GROUP BY query_id, id) """


#: Han text that is derived from the tables: letters become characters (fixed values of these queries).
_LATIN, _CHARS = "etaoinshrdlu", "电压器变流温升试验标准线"
_HAN_WORDS = f"""flatten(list_transform(list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{_LATIN}', '{_CHARS}'), '[^\\pL\\pM\\pN]+'), lambda x: x <> ''),
lambda w: flatten(list_transform(regexp_extract_all(w, '\\p{{Han}}+|\\P{{Han}}+'), lambda p: CASE WHEN regexp_matches(p, '^\\p{{Han}}') AND length(p) > 1 THEN list_transform(range(1, length(p)), lambda i: substr(p, i, 2)) ELSE [p] END))))"""


def _in_han(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.translate(F.lower("text"), _LATIN, _CHARS))


@query(f"SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_HAN_WORDS} AS w FROM documents)")
def han_bigrams(spark, sf_dir) -> DataFrame:
    """Words of texts in Han characters without a dictionary, as bigrams."""
    w = lexical.words(F.coalesce("text", F.lit("")))
    return _in_han(table(spark, sf_dir, "documents")).select("doc_id", F.size(w).cast("long").alias("words"), F.md5(F.array_join(w, " ").cast("binary")).alias("digest"))


@query(f"""WITH docs AS (SELECT doc_id AS id, {_HAN_WORDS} AS w FROM documents), posts AS (SELECT id, len(w) AS length, token, count(*) AS tf FROM (SELECT id, w, unnest(w) AS token FROM docs) GROUP BY id, len(w), w, token),
dfs AS (SELECT token, count(*) AS df FROM posts GROUP BY token), terms AS (SELECT DISTINCT item_id AS query_id, unnest({_HAN_WORDS}) AS token FROM benchmark), n AS (SELECT count(*) AS n FROM documents), m AS (SELECT avg(len(w)) AS mean FROM docs WHERE len(w) > 0),
s AS (SELECT query_id, id, round({_BM25}, 6) AS score FROM posts JOIN terms USING (token) JOIN dfs USING (token), n, m GROUP BY query_id, id) """ + ranked_sql("SELECT * FROM s", 10))
def han_bm25_topk(spark, sf_dir) -> DataFrame:
    """BM25 over texts and queries in Han characters."""
    return lexical.bm25(_in_han(table(spark, sf_dir, "documents")), _in_han(_queries(spark, sf_dir)), 10)


def dictionary(spark, sf_dir) -> list[tuple[str, int]]:
    """The words of benchmark items in Han characters with their counts, of which a segmenter takes a million."""
    words = _in_han(table(spark, sf_dir, "benchmark")).select(F.explode(segment.pieces(F.col("text"))).alias("word")).filter(r"word RLIKE '^\\p{IsHan}'")
    return [(r["word"], r["n"]) for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).limit(segment.MAX_WORDS + 1).collect()]


@query()
def segmented_words(spark, sf_dir) -> DataFrame:
    """Texts in Han characters segmented by a dictionary, the words of the benchmark items."""
    w = segment.segmenter(dictionary(spark, sf_dir))(F.coalesce("text", F.lit("")))
    return _in_han(table(spark, sf_dir, "documents")).select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(_FIELDED + ranked_sql("SELECT * FROM s", 10))
def field_bm25_topk(spark, sf_dir) -> DataFrame:
    """BM25 over text, source and language with weights 1, 4 and 2; queries are in English and say so."""
    asked = _queries(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", F.lit("en")))
    return lexical.field_bm25(table(spark, sf_dir, "documents"), {"text": 1, "source": 4, "lang": 2}, asked, 10)


@query(f"WITH {_WORDS}, s AS (SELECT query_id, id, round(sum(least(tf, 3) * (ln((n + 1) / (df + 1)) + 1) * least(qtf, 2)), 6) AS score FROM posts JOIN terms USING (token) JOIN dfs USING (token), n GROUP BY query_id, id) " + ranked_sql("SELECT * FROM s", 10))
def tf_idf_topk(spark, sf_dir) -> DataFrame:
    """Capped term counts times smoothed idf."""
    return lexical.tf_idf(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), 10)


_OVERLAP = f"""WITH {_WORDS}, f AS (SELECT id, token, 1.0 AS w FROM posts UNION ALL SELECT doc_id, source, 12.0 FROM documents WHERE source IS NOT NULL),
s AS (SELECT query_id, id, round(sum(f.w), 6) AS score FROM f JOIN terms USING (token) GROUP BY query_id, id) """


@query(_OVERLAP + ranked_sql("SELECT * FROM s", 10))
def overlap_topk(spark, sf_dir) -> DataFrame:
    """Weighted overlap over the text and the source, which is one token."""
    return lexical.weighted_overlap(table(spark, sf_dir, "documents"), {"source": 12, "text": 1}, _queries(spark, sf_dir), 10)


_ROUTES = f"""WITH {_WORDS}, m AS (SELECT avg(len(w)) AS mean FROM docs WHERE len(w) > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round({_BM25}, 6) AS score FROM posts JOIN terms USING (token) JOIN dfs USING (token), n, m GROUP BY query_id, id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(count(*)::DOUBLE, 6) AS score FROM posts JOIN terms USING (token) GROUP BY query_id, id)),
r AS (SELECT 'bm25' AS route, * FROM b WHERE rank <= 30 UNION ALL SELECT 'overlap', * FROM o WHERE rank <= 30),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(score) AS best, count(DISTINCT route) AS routes FROM r GROUP BY query_id, id),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best DESC, id {{tie}}) AS rank FROM fused) """


def _routes(spark, sf_dir, k: int = 30) -> DataFrame:
    docs, asked = table(spark, sf_dir, "documents"), _queries(spark, sf_dir)
    return lexical.ranked(docs, asked, k, ["bm25", "overlap"], {"text": 1})


@query(_ROUTES.format(tie="DESC") + "SELECT query_id, id, rrf, best, routes, rank FROM f")
def rrf_fusion(spark, sf_dir) -> DataFrame:
    """Reciprocal ranks of two routes, ties to larger ids."""
    return fusion.reciprocal_ranks(_routes(spark, sf_dir), ["query_id"])


@query(_ROUTES.format(tie="ASC") + "SELECT query_id, id, rrf, best, routes, rank FROM f WHERE rank <= 20")
def shadow_fusion(spark, sf_dir) -> DataFrame:
    """As rrf_fusion with ties to smaller ids, first 20."""
    return fusion.reciprocal_ranks(_routes(spark, sf_dir), ["query_id"], tie="asc").filter("rank <= 20")


@query(_ROUTES.format(tie="DESC") + "SELECT query_id, id, rank, type FROM (SELECT f.*, lang AS type, row_number() OVER (PARTITION BY query_id, lang ORDER BY rank) AS place FROM f JOIN documents ON id = doc_id) WHERE place <= CASE type WHEN 'en' THEN 8 WHEN 'de' THEN 6 ELSE 2 END")
def typed_quota(spark, sf_dir) -> DataFrame:
    """Fused rows by type quota."""
    fused = fusion.reciprocal_ranks(_routes(spark, sf_dir), ["query_id"])
    typed = fused.join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type")), F.col("id") == F.col("doc_id"))
    return fusion.typed_quota(typed, ["query_id"], {"en": 8, "de": 6}, 2).select("query_id", "id", "rank", "type")


@query(_ROUTES.format(tie="DESC") + ", a AS (SELECT query_id, id, round(sum(x), 9) AS rrf, list_sort(list(DISTINCT route)) AS sources FROM (SELECT *, 1.0::DOUBLE / (60 + rank) AS x FROM r) GROUP BY query_id, id) SELECT query_id, id, rrf, array_to_string(sources, ',') AS sources FROM a".replace(", a AS", "SELECT * FROM (WITH a AS", 1) + ")")
def merged_lists(spark, sf_dir) -> DataFrame:
    """Two lists merged, sources united."""
    routes = _routes(spark, sf_dir).withColumn("rrf", 1.0 / (60 + F.col("rank"))).withColumn("sources", F.array("route"))
    return fusion.merged_rows(routes, ["query_id"]).withColumn("sources", F.array_join("sources", ","))


@query(_ROUTES.format(tie="DESC") + "SELECT query_id, id, round(rrf + coalesce(extra, 0), 9) AS rrf FROM (SELECT coalesce(p.query_id, s.query_id) AS query_id, coalesce(p.id, s.id) AS id, coalesce(p.rrf, 0) AS rrf, CASE WHEN p.id IS NULL THEN s.rrf END AS extra FROM (SELECT * FROM f WHERE rank <= 10) p FULL JOIN (SELECT query_id, id, round(1.0::DOUBLE / (60 + rank), 9) AS rrf FROM o WHERE rank <= 3) s ON p.query_id = s.query_id AND p.id = s.id)")
def reserved_routes(spark, sf_dir) -> DataFrame:
    """Three of a special route are held beside the pool."""
    return fusion.with_reserves_of(_routes(spark, sf_dir), ["query_id"], "overlap", 10, 3)


@query(_ROUTES.format(tie="DESC") + "SELECT query_id, sha, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id DESC) AS rank FROM (SELECT query_id, sha, min(id) AS id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM (SELECT query_id, sha256(text) AS sha, route, min(r.id) AS id, min(r.rank) AS rank FROM r JOIN documents ON doc_id = r.id GROUP BY 1, 2, 3) GROUP BY query_id, sha)")
def pool_merge(spark, sf_dir) -> DataFrame:
    """Pools merged by content hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pools = _routes(spark, sf_dir).join(docs, F.col("id") == F.col("doc_id")).withColumnsRenamed({"route": "pool"}).withColumn("source", F.lit("first"))
    return fusion.merge_pools(pools, ["query_id"])


@query(_ROUTES.format(tie="DESC") + "SELECT query_id, len(list_intersect(a, b))::BIGINT AS overlap, round(len(list_intersect(a, b)) / greatest(1, least(len(a), len(b))), 6) AS share FROM (SELECT query_id, list(id) FILTER (route = 'bm25') AS a, list(id) FILTER (route = 'overlap') AS b FROM r GROUP BY query_id)")
def backend_overlap(spark, sf_dir) -> DataFrame:
    """Overlap of two result lists of each query."""
    lists = _routes(spark, sf_dir).groupBy("query_id").agg(F.collect_list(F.when(F.col("route") == "bm25", F.col("id"))).alias("a"), F.collect_list(F.when(F.col("route") == "overlap", F.col("id"))).alias("b"))
    n = F.size(F.array_intersect("a", "b"))
    return lists.select("query_id", n.cast("long").alias("overlap"), F.round(n / F.greatest(F.lit(1), F.least(F.size("a"), F.size("b"))), 6).alias("share"))


_HYBRID = f"""WITH {_WORDS}, m AS (SELECT avg(len(w)) AS mean FROM docs WHERE len(w) > 0), items AS (SELECT count(*) AS items FROM benchmark),
asked AS (SELECT vec_id AS query_id, embedding, (vec_id // 20) % items AS item FROM embeddings, items WHERE vec_id % 20 = 0),
d AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_KNN})),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round({_BM25}, 6) AS score FROM posts JOIN terms USING (token) JOIN dfs USING (token), n, m GROUP BY query_id, id)),
r AS (SELECT query_id, 'dense' AS route, id, score, rank FROM d WHERE rank <= 30 UNION ALL SELECT a.query_id, 'lexical', b.id, b.score, b.rank FROM asked a JOIN b ON a.item = b.query_id WHERE rank <= 30),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(score) AS best, max(score) FILTER (route = 'dense') AS dense FROM r GROUP BY query_id, id),
f AS (SELECT f.*, lang AS type, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best DESC, id DESC) AS pool_rank FROM fused f JOIN documents ON doc_id = id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY pool_rank) AS place FROM f)
SELECT query_id, id, type, rrf, coalesce(dense, best) AS score, row_number() OVER (PARTITION BY query_id ORDER BY pool_rank) AS rank FROM t WHERE place <= CASE type WHEN 'en' THEN 8 ELSE 6 END"""


@query(_HYBRID)
def hybrid_rank(spark, sf_dir) -> DataFrame:
    """Dense and lexical routes, fusion, identity reranker, type quotas. The query of vector v
    has the text of benchmark item (v / 20) mod their number."""
    items = table(spark, sf_dir, "benchmark")
    rows = _vectors(spark, sf_dir)
    asked = _vectors(spark, sf_dir).filter("id % 20 = 0").withColumn("item_id", F.floor(F.col("id") / 20) % items.count())
    asked = asked.join(items, "item_id").select(F.col("id").alias("query_id"), "v", "text")
    docs = table(spark, sf_dir, "documents").withColumnsRenamed({"doc_id": "id", "lang": "type"})
    return hybrid.search(asked, rows, docs, size=64, route_k=30, quotas={"en": 8}, default_quota=6)

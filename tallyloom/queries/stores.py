"""Sources and sinks: what is derived from the tables is written, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import chunking, readonly_sql
from ..sources import archives, readers, reports
from ..sources.scratch import scratch_path
from .registry import query, table

_TAGS = "<(p|li|h1)[^>]*>([^<]+)"


@query(rf"""WITH p AS (SELECT page_id // 50 AS archive, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS page, regexp_extract_all(html, '{_TAGS}', 2) AS blocks FROM pages), w AS (SELECT *, archive % 3 = 1 AND page >= 25 AS gone FROM p)
SELECT 'a' || archive AS archive, page::INT AS page, len(blocks)::INT AS blocks, md5(array_to_string(blocks, '|')) AS digest, false AS damaged FROM w WHERE NOT gone UNION ALL SELECT DISTINCT 'a' || archive, NULL, NULL, NULL, true FROM w WHERE gone""")
def layout_archives(spark, sf_dir) -> DataFrame:
    """Pages of blocks from layout archives, of which some break off; fifty pages make an archive."""
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 50).alias("archive"), "page_id", "html")
    page = F.row_number().over(Window.partitionBy("archive").orderBy("page_id")) - 1
    block = lambda x, i: F.struct(F.lit("text").alias("type"), x.alias("content"), F.array(F.lit(0.0), i / 10.0, F.lit(1.0), (i + 1) / 10.0).alias("bbox"))
    p = p.withColumn("page", page).withColumn("blocks", F.transform(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(2)), block))
    gone = (F.col("archive") % 3 == 1) & (F.col("page") >= 25)
    path = scratch_path(spark, "layouts")
    archives.write_layouts(p.select(F.concat(F.lit("a"), "archive").alias("archive"), "page", F.when(~gone, F.col("blocks")).alias("blocks")), path).count()
    r = archives.layout_pages(spark, path)
    digest = F.md5(F.array_join(F.transform("blocks", lambda b: b["content"]), "|").cast("binary"))
    return r.select(F.regexp_extract("archive", r"([^/]+)\.zip$", 1).alias("archive"), "page", F.when(F.col("blocks").isNotNull(), F.size("blocks")).alias("blocks"), digest.alias("digest"), F.col("error").isNotNull().alias("damaged"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'mismatch' ELSE 'insufficient_context' END"


def _runs(spark, sf_dir) -> DataFrame:
    """A report for each customer, whose orders are its cases."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.lit(1).alias("version"), F.col("c_mktsegment").alias("scope"), F.concat(F.lit("/in/"), "c_name", F.lit(".md")).alias("report"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("report_file_name"), F.concat(F.lit("2024-01-"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")).alias("started_at"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").cast("string").alias("case_id"), F.expr(_STATUS).alias("status"))
    return reports.final_reports(o, c).withColumn("run_id", F.col("run_id").cast("string"))


@query(f"""WITH o AS (SELECT o_custkey, {_STATUS} AS status, count(*) AS n FROM orders GROUP BY ALL), j AS (SELECT o_custkey, sum(n)::INT AS n, string_agg(status || ':' || n, ',' ORDER BY status) AS judgments FROM o GROUP BY o_custkey)
SELECT CASE WHEN ok THEN c_custkey::VARCHAR END AS run_id, CASE WHEN ok THEN c_mktsegment END AS scope, CASE WHEN ok THEN c_name END AS report_file_name, CASE WHEN ok THEN '2024-01-' || lpad((c_nationkey + 1)::VARCHAR, 2, '0') END AS started_at, CASE WHEN ok THEN coalesce(n, 0) END AS case_count, CASE WHEN ok THEN coalesce(judgments, '') END AS judgments, NOT ok AS broken
FROM (SELECT *, c_custkey % 10 <> 3 AS ok FROM customer) LEFT JOIN j ON o_custkey = c_custkey""")
def report_headers(spark, sf_dir) -> DataFrame:
    """Nested reports written by scope, one in ten cut off, and their headers."""
    runs, path = _runs(spark, sf_dir), scratch_path(spark, "reports")
    broken = F.col("run_id").cast("long") % 10 == 3
    reports.write_reports(runs.filter(~broken), path)
    whole = F.to_json(F.struct(*runs.columns))
    runs.filter(broken).select(F.substring(whole, F.lit(1), (F.length(whole) / 2).cast("int")).alias("value")).write.mode("append").text(f"{path}/by_scope=cut")
    h = reports.report_headers(spark, path)
    judgments = F.array_join(F.transform(F.array_sort(F.map_entries("judgments")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return h.select("run_id", "scope", "report_file_name", "started_at", "case_count", judgments.alias("judgments"), F.col("parse_error").isNotNull().alias("broken"))


@query("""WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN '2024-02-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') END AS started_at, '2024-02-' || lpad((28 - n_nationkey)::VARCHAR, 2, '0') AS finished_at FROM nation WHERE n_nationkey % 5 <> 3 AND n_nationkey <> 24)
SELECT k::VARCHAR AS report_file_name, n.started_at, n.finished_at, coalesce(r_name, 'none') AS workspace, cases, row_number() OVER (ORDER BY coalesce(n.started_at, n.finished_at) DESC, k::VARCHAR) AS place FROM n LEFT JOIN region ON r_regionkey = k JOIN (SELECT c_nationkey, count(DISTINCT c_mktsegment)::INT AS cases FROM customer GROUP BY 1) ON c_nationkey = k""")
def report_listing(spark, sf_dir) -> DataFrame:
    """Reports that can be read and have cases, newest first, with what the first lookup knows."""
    n, path = table(spark, sf_dir, "nation"), scratch_path(spark, "listing")
    k, day = F.col("n_nationkey"), lambda c: F.concat(F.lit("2024-02-"), F.lpad(c.cast("string"), 2, "0"))
    cases = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run_id"), F.col("c_mktsegment").alias("case_id"), F.lit("x").alias("status")).distinct()
    lists = cases.groupBy("run_id").agg(F.collect_list(F.struct("case_id", "status")).alias("cases"))
    runs = n.join(lists, k == F.col("run_id")).select(k.cast("string").alias("report_file_name"), F.when(k % 2 == 0, day(k + 1)).alias("started_at"), day(28 - k).alias("finished_at"), k.cast("string").alias("assistant_id"), F.when(k % 5 != 3, F.col("cases")).alias("cases"))
    reports.write_reports(runs.filter("report_file_name <> '24'"), path, "report_file_name")
    runs.filter("report_file_name = '24'").select(F.lit('{"cases": [{"case_id"').alias("value")).write.mode("append").text(f"{path}/by_report_file_name=24")
    r = readers.reports(spark, path)
    known = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("workspace"))
    found = readers.first_found("id", r, [(known, "assistant_id"), (known, "knowledge_base_id")], "workspace")
    place = F.row_number().over(Window.orderBy(F.coalesce("started_at", "finished_at").desc(), "report_file_name"))  # a report a nation
    return found.select("report_file_name", "started_at", "finished_at", F.coalesce("workspace", F.lit("none")).alias("workspace"), F.size("cases").alias("cases"), place.cast("long").alias("place"))


@query("SELECT l_orderkey::VARCHAR AS case_id, l_linenumber::VARCHAR AS group_id, route, min(rank)::INT AS rank FROM (SELECT l_orderkey, l_linenumber, unnest(['dense', 'lexical']) AS route, unnest([l_suppkey % 50 + 1, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 40 + 1 END]) AS rank FROM lineitem) WHERE rank IS NOT NULL GROUP BY ALL")
def diagnostic_ranks(spark, sf_dir) -> DataFrame:
    """Diagnostics written as CSV with a JSON map of ranks, and the least rank of each route read back."""
    ranks = F.to_json(F.struct((F.col("l_suppkey") % 50 + 1).alias("dense"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 40 + 1).alias("lexical")))
    path = scratch_path(spark, "diagnostics")
    readers.write_diagnostics(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("group_id"), ranks.alias("source_ranks")), path)
    return readers.diagnostics(spark, path)


@query("SELECT 'bar' AS type, o_orderpriority AS label, n::DOUBLE AS value, sum(n) OVER ()::DOUBLE AS denominator FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT 'metric', NULL, count(*)::DOUBLE, NULL FROM orders")
def chart_points(spark, sf_dir) -> DataFrame:
    """Q05: bars of orders by priority, and a metric."""
    o = table(spark, sf_dir, "orders")
    bars = readonly_sql.chart_points(o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")))
    return bars.unionByName(readonly_sql.chart_points(o.agg(F.count(F.lit(1)).alias("n"))))


@query()
def chunk_pipeline(spark, sf_dir) -> DataFrame:
    """Sections, tables and images of documents; lines are blocks from the top of a page down, twelve a page."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    k = F.col("i") % 6
    kind = F.when(k == 0, "title").when(k == 1, "table_caption").when(k == 2, "table").when(k == 3, "image").when(k == 4, "image_caption").otherwise("text")
    said = F.when(k == 0, F.concat(F.lit("1."), (F.col("i") % 4).cast("string"), F.lit(" "), F.col("line"))).when(k == 1, F.concat(F.lit("表"), F.col("i").cast("string"), F.lit(" "), F.col("line"))).when(k == 4, F.concat(F.lit("图 "), F.col("i").cast("string"))).otherwise(F.col("line"))
    y = F.col("i") % 12 / 12.0
    block = F.struct(kind.alias("type"), said.alias("content"), F.array(F.lit(0.1), y, F.when(k == 1, 0.4).otherwise(0.9), y + 0.07).alias("bbox"))
    pages = d.groupBy("file", F.floor(F.col("i") / 12).cast("int").alias("page")).agg(F.sort_array(F.collect_list(F.struct("i", block.alias("b")))).alias("bs"))  # twelve blocks
    found = chunking.chunks(pages.select("file", "page", F.transform("bs", lambda x: x["b"]).alias("blocks")), {"sections": {"max_chars": 2000}})
    return found.select("file", "kind", "page", "place", "part", "title", "sha")

"""Configurations, schedules, cards and texts for a reranker. Inputs are made of the tables' values by SQL that
both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks, documents, text
from ..operators import fusion, review
from .registry import query, table
from .retrieval import _ROUTES, _routes
from .texts import PLAIN


@query(f"SELECT doc_id, sha256(left(CASE WHEN h <> '' AND b <> '' THEN h || chr(10) || b ELSE h || b END, 2400)) AS sha FROM (SELECT doc_id, concat_ws(' | ', nullif(trim(CASE WHEN doc_id % 3 > 0 THEN source END), ''), nullif(trim(lang), ''), CASE WHEN doc_id % 4 = 0 THEN 'a、b' END) AS h, {PLAIN.format('text')} AS b FROM documents)")
def rerank_documents(spark, sf_dir) -> DataFrame:
    """Labels and plain text as a reranker reads them, 2,400 characters at most."""
    columns = F.when(F.col("doc_id") % 4 == 0, F.array_join(F.array(F.lit("a"), F.lit("b")), "、"))
    t = text.rerank_text(F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.col("lang"), columns, body=F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("sha"))


@query("SELECT event_id, CASE WHEN p IS NULL THEN 'first' WHEN p = event_type THEN 'none' ELSE p || '>' || event_type END AS change FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)")
def status_transitions(spark, sf_dir) -> DataFrame:
    """A user's events as changes of state; any state may follow any other."""
    e = table(spark, sf_dir, "events")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    change = F.when(before.isNull(), "first").when(before == F.col("event_type"), "none").otherwise(F.concat_ws(">", before, "event_type"))
    return e.select("event_id", change.alias("change"))


_RAW = "CASE event_id % 5 WHEN 0 THEN CAST(value / 100 AS STRING) WHEN 1 THEN '-0.5' WHEN 2 THEN 'high' WHEN 3 THEN '' ELSE CAST(event_id % 200 AS STRING) END"


@query(f"SELECT event_id, CASE WHEN v BETWEEN 0 AND 1 THEN round(v, 4) ELSE 0.2::DOUBLE END AS threshold, CASE WHEN v IS NULL THEN 2 ELSE greatest(1, least(3, trunc(v)))::INT END AS rounds, CASE WHEN v IS NULL THEN 30 ELSE greatest(1, least(120, trunc(v)))::INT END AS timeout FROM (SELECT event_id, TRY_CAST({_RAW} AS DOUBLE) AS v FROM events)")
def normal_configs(spark, sf_dir) -> DataFrame:
    """Settings read as numbers and kept within their ranges, or their defaults."""
    v = F.expr(_RAW).try_cast("double")
    whole = lambda low, high, default: F.when(v.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), v)).cast("int"))
    threshold = F.when(v.between(0, 1), F.round(v, 4)).otherwise(0.2)
    return table(spark, sf_dir, "events").select("event_id", threshold.alias("threshold"), whole(1, 3, 2).alias("rounds"), whole(1, 120, 30).alias("timeout"))


@query(_ROUTES.format(tie="DESC") + "SELECT query_id, id, min_by(route, rank * 2 + CASE route WHEN 'bm25' THEN 0 ELSE 100000 END) AS route, row_number() OVER (PARTITION BY query_id ORDER BY min(rank * 2 + CASE route WHEN 'bm25' THEN 0 ELSE 100000 END)) AS place FROM r GROUP BY query_id, id")
def pool_fallback(spark, sf_dir) -> DataFrame:
    """Pools one after another where they can't be fused; of a candidate the first counts."""
    return fusion.concatenated(_routes(spark, sf_dir), ["query_id"], {"bm25": 0, "overlap": 1})


_PRESERVED = ", typed AS (SELECT r.*, lang AS type FROM r JOIN documents ON doc_id = r.id), placed AS (SELECT *, (row_number() OVER (PARTITION BY query_id, type, route ORDER BY rank, id) <= 2)::INT AS held FROM typed), kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY held DESC, score DESC, id) AS place FROM placed) SELECT query_id, id, type, route FROM kept WHERE place <= 5"


@query(_ROUTES.format(tie="DESC").rstrip() + _PRESERVED)
def route_preservation(spark, sf_dir) -> DataFrame:
    """Five rows of each type, the first two of each route among them."""
    typed = _routes(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type")), F.col("id") == F.col("doc_id")).drop("doc_id")
    return fusion.route_preserving_top(typed, ["query_id"], 5, 2).select("query_id", "id", "type", "route")


@query(r"SELECT p_partkey, '(' || p_size || ')/(sqrt(b)) ≤ kV × ' || p_brand || ' x' AS plain FROM part")
def latex_text(spark, sf_dir) -> DataFrame:
    """LaTeX as plain text."""
    t = F.concat(F.lit(r"\frac{"), F.col("p_size").cast("string"), F.lit(r"}{\sqrt{ b }} \leq \mathrm{kV} \times \text{ "), F.col("p_brand"), F.lit(r" } \(x\) \alpha"))
    return table(spark, sf_dir, "part").select("p_partkey", text.latex(t).alias("plain"))


_WHEN = "CASE o_orderkey % 5 WHEN 0 THEN left(CAST(o_orderdate AS STRING), 10) || 'T08:30:15Z' WHEN 1 THEN left(CAST(o_orderdate AS STRING), 10) || 'T08:30:15.750+08:00' WHEN 2 THEN left(CAST(o_orderdate AS STRING), 10) || ' 23:59:59.9' WHEN 3 THEN '  ' ELSE 'soon' END"


@query(f"SELECT o_orderkey, (date_trunc('second', TRY_CAST(nullif(trim({_WHEN}), '') AS TIMESTAMPTZ)) AT TIME ZONE 'UTC')::VARCHAR AS due FROM orders")
def schedule_times(spark, sf_dir) -> DataFrame:
    """Times in several ISO forms as UTC, to the second; null where there is none."""
    due = F.date_trunc("second", F.trim(F.expr(_WHEN)).try_cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(due, "yyyy-MM-dd HH:mm:ss").alias("due"))


@query(r"SELECT o_orderkey, array_to_string(list_transform(list_distinct_ordered, lambda x: x), ',') AS tokens FROM (SELECT o_orderkey, list_transform(regexp_extract_all(t, '\d+(?:\.\d+)?'), lambda n: CASE WHEN contains(n, '.') THEN rtrim(rtrim(n, '0'), '.') ELSE n END) AS xs, list_filter(xs, lambda x, i: list_position(xs, x) = i) AS list_distinct_ordered FROM (SELECT o_orderkey, o_orderpriority || ' 1.50 kV, ' || o_custkey::VARCHAR || '.0 and 1.5 or ' || (o_orderkey % 7)::VARCHAR || '.070' AS t FROM orders))")
def decimal_tokens(spark, sf_dir) -> DataFrame:
    """Numbers of a text without trailing zeros, each once."""
    t = F.concat(F.col("o_orderpriority"), F.lit(" 1.50 kV, "), F.col("o_custkey").cast("string"), F.lit(".0 and 1.5 or "), (F.col("o_orderkey") % 7).cast("string"), F.lit(".070"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(checks.decimal_tokens(t), ",").alias("tokens"))


@query("SELECT o_orderkey, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (l_linenumber % 2 = o_orderkey % 2), '') AS kept FROM (SELECT DISTINCT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_orderkey")
def keyed_projection(spark, sf_dir) -> DataFrame:
    """Of an order's array of lines those whose key is selected."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(F.col("l_linenumber").alias("key"), F.lit("x").alias("binding")))).alias("bindings"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: (2 * i + F.col("o_orderkey") % 2).cast("int"))
    kept = review.selected("bindings", keys)
    return o.select("o_orderkey", F.array_join(F.transform(kept, lambda b: b["key"].cast("string")), ",").alias("kept"))


_CARD = {"key": "CASE WHEN l_linenumber = 5 THEN -1 ELSE l_orderkey END", "role": "CASE WHEN l_partkey % 5 = 0 THEN 'method_rule' ELSE 'nominal_rule' END", "quote": "CASE l_suppkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'no such words' WHEN 2 THEN '' ELSE left(o_orderpriority, 3) END", "value": "CASE WHEN l_partkey % 7 = 0 THEN '9 kV' ELSE left(o_orderpriority, 1) END"}
_CARDS = f"""WITH c AS (SELECT o_orderkey AS k, l_linenumber AS i, {_CARD['key']} AS key, {_CARD['role']} AS role, {_CARD['quote']} AS quote, {_CARD['value']} AS value, o_orderpriority AS source FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
d AS (SELECT *, CASE WHEN key = -1 THEN 'unknown_key' WHEN role <> 'nominal_rule' THEN 'role' WHEN quote = '' THEN 'quote_length' WHEN NOT contains(source, quote) THEN 'not_in_source' WHEN len(list_filter(regexp_extract_all(value, '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(quote, '[0-9]+'), x))) > 0 THEN 'number' END AS issue FROM c),
e AS (SELECT *, CASE WHEN issue IS NULL AND row_number() OVER (PARTITION BY k, key, quote, issue ORDER BY i, value) > 1 THEN 'repeated' ELSE issue END AS final FROM d)
SELECT coalesce(final, 'accepted') AS issue, count(*) AS n FROM e GROUP BY 1"""


@query(_CARDS)
def evidence_cards(spark, sf_dir) -> DataFrame:
    """Cards that quote an order's priority, and why some are refused."""
    c = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = c.select(F.col("o_orderkey").alias("case_id"), F.col("l_linenumber").alias("position"), *[F.expr(e).alias(n) for n, e in _CARD.items()])
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("source"), F.array(F.lit("nominal_rule")).alias("roles"))
    judged = review.checked_cards(c, sources)
    return judged.groupBy(F.coalesce("issue", F.lit("accepted")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


_STATE = "CASE WHEN l_linenumber = 1 THEN 'confirmed' WHEN l_partkey % 3 = 0 THEN 'open' ELSE 'confirmed' END"
_APPLIES = f"""WITH c AS (SELECT o_orderkey, o_orderstatus AS s, l_linenumber AS i, {_STATE} AS state, CASE WHEN l_suppkey % 4 = 0 THEN 'standard_condition' WHEN l_suppkey % 4 = 1 THEN 'odd' ELSE 'sample_fact' END AS role, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE 'x' END AS cond, CASE WHEN l_partkey % 2 = 0 THEN left(o_orderpriority, 4) ELSE 'zzz' END AS quote, o_orderpriority AS source FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN s = 'P' THEN '' WHEN count(i) = 0 THEN 'missing_applicability_checks' ELSE array_to_string(list_sort(list_distinct(list_filter([CASE WHEN bool_or(role = 'odd') THEN 'invalid_applicability_evidence_role' END, CASE WHEN bool_or(cond = ' ') THEN 'missing_condition_source' END, CASE WHEN bool_or(state <> 'confirmed') THEN 'unresolved_applicability_condition' END, CASE WHEN bool_or(role = 'standard_condition' OR quote = 'zzz') THEN 'unverified_applicability_quote' END, CASE WHEN NOT bool_or(role = 'sample_fact') THEN 'missing_sample_parameter_evidence' END], lambda x: x IS NOT NULL))), ',') END AS issues FROM c GROUP BY o_orderkey, s"""


@query(_APPLIES)
def applicability_contract(spark, sf_dir) -> DataFrame:
    """Issues of the conditions that a definite verdict rests on."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    check = F.struct(
        F.when(F.col("l_suppkey") % 4 == 0, "standard_condition").when(F.col("l_suppkey") % 4 == 1, "odd").otherwise("sample_fact").alias("role"), F.when(F.col("l_partkey") % 5 == 0, " ").otherwise("x").alias("condition"),
        F.lit("report").alias("source"), F.expr(_STATE).alias("state"), F.when(F.col("l_partkey") % 2 == 0, F.substring("o_orderpriority", 1, 4)).otherwise("zzz").alias("quote"),
    )
    o = table(spark, sf_dir, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    g = o.groupBy("o_orderkey", "o_orderstatus", "o_orderpriority").agg(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), check)).alias("checks"))
    issues = checks.applicability_issues(F.col("o_orderstatus") != "P", F.col("checks"), F.array("o_orderpriority"), F.array().cast("array<string>"))
    return g.select("o_orderkey", F.array_join(F.array_sort(issues), ",").alias("issues"))


_CHUNK = "CASE p_partkey % 4 WHEN 0 THEN '<p>表 ' || CAST(p_size AS STRING) || ' ' || p_type || '：</p><table><tr><th>A ' || p_brand || '</th><td> </td><td>B&lt;</td></tr><tr><td>1</td></tr></table>' WHEN 1 THEN p_name || ' 表 3' WHEN 2 THEN ' ' ELSE 'intro</p>表0' || CAST(p_size AS STRING) || p_brand || '</p><TABLE border=1><tr><td>x</td></tr>' END"
_NAME = "CASE p_partkey % 3 WHEN 0 THEN 'GBT ' || CAST(1000 + p_size AS STRING) || '-2013 ' || p_brand || '.pdf' ELSE p_brand || '.pdf' END"
_META = rf"""c AS (SELECT p_partkey, {_CHUNK} AS t, {_NAME} AS f FROM part), l AS (SELECT *, regexp_matches(t, '(?i)<table') AS tab, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract(t, '(?is)^(.*?)<table', 1), '(?i)</(?:p|div|h\d|br|tr|table)>', chr(10), 'g'), '<[^>]+>', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^表\s*0*\d+'))[1] AS line FROM c),
m AS (SELECT p_partkey, tab, t, CASE WHEN f LIKE 'GBT %' THEN 'GB/T ' || regexp_extract(f, '(\d+-\d{{4}})', 1) END AS standard_no, CASE WHEN trim(t) <> '' THEN CASE WHEN tab THEN 'table' ELSE 'text' END END AS content_type, CASE WHEN tab THEN regexp_extract(line, '^表\s*0*(\d+)', 1) END AS table_no, CASE WHEN tab THEN nullif(regexp_replace(regexp_extract(line, '^表\s*0*\d+(.*)$', 1), '^[ ：:;；]+|[ ：:;；]+$', '', 'g'), '') END AS table_title FROM l)"""


@query(f"WITH {_META} SELECT p_partkey, standard_no, content_type, table_no, table_title, " + r"CASE WHEN tab THEN array_to_string(list_filter(list_transform(regexp_extract_all(regexp_extract(t, '(?is)<table[^>]*>(.*?)</tr>', 1), '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda x: trim(replace(x, '&lt;', '<'))), lambda x: x <> ''), '|') END AS columns FROM m")
def auto_metadata(spark, sf_dir) -> DataFrame:
    """What a chunk's text and file name tell."""
    m = table(spark, sf_dir, "part").select("p_partkey", documents.auto_metadata(F.expr(_CHUNK), F.expr(_NAME)).alias("m")).select("p_partkey", "m.*")
    return m.withColumn("columns", F.array_join("table_columns", "|")).drop("table_columns")


@query(f"WITH {_META}, b AS (SELECT m.p_partkey, CASE WHEN m.p_partkey % 2 = 0 THEN p_brand ELSE m.standard_no END AS standard_no, content_type, CASE WHEN m.p_partkey % 5 = 0 THEN '9' ELSE table_no END AS table_no, table_title, m.p_partkey % 2 <> 0 AND m.standard_no IS NOT NULL OR content_type IS NOT NULL OR m.p_partkey % 5 <> 0 AND table_no IS NOT NULL OR table_title IS NOT NULL AS changed FROM m JOIN part p ON p.p_partkey = m.p_partkey) SELECT p_partkey, standard_no, content_type, table_no, table_title FROM b WHERE changed")
def metadata_backfill(spark, sf_dir) -> DataFrame:
    """Stored metadata with its empty fields filled, where that changes it."""
    none = F.lit(None).cast("string")
    stored = F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("standard_no"), F.lit("").alias("content_type"), F.when(F.col("p_partkey") % 5 == 0, "9").alias("table_no"), none.alias("table_title"))
    rows = table(spark, sf_dir, "part").select("p_partkey", stored.alias("s"), documents.auto_metadata(F.expr(_CHUNK), F.expr(_NAME)).alias("m"))
    rows = rows.select("p_partkey", "s", documents.backfilled(F.col("m"), F.col("s")).alias("b"))
    fields = ("standard_no", "content_type", "table_no", "table_title")
    changed = [~F.coalesce(F.col(f"b.{f}"), F.lit("")).eqNullSafe(F.coalesce(F.col(f"s.{f}"), F.lit(""))) for f in fields]
    return rows.filter(changed[0] | changed[1] | changed[2] | changed[3]).select("p_partkey", "b.*")


_REPORT = "CASE p_partkey % 4 WHEN 0 THEN '<tr><td>检测依据</td><td>GB／T 1094.' || CAST(p_size AS STRING) || '-2013、DL/T 9-2018 gb/t 1094.' || CAST(p_size AS STRING) || '-2013</td>' WHEN 1 THEN p_name || chr(10) || '## 检验依据' || chr(10) || 'IEC 60076-2011 and Q / GDW ' || CAST(p_size AS STRING) || ' - 2001' || chr(10) || '# next' || chr(10) || 'GB 1-2000' WHEN 2 THEN 'GB 1-2000' ELSE p_type END"


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN array_to_string(list_transform(list_distinct(list_transform(regexp_extract_all(replace(upper(t), '／', '/'), '(?:GB|DL)/T [0-9.]+-[0-9]{{4}}'), lambda x: x)), lambda x: x), ',') WHEN 1 THEN regexp_extract(t, 'IEC [0-9]+-[0-9]{{4}}') || ',' || replace(regexp_extract(t, 'Q / GDW [0-9]+ - [0-9]{{4}}'), ' / ', '/').replace(' - ', '-') ELSE '' END AS standards FROM (SELECT p_partkey, {_REPORT} AS t FROM part)".replace("list_distinct(", "list_sort(list_distinct(").replace("lambda x: x)), lambda x: x)", "lambda x: x))), lambda x: x)"))
def declared_basis(spark, sf_dir) -> DataFrame:
    """Standards that a report declares, not those it mentions."""
    rows = table(spark, sf_dir, "part").select("p_partkey", documents.declared_standards(F.expr(_REPORT)).alias("s"))
    ordered = F.when(F.col("p_partkey") % 4 == 0, F.array_sort("s")).otherwise(F.col("s"))
    return rows.select("p_partkey", F.array_join(ordered, ",").alias("standards"))

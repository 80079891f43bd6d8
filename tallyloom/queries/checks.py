"""Checks of rewrites, judgments, requirements and labels. Inputs are made of the tables' values by SQL that
both engines read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import checks, decoding, text
from ..operators import review
from .registry import query, table

_P = "CAST(p_partkey % 50 AS STRING)"
_QUERY = f"'变压器空载损耗限值要求 ' || p_type || ' GB/T 1094.' || {_P} || '-2013 ' || {_P} || '.50 kV'"
_REWRITE = f"CASE p_partkey % 7 WHEN 0 THEN '变压器空载损耗 gb/t1094.' || {_P} || '-2013 ' || {_P} || '.5' WHEN 1 THEN '变压器空载损耗 IEC 60076' WHEN 2 THEN '变压器空载损耗 77' WHEN 3 THEN '空载损耗 ' || p_name WHEN 4 THEN '  ' WHEN 5 THEN '变压器空载损耗' || repeat('x', 1020) ELSE '变压器空载损耗与限值' END"
_REFS = r"list_transform(regexp_extract_all({0}, '(?i)(?:GB(?:/T)?|JB/T|DL/T|Q/GDW|IEC|ISO)\s*[0-9][0-9A-Z.\-/]*'), lambda r: regexp_replace(upper(r), '[^0-9A-Z]', '', 'g'))"
_DECS = r"list_transform(regexp_extract_all({0}, '\d+(?:\.\d+)?'), lambda n: n::DECIMAL(30, 10))"
_LACKS = "len(list_filter({0}, lambda x: NOT list_contains({1}, x))) > 0"


@query(f"SELECT p_partkey, CASE WHEN w = '' THEN 'omitted' WHEN length(w) > 1024 THEN 'oversized' WHEN {_LACKS.format(_REFS.format('w'), _REFS.format('q'))} THEN 'standard' WHEN {_LACKS.format(_DECS.format('w'), _DECS.format('q'))} THEN 'number' WHEN NOT contains(w, '变压器空载损耗') THEN 'anchor' END AS issue, CASE WHEN {_LACKS.format(_REFS.format('w'), _REFS.format('q'))} THEN 'standard' WHEN {_LACKS.format(_DECS.format('w'), _DECS.format('q'))} THEN 'number' END AS ungrounded FROM (SELECT p_partkey, {_QUERY} AS q, trim(regexp_replace({_REWRITE}, '\\s+', ' ', 'g')) AS w FROM part)")
def rewrite_checks(spark, sf_dir) -> DataFrame:
    """Rewrites that add standards or numbers or lose the query's terms."""
    q, w = F.expr(_QUERY), F.expr(_REWRITE)
    return table(spark, sf_dir, "part").select("p_partkey", checks.rewrite_issue(q, w).alias("issue"), checks.ungrounded(q, w).alias("ungrounded"))


_EQ = "p_name || ' <eq id=\"1\">I_{0} \\\\leqslant 1</eq> 5 A, x \\\\le 3 \\\\pm 2 \\\\% and ' || p_type"


@query(r"""SELECT p_partkey, trim(regexp_replace(p_name || ' I_{0} ≤ 15 A, x ≤ 3 ± 2 % and ' || p_type, '\s+', ' ', 'g')) AS plain FROM part""")
def rewrite_query_text(spark, sf_dir) -> DataFrame:
    """A query's equations as signs; a number that a tag cuts is joined."""
    q = F.concat(F.col("p_name"), F.lit(' <eq id="1">I_{0} \\leqslant 1</eq> 5 A, x \\le 3 \\pm 2 \\% and '), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", checks.query_text(q).alias("plain"))


_PAGE = "CASE page_id % 5 WHEN 0 THEN '<p>检测结果 汇总（一）</p>' WHEN 1 THEN '检测项目&nbsp;标准要求：结论' WHEN 2 THEN '检测结论 检测依据' WHEN 3 THEN '报告&lt;正文' ELSE '' END || html"
_LOCATED = "lower(regexp_replace(translate(replace(replace(replace(replace(regexp_replace(" + _PAGE + r", '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '：（）', ':()'), '[\s\x0b\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+', '', 'g'))"


@query(f"SELECT page_id, sha256(t) AS sha, CASE WHEN contains(t, '检测结果汇总') OR contains(t, '检测项目') AND contains(t, '标准要求') AND (contains(t, '结论') OR contains(t, '检测结果')) THEN 'summary' WHEN contains(t, '检测结论') AND contains(t, '检测依据') THEN 'toc' WHEN contains(t, '报告正文') THEN 'body' ELSE 'other' END AS kind FROM (SELECT page_id, {_LOCATED} AS t FROM pages)")
def page_kinds(spark, sf_dir) -> DataFrame:
    """Pages in the form that places are looked for in, and what kind they are."""
    t = checks.locate_text(F.expr(_PAGE))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.sha2("t", 256).alias("sha"), checks.page_kind(F.col("t")).alias("kind"))


_NEED = "CASE p_partkey % 4 WHEN 0 THEN p_type || '（%）：≤ 1.50' WHEN 1 THEN p_type || ' (kW): ≥' || CAST(p_size AS STRING) || '.00 kW' WHEN 2 THEN p_brand || ' ≧2.0' ELSE p_name END"
_NEED_UNIT = "CASE p_partkey % 4 WHEN 0 THEN '%' WHEN 1 THEN 'kW' ELSE '/' END"


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(replace(replace(CASE WHEN u = '/' THEN t ELSE replace(replace(t, '(' || u || ')', ''), u, '') END, '(%)', ''), '%', '')), '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS key FROM (SELECT p_partkey, " + _NEED_UNIT + r" AS u, regexp_replace(replace(replace(replace(translate(" + _NEED + r", '（）：', '():'), '≤', '<='), '≥', '>='), '≧', '>='), '\s+', '', 'g') AS t FROM part)")
def requirement_keys(spark, sf_dir) -> DataFrame:
    """Requirements that differ in form only have one key."""
    return table(spark, sf_dir, "part").select("p_partkey", checks.requirement_key(F.expr(_NEED), F.expr(_NEED_UNIT)).alias("key"))


_ASKED = "p_brand || ' 见表 A ' || CAST(p_size AS STRING) || ' 第 3.2 条 空载损耗 12.5 kv ' || upper(p_brand)"


@query(r"WITH q AS (SELECT p_partkey, " + _ASKED + r" AS q FROM part), t AS (SELECT p_partkey, list_filter(list_concat(list_transform(regexp_extract_all(q, '表\s*[A-Za-z]?\s*\d+'), lambda x: regexp_replace(x, '\s+', '', 'g')), list_transform(regexp_extract_all(q, '第?\s*\d+(?:\.\d+)*\s*条'), lambda x: regexp_replace(x, '\s+', '', 'g')), list_transform(regexp_extract_all(q, '(?i)\d+(?:\.\d+)?\s*(?:kVA|kV|kW|A|V|%)?'), lambda x: trim(x)), regexp_extract_all(q, '[\x{4e00}-\x{9fff}]{2,12}'), regexp_extract_all(q, '[A-Za-z][A-Za-z0-9._-]+')), lambda x: length(x) >= 2) AS ts FROM q) SELECT p_partkey, array_to_string(list_filter(ts, lambda x, i: list_position(list_transform(ts, lambda y: lower(y)), lower(x)) = i), '|') AS terms FROM t")
def query_term_lists(spark, sf_dir) -> DataFrame:
    """Tables, clauses, quantities, words and identifiers of a query."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(checks.query_terms(F.expr(_ASKED)), "|").alias("terms"))


_WINDOW = "SELECT doc_id, count(*) AS windows, sum(length(w)) AS chars, min(w) AS first FROM (SELECT doc_id, substr(text, greatest(i - 100, 1)::BIGINT, 3 + least(i - 1, 100)::BIGINT + 100) AS w FROM (SELECT doc_id, text, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents) WHERE lower(substr(text, i, 3)) = 'the') WHERE r <= 3) GROUP BY doc_id"


@query(_WINDOW)
def context_windows(spark, sf_dir) -> DataFrame:
    """Stretches around the first three places of a term in whole texts."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.windows(F.col("text"), F.lit("the"), 100, 3)).alias("w"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.length("w")).alias("chars"), F.min("w").alias("first"))


_JUDGED = {
    "status": "CASE o_orderkey % 6 WHEN 0 THEN 'supported' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'not_audited' WHEN 3 THEN 'insufficient_context' WHEN 4 THEN 'match' ELSE 'odd' END",
    "authority": "CASE WHEN o_custkey % 3 = 0 THEN 'unknown' ELSE 'model' END", "closed": "o_custkey % 4 = 0", "n": "o_orderkey % 5", "kind": "CASE o_custkey % 3 WHEN 0 THEN 'tolerance' WHEN 1 THEN 'upper_bound' ELSE 'text' END",
}
_RECOVERY = f"""WITH o AS (SELECT o_orderkey, o_custkey, {_JUDGED['status']} AS status, {_JUDGED['authority']} AS authority, {_JUDGED['closed']} AS closed, {_JUDGED['n']} AS n FROM orders),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'judge_consistency_failure' WHEN o_orderkey % 29 = 0 THEN 'judge_contract_failure' WHEN status IN ('supported', 'mismatch') THEN CASE WHEN closed OR authority = 'unknown' THEN 'definitive_with_valid_evidence' ELSE 'model_judgment_not_closed' END
  WHEN o_custkey % 7 = 0 AND n = 0 THEN 'retrieval_runtime_failure' WHEN o_custkey % 5 = 0 THEN 'applicability_parameter_missing' WHEN n = 0 THEN 'retrieval_no_candidates' WHEN status = 'not_audited' THEN 'provisional_not_audited' WHEN status = 'insufficient_context' THEN 'judge_insufficient_without_explicit_retrieval_gap' ELSE 'not_applicable' END AS reason FROM o)
SELECT o_orderkey, CASE WHEN reason LIKE 'judge\\_con%' ESCAPE '\\' THEN 'rejudge_only' WHEN reason = 'retrieval_runtime_failure' THEN 'runtime_failure' WHEN reason IN ('applicability_parameter_missing', 'retrieval_no_candidates', 'provisional_not_audited') THEN 'agent_recovery' ELSE 'accept_provisional' END AS action, reason FROM r"""


@query(_RECOVERY)
def recovery_gate(spark, sf_dir) -> DataFrame:
    """What is to be done about a provisional judgment."""
    o = table(spark, sf_dir, "orders")
    one = lambda c, t: F.when(c, F.array(F.lit(t))).otherwise(F.array().cast("array<string>"))
    issues = F.concat(one(F.col("o_orderkey") % 29 == 0, "no evidence"), one(F.col("o_orderkey") % 2 == 0, "rejudge triggered: once"))
    d = checks.recovery(F.expr(_JUDGED["status"]), issues, one(F.col("o_orderkey") % 31 == 0, "left"), F.expr(_JUDGED["closed"]), F.expr(_JUDGED["authority"]), one(F.col("o_custkey") % 7 == 0, "index"), F.expr(_JUDGED["n"]), one(F.col("o_custkey") % 5 == 0, "um_kv"))
    return o.select("o_orderkey", d.alias("d")).select("o_orderkey", "d.*")


@query(f"SELECT o_orderkey, CASE WHEN s IN ('supported', 'mismatch') AND k <> 'text' THEN array_to_string(list_filter([CASE WHEN m <> 0 THEN CASE WHEN m < 3 THEN 'only_other_roles' ELSE 'no_nominal_rule' END END, CASE WHEN k = 'tolerance' AND m <> 1 THEN 'no_tolerance_rule' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS issues FROM (SELECT o_orderkey, o_orderkey // 6 % 4 AS m, {_JUDGED['status']} AS s, {_JUDGED['kind']} AS k FROM orders)")
def evidence_role_issues(spark, sf_dir) -> DataFrame:
    """Numeric verdicts without evidence of a nominal value."""
    m = F.floor(F.col("o_orderkey") / 6) % 4
    roles = F.when(m == 0, F.array(F.lit("nominal_rule"), F.lit("method_rule"))).when(m == 1, F.array(F.lit("tolerance_rule"))).when(m == 2, F.array(F.lit("method_rule"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(checks.role_issues(F.expr(_JUDGED["status"]), F.expr(_JUDGED["kind"]), roles), ",").alias("issues"))


@query(f"WITH j AS (SELECT o_orderkey, {_JUDGED['status']} AS s, list_distinct(list(l_linenumber) FILTER (l_quantity > 25)) AS known, list_sort(list_distinct(list(l_linenumber) FILTER (l_linenumber <= 3))) AS keys FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey), k AS (SELECT *, CASE s WHEN 'match' THEN 'supported' ELSE s END AS named, list_filter(coalesce(keys, []), lambda x: list_contains(coalesce(known, []), x)) AS kept FROM j) SELECT o_orderkey, CASE WHEN named IN ('supported', 'mismatch') AND len(kept) = 0 OR named = 'odd' THEN 'insufficient_context' ELSE named END AS status, array_to_string(kept, ',') AS keys FROM k")
def judgment_contract(spark, sf_dir) -> DataFrame:
    """Verdicts of orders that cite lines; those of 25 or less are not known."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_linenumber"))).alias("known"), F.sort_array(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")))).alias("keys"))  # noqa: E741
    none = F.array().cast("array<int>")
    o = table(spark, sf_dir, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    j = checks.judged(F.expr(_JUDGED["status"]), F.coalesce(F.col("keys").cast("array<int>"), none), F.coalesce(F.col("known").cast("array<int>"), none))
    return o.select("o_orderkey", j.alias("j")).select("o_orderkey", "j.status", F.array_join(F.transform("j.keys", lambda k: k.cast("string")), ",").alias("keys"))


_SAID = """CASE o_orderkey % 8 WHEN 0 THEN '```json {"verdict": "match", "n": ' || CAST(o_custkey AS STRING) || '} ```' WHEN 1 THEN 'Verdict： mismatch, kind: x' WHEN 2 THEN '两者不一致' WHEN 3 THEN '相符' WHEN 4 THEN '证据不足，不符' WHEN 5 THEN '{"verdict": broken' WHEN 6 THEN '超出审查范围' ELSE o_orderpriority END"""


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN json_extract_string(regexp_extract(s, '\\{.*\\}'), '$.verdict') WHEN 7 THEN NULL ELSE CASE WHEN l <> '' THEN l WHEN regexp_matches(s, '适用性未定|无法评估|无法判定|证据不足|证据不够') THEN 'unevaluable' WHEN regexp_matches(s, '不构成限值|无需检索|超出审查范围|不予审查') THEN 'out_of_scope' WHEN regexp_matches(s, '不一致|不匹配|不符|不通过') THEN 'mismatch' WHEN regexp_matches(s, '一致|匹配|相符|通过') THEN 'match' END END AS verdict, CASE o_orderkey % 8 WHEN 0 THEN 'strict' WHEN 7 THEN 'none' ELSE CASE WHEN l <> '' THEN 'loose' ELSE 'prose' END END AS mode FROM (SELECT o_orderkey, s, regexp_extract(s, '(?i)[\"'']?verdict[\"'']?\\s*[:：]\\s*[\"'']?([a-z_]+)', 1) AS l FROM (SELECT o_orderkey, " + _SAID + " AS s FROM orders))")
def verdict_texts(spark, sf_dir) -> DataFrame:
    """Verdicts of a model's last message in JSON, in loose fields, in prose."""
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.verdict_text(F.expr(_SAID)).alias("v")).select("o_orderkey", "v.*")


_CAPTION = "CASE p_partkey % 6 WHEN 0 THEN '表 0' || CAST(p_size AS STRING) || ' ' || p_type WHEN 1 THEN '表' || CAST(p_size AS STRING) || '10kV ' || p_name WHEN 2 THEN ' 表 b . 2' || p_type WHEN 3 THEN '表' || CAST(p_size AS STRING) || '35 kV' ELSE p_type END"
_SPLIT = r"""WITH c AS (SELECT p_partkey, p_size % 9 AS g, trim(CAPTION) AS t FROM part), n AS (SELECT *, upper(regexp_replace(regexp_extract(t, '(?s)^表\s*0*((?:[A-Za-z]\s*\.\s*)?\d+)', 1), '\s+', '', 'g')) AS raw, trim(regexp_extract(t, '(?s)^表\s*0*(?:[A-Za-z]\s*\.\s*)?\d+(.*)$', 1)) AS title FROM c WHERE regexp_matches(t, '^表\s*0*(?:[A-Za-z]\s*\.\s*)?\d+')),
k AS (SELECT *, list_filter(list_transform(range(1, length(raw)), lambda i: {'n': substr(raw, 1, i), 't': substr(raw, i + 1) || title}), lambda x: regexp_matches(x.t, '(?i)^\s*\d+(?:\.\d+)?\s*(?:kV|V|MVA|kVA)\b')) AS cuts, {'n': raw, 't': title} AS whole FROM n),
x AS (SELECT *, list_filter(list_concat([whole], cuts), lambda x: TRY_CAST(x.n AS INT) = g + 1) AS next FROM k),
p AS (SELECT p_partkey, CASE WHEN NOT regexp_full_match(raw, '[0-9]+') OR len(cuts) = 0 THEN whole WHEN len(next) > 0 THEN next[1] WHEN g IS NULL OR raw::INT > g + 5 THEN cuts[1] ELSE whole END AS c FROM x)
SELECT p_partkey, c.n AS number, c.t AS title FROM p""".replace("CAPTION", _CAPTION).replace("p_size % 9 AS g", "CASE WHEN p_partkey % 5 > 0 THEN p_size % 9 END AS g")


@query(_SPLIT)
def caption_numbers(spark, sf_dir) -> DataFrame:
    """Numbers and titles of captions, with voltages told from numbers."""
    g = F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") % 9)
    c = table(spark, sf_dir, "part").select("p_partkey", g.alias("g"), checks.caption(F.expr(_CAPTION)).alias("c")).filter("c IS NOT NULL")
    return c.select("p_partkey", checks.split_caption(F.col("c.number"), F.col("c.title"), F.col("g")).alias("s")).select("p_partkey", "s.*")


@query("SELECT user_id, id, place FROM (SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS place FROM events WHERE greatest(CASE WHEN event_id % 3 = 0 THEN (event_id % 100) / 100.0::DOUBLE ELSE -1 END, CASE WHEN event_id % 2 = 0 THEN (event_id % 70) / 100.0::DOUBLE ELSE -1 END) >= 0.5) WHERE place <= 5")
def score_filter(spark, sf_dir) -> DataFrame:
    """A user's five best events of those with a route score of 0.5 or more."""
    i = F.col("event_id")
    scores = F.map_filter(F.create_map(F.lit("a"), F.when(i % 3 == 0, (i % 100) / 100.0), F.lit("b"), F.when(i % 2 == 0, (i % 70) / 100.0)), lambda k, v: v.isNotNull())
    e = table(spark, sf_dir, "events").select("user_id", i.alias("id"), F.col("value").alias("rrf"), scores.alias("route_scores"))
    return review.above_threshold(e, "user_id", 0.5, 5).select("user_id", "id", "place")


@query("SELECT o_custkey AS report_id, o_orderkey AS item, count(*) FILTER (l_linenumber <> 2 AND l_orderkey IS NOT NULL) AS kept, CASE WHEN o_orderkey % 11 = 0 THEN 'no_project' WHEN o_orderstatus = 'P' THEN 'invalid_phase' WHEN bool_or(l_linenumber = 3) THEN 'result_field' END AS issue FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderstatus HAVING count(*) FILTER (l_linenumber <> 2) > 0")
def requirement_rows(spark, sf_dir) -> DataFrame:
    """Blank requirements dropped, and items that break the contract."""
    r = F.struct(F.when(F.col("l_linenumber") == 2, " ").otherwise(F.col("l_shipdate").cast("string")).alias("text"), F.when(F.col("l_linenumber") == 3, "x").alias("result"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(r).alias("requirements"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("phase"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("project"))
    items = o.join(lines, F.col("item") == F.col("l_orderkey"))
    return review.valid_requirements(items, ["O", "F"]).select("report_id", "item", F.size("requirements").cast("long").alias("kept"), "issue")


@query("SELECT k AS report, min(event_id) AS job_id FROM (SELECT event_id, props::JSON->>'k' AS k FROM events WHERE event_type IN ('click', 'view')) WHERE k IN (SELECT p_partkey::VARCHAR FROM part) GROUP BY k")
def active_jobs(spark, sf_dir) -> DataFrame:
    """The first queued or running job of each report, which its JSON names."""
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running").otherwise("done")
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("props").alias("result"))
    return review.active_job(jobs, table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("report")), "$.k")


_PEERS = """WITH r AS (SELECT o_orderkey AS id, o_custkey AS report, o_orderstatus AS item, o_orderpriority AS phase, o_orderpriority || ' ' || (o_orderkey % 10)::VARCHAR AS text FROM orders),
a AS (SELECT id AS asked_id, report AS r, item AS i, phase AS p, replace(text, ' ', '') AS t, list_distinct(list_concat(CASE WHEN contains(text, 'HIGH') OR contains(text, '7') THEN ['HIGH', '5'] ELSE [] END, CASE WHEN contains(text, '0') THEN ['0', 'URGENT'] ELSE [] END)) AS terms FROM r WHERE id % 20 < 2 AND len(terms) > 0),
s AS (SELECT asked_id, id, 3 * len(list_filter(terms, lambda x: contains('project ' || text, x))) + CASE WHEN item = i THEN 2 ELSE 0 END + CASE WHEN phase = p THEN 1 ELSE 0 END AS score FROM r JOIN a ON report = r.r WHERE NOT (item = i AND phase = p AND replace(text, ' ', '') = t))
SELECT asked_id, id, score::INT AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY score DESC, id)::INT AS place FROM s WHERE score > 0) WHERE place <= 12""".replace("JOIN a ON report = r.r", "JOIN a ON r.report = a.r")


@query(_PEERS)
def peer_context(spark, sf_dir) -> DataFrame:
    """Requirements of the same report that tell most about an asked one; one order in ten asks,
    by terms that rules give."""
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("report"), F.col("o_orderstatus").alias("item"), F.col("o_orderpriority").alias("phase"), F.lit("project").alias("project"), F.concat_ws(" ", "o_orderpriority", (F.col("o_orderkey") % 10).cast("string")).alias("text"))
    asked = r.filter("id % 20 < 2").withColumnRenamed("id", "asked_id")
    return review.peers(r, asked, [(("HIGH", "7"), ("HIGH", "5")), (("0",), ("0", "URGENT"))])


@query("SELECT p_partkey, s.s_suppkey AS case_id, CASE WHEN s.s_suppkey % 3 = 0 THEN 'mismatch' ELSE a END AS shadow, coalesce(CASE WHEN s.s_suppkey % 3 = 0 THEN 'mismatch' ELSE a END = e, false) AS shadow_correct FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'match' ELSE 'mismatch' END AS a, CASE WHEN p_partkey % 5 = 0 THEN 'match' ELSE 'mismatch' END AS e FROM part) p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey % 40")
def shadow_label_join(spark, sf_dir) -> DataFrame:
    """A shadow run's statuses beside the actual ones."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 40).cast("string").alias("project"), F.lit("r").alias("requirement"), F.when(F.col("p_partkey") % 2 == 0, "match").otherwise("mismatch").alias("actual"), F.when(F.col("p_partkey") % 5 == 0, "match").otherwise("mismatch").alias("expected"))
    s = table(spark, sf_dir, "supplier")
    cases = s.select(F.col("s_suppkey").cast("string").alias("project"), F.lit("r").alias("requirement"), F.col("s_suppkey").alias("case_id"))
    shadow = s.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("case_id"), F.lit("mismatch").alias("status"))
    return review.shadow_labels(p, cases, shadow).select("p_partkey", "case_id", "shadow", "shadow_correct")


@query("SELECT p_partkey AS edit_id, CASE WHEN g THEN 'found' ELSE 'missing_from_gold' END AS state, CASE WHEN g THEN v = w END AS verdict_agrees, CASE WHEN g AND k > 0 THEN p_size % 4 < 2 END AS kind_agrees, CASE WHEN g THEN k <> 1 OR p_size % 3 = 0 END AS flags_agree FROM (SELECT p_partkey, p_size, p_partkey % 6 > 0 AS g, p_partkey % 3 AS k, CASE WHEN p_size % 2 = 0 THEN 'match' ELSE 'mismatch' END AS v, CASE p_partkey % 3 WHEN 0 THEN 'match' ELSE 'mismatch' END AS w FROM part)")
def defect_contract(spark, sf_dir) -> DataFrame:
    """What edits were to change against what the records say."""
    p, arr = table(spark, sf_dir, "part"), lambda *xs: F.array(*map(F.lit, xs))
    edits = p.select(F.col("p_partkey").alias("edit_id"), (F.col("p_partkey") % 3).cast("string").alias("edit_kind"))
    kind = F.when(F.col("p_size") % 4 == 0, "a").when(F.col("p_size") % 4 == 1, "b").otherwise("c")
    records = p.filter("p_partkey % 6 > 0").select(F.col("p_partkey").alias("case_id"), F.when(F.col("p_size") % 2 == 0, "match").otherwise("mismatch").alias("verdict"), kind.alias("kind"), F.when(F.col("p_size") % 3 == 0, arr("x", "y")).otherwise(arr("y")).alias("flags"))
    c = spark.range(3).select(F.col("id").cast("string").alias("edit_kind"), F.when(F.col("id") == 0, "match").otherwise("mismatch").alias("verdict"), F.when(F.col("id") > 0, arr("a", "b")).alias("kinds"), F.when(F.col("id") == 1, arr("x")).alias("flags"))
    return review.defect_contracts(edits, records, F.broadcast(c))  # three rows


@query("SELECT user_id AS key, coalesce(min_by(props, event_id) FILTER (event_type = 'click'), '') AS click, coalesce(min_by(props, event_id) FILTER (event_type = 'view'), '') AS view, '' AS other FROM events GROUP BY user_id")
def first_parameters(spark, sf_dir) -> DataFrame:
    """The first value written for each field of a schema."""
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("props").alias("value"), "event_id")
    return review.first_written(items, ["click", "view", "other"], "event_id")


@query("SELECT c_custkey AS k, CASE WHEN count(o_orderkey) = 0 THEN 'no_evidence' WHEN max(o_totalprice) / 600000 < 0.2 THEN 'low_confidence' WHEN c_custkey % 2 = 0 AND NOT coalesce(bool_or(o_orderstatus = 'P'), false) THEN 'missing_structured_evidence' WHEN c_custkey % 3 = 0 AND NOT bool_or(regexp_matches(o_orderpriority, '[45]')) THEN 'missing_numeric_evidence' WHEN c_custkey % 5 = 0 THEN 'missing_clause_evidence' ELSE '' END AS gap FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def evidence_sufficiency(spark, sf_dir) -> DataFrame:
    """Why a query's evidence is not enough."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "P", "table").otherwise("section").alias("type"), F.regexp_replace("o_orderpriority", "[1-3]", "x").alias("text"), (F.col("o_totalprice") / 600000).alias("score"))
    hits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("q").alias("query")).join(o, F.col("o_custkey") == F.col("k"), "left")
    k = F.col("k")
    return review.sufficiency(hits, "k", {"table": k % 2 == 0, "numeric": k % 3 == 0, "clause": k % 5 == 0})


_MARKS = "len(regexp_extract_all({0}, '[ÃÂâæçèé]'))"


@query(f"""WITH s AS (SELECT doc_id, text, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: chr(('0x' || h)::INT)), '') AS wrong FROM documents)
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 AND {_MARKS.format("wrong")} >= 3 AND len(regexp_extract_all(text, '[ÃÂâæçèé�]')) >= {_MARKS.format("wrong")} THEN wrong ELSE text END) AS h FROM s""")
def mojibake_repair(spark, sf_dir) -> DataFrame:
    """Texts read in the wrong encoding come back as they were, but those whose own letters are as many marks."""
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    spoilt = F.when((F.col("doc_id") % 2 == 0) & (F.regexp_count(wrong, F.lit(checks.MOJIBAKE)) >= 3), wrong).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(checks.repaired(spoilt)).alias("h"))


@F.arrow_udf(BinaryType())
def _in_gb18030(texts: pa.Array) -> pa.Array:
    return decoding.mapped(texts, lambda some: [None if t is None else t.encode("gb18030") for t in some], pa.binary())


@query("SELECT doc_id, md5(CASE doc_id % 4 WHEN 1 THEN chr(65279) || text WHEN 3 THEN text || 'é' || chr(65533) || chr(65533) ELSE text END) AS h FROM documents")
def decode_chain(spark, sf_dir) -> DataFrame:
    """Texts from bytes in UTF-8, with a byte order mark, in GB18030, and in no encoding."""
    utf8, kind = F.encode(F.col("text"), "UTF-8"), F.col("doc_id") % 4
    raw = F.when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(kind == 2, _in_gb18030(F.col("text"))).when(kind == 3, F.concat(utf8, F.unhex(F.lit("C3A9FFFF")))).otherwise(utf8)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(decoding.decoded(raw).cast("binary")).alias("h"))

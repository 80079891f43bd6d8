"""Text functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lexical, matching
from .registry import query, table

_CANON = r"regexp_replace(regexp_replace({0}, '[ \t\n\r\x0b\f]+', ' ', 'g'), '^ | $', '', 'g')"
PLAIN = _CANON.format("replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')")


@query(f"SELECT doc_id, sha256({_CANON.format('text')}) AS sha FROM documents")
def content_fingerprint(spark, sf_dir) -> DataFrame:
    """C01, C02."""
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("sha"))


@query(f"SELECT sha, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, sha256({_CANON.format('text')}) AS sha FROM documents) GROUP BY sha")
def content_fingerprint_dedupe(spark, sf_dir) -> DataFrame:
    """Documents by content hash."""
    return table(spark, sf_dir, "documents").groupBy(text.fingerprint(F.col("text")).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query(f"SELECT page_id, {PLAIN.format('html')} AS plain FROM pages")
def markup_to_text(spark, sf_dir) -> DataFrame:
    """Text of pages."""
    return table(spark, sf_dir, "pages").select("page_id", text.plain(F.col("html")).alias("plain"))


@query("SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?i)<a [^>]*href=\"([^\"]*)\"', 1), lambda x: trim(x)), lambda x: x <> '').array_to_string(' ') AS links, len(regexp_extract_all(html, '(?i)<h[1-6][ >]'))::BIGINT AS headings FROM pages")
def page_structure(spark, sf_dir) -> DataFrame:
    """Links and headings by pattern."""
    h = F.col("html")
    links = F.filter(F.transform(F.regexp_extract_all(h, F.lit('(?i)<a [^>]*href="([^"]*)"'), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(links, " ").alias("links"), F.regexp_count(h, F.lit("(?i)<h[1-6][ >]")).cast("long").alias("headings"))


_CITED = "coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' 见表' || CAST(doc_id % 12 AS STRING) WHEN 1 THEN ' 如表 0' || CAST(doc_id % 7 AS STRING) || '; 表' || CAST(doc_id % 5 AS STRING) || '所示' WHEN 2 THEN ' 表' || CAST(doc_id % 9 AS STRING) || ' 见 表 3' ELSE '' END"
_CUE = r"(?:详见|参见|见|如)\s*表\s*0*\d+|表\s*0*\d+\s*(?:所示|所列|中|如下)"


def _kept(xs: str) -> str:
    """A list without later repeats."""
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


@query(rf"SELECT doc_id, array_to_string({_kept('refs')}, ',') AS refs FROM (SELECT doc_id, list_transform(regexp_extract_all(t, '{_CUE}'), lambda m: regexp_extract(m, '0*(\d+)', 1)) AS refs FROM (SELECT doc_id, {_CITED} AS t FROM documents))")
def table_ref_extract(spark, sf_dir) -> DataFrame:
    """C17: tables that a text refers to."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.table_references(F.expr(_CITED)), ",").alias("refs"))


_FILE = "lang || CASE doc_id % 6 WHEN 0 THEN ' GBT ' WHEN 1 THEN ' gb/t+' WHEN 2 THEN ' GB／T  ' WHEN 3 THEN ' Q ∕ GDW ' WHEN 4 THEN ' DL' ELSE ' XX ' END || CAST(1000 + doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN '-' WHEN 1 THEN ' - ' ELSE '—' END || '2023 ' || source || '.pdf'"


@query(rf"SELECT doc_id, CASE WHEN n <> '' THEN regexp_replace(regexp_replace(n, ' ?([/-]) ?', '\1', 'g'), '^(GB|JB)[/ ]?T\b', '\1/T') END AS no FROM (SELECT doc_id, regexp_extract(regexp_replace(upper(translate(regexp_replace({_FILE}, '\.[^.]+$', ''), '∕／—－+', '//-- ')), '\s+', ' ', 'g'), '(?:Q ?/ ?GDW|GB ?/? ?T|GB|JB ?/? ?T|JB|JGJ|DBJ|DB|HJ|DL|YY|JT|BB) ?[0-9.]+ ?- ?[0-9]{{4}}') AS n FROM documents)")
def standard_number(spark, sf_dir) -> DataFrame:
    """Numbers of standards from file names in several spellings, and from those without one."""
    return table(spark, sf_dir, "documents").select("doc_id", text.standard_no(F.expr(_FILE)).alias("no"))


_CLAUSES = "coalesce(text, '') || ' clause ' || CAST(doc_id % 9 + 1 AS STRING) || CASE doc_id % 3 WHEN 0 THEN '~' || CAST(doc_id % 9 + 1 + doc_id % 4 AS STRING) WHEN 1 THEN '' ELSE ' - 70' END || ', clause 7'"


@query(rf"WITH m AS (SELECT doc_id, regexp_extract_all({_CLAUSES}, 'clause\s*\d+(?:\s*[~～-]\s*\d+)?') AS ms FROM documents), r AS (SELECT doc_id, list_transform(ms, lambda m: list_transform(regexp_extract_all(m, '\d+'), lambda x: x::INT)) AS ns FROM m), f AS (SELECT doc_id, flatten(list_transform(ns, lambda n: range(n[1], CASE WHEN n[len(n)] >= n[1] THEN least(n[len(n)], n[1] + 49) ELSE n[1] END + 1))) AS xs FROM r) SELECT doc_id, array_to_string({_kept('xs')}, ',') AS numbers FROM f")
def numbered_ranges(spark, sf_dir) -> DataFrame:
    """N~M as each number, fifty of them at most."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.numbered_references(F.expr(_CLAUSES), "clause"), ",").alias("numbers"))


@query("WITH k AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[,，;；、\n]'), lambda x: left(trim(x), 80)), lambda x: x <> '') AS parts FROM benchmark) SELECT item_id, array_to_string(list_slice(" + _kept("parts") + ", 1, 8), '|') AS keywords FROM k")
def keyword_lists(spark, sf_dir) -> DataFrame:
    """Parts of a list, distinct, cut and limited."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.keyword_list(F.col("text")), "|").alias("keywords"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), '100%') OR contains(lower(text), 'the_')")
def substring_or_search(spark, sf_dir) -> DataFrame:
    """Any of several terms; % and _ are letters."""
    d = table(spark, sf_dir, "documents")
    return d.filter(matching.any_term(F.col("text"), ["license", "100%", "the_"])).select("doc_id")


@query("SELECT doc_id, round(len(list_filter(['the', 'und', 'license'], lambda t: contains(text, t))) / 3.0::DOUBLE, 6) AS ratio FROM documents")
def token_hit_ratio(spark, sf_dir) -> DataFrame:
    """C30, P25."""
    tokens = F.array(*map(F.lit, ("the", "und", "license")))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(matching.hit_ratio(F.col("text"), tokens), 6).alias("ratio"))


@query(r"SELECT doc_id, round(CASE WHEN length(c) > 0 THEN len(regexp_extract_all(text, '[=+*/^×÷√∑≤≥]')) / length(c) ELSE 0 END, 6) AS density FROM (SELECT doc_id, text, regexp_replace(text, '[ \t\n\r\x0b\f]+', '', 'g') AS c FROM documents)")
def formula_density(spark, sf_dir) -> DataFrame:
    """C26."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.formula_density(F.col("text")), 6).alias("density"))


_TOKEN = "CASE doc_id % 3 WHEN 0 THEN ' 00' || CAST(doc_id % 50 AS STRING) WHEN 1 THEN 'a . ' || CAST(doc_id % 50 AS STRING) ELSE text END"


@query(rf"SELECT doc_id, CASE WHEN regexp_full_match(t, '[0-9]+') THEN CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END ELSE t END AS no FROM (SELECT doc_id, upper(replace(regexp_replace({_TOKEN}, '\s+', '', 'g'), 'ß', 'ss')) AS t FROM documents)")
def number_tokens(spark, sf_dir) -> DataFrame:
    """Numbers and whole texts as tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", text.number_token(F.expr(_TOKEN)).alias("no"))


_QUOTE = "CASE doc_id % 4 WHEN 0 THEN substr(text, 11, 20) WHEN 1 THEN replace(replace(substr(text, 5, 30), ' ', '  '), 'e', 'E') WHEN 2 THEN 'no such <b>words</b>' ELSE substr(text, 3, 9) || ' <i>' || substr(text, 12, 9) || '</i>' END"
_KEY = r"regexp_replace(lower(regexp_replace({0}, '<[^>]+>', ' ', 'g')), '[^\pL\pM\pN_]+', '', 'g')"


@query(f"SELECT doc_id, CASE WHEN contains(text, q) THEN 'exact' WHEN contains({_KEY.format('text')}, {_KEY.format('q')}) THEN 'format_only' ELSE 'unmatched' END AS match FROM (SELECT doc_id, text, {_QUOTE} AS q FROM documents)")
def quote_provenance(spark, sf_dir) -> DataFrame:
    """Quotes from a document as they are, with other spacing and markup, or from nowhere."""
    return table(spark, sf_dir, "documents").select("doc_id", text.quote_match(F.expr(_QUOTE), F.col("text")).alias("match"))


@query("SELECT doc_id, sha256(CASE WHEN h = '' THEN text ELSE h || chr(10) || chr(10) || text END) AS sha FROM (SELECT doc_id, text, concat_ws(' | ', CASE WHEN doc_id % 2 = 0 THEN source END, lang) AS h FROM documents)")
def embedding_documents(spark, sf_dir) -> DataFrame:
    """Labels that aren't empty, then the body, and its hash."""
    d = table(spark, sf_dir, "documents")
    label = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return d.select("doc_id", F.sha2(text.document_text(label, F.col("lang"), body=F.col("text")), 256).alias("sha"))


_EXACT_SQL = r"[a-z][a-z0-9]*(?:[./\-][a-z0-9]+)+|[0-9]+(?:\.[0-9]+)?[\x20\x09-\x0D]*(?:kva|kv|kw|hz|db|mω|μs|ms|w|v|a|s|%)|[0-9]+(?:\.[0-9]+)*"
_STOPS = "'nbsp', 'table', 'tr', 'td', 'th', 'tbody', 'thead', 'colspan', 'rowspan', '以及', '或者', '进行', '应按', '符合', '规定', '要求', '试验', '标准'"


@query(rf"""WITH t AS (SELECT doc_id, lower(translate(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '（）％', '()%')) AS p FROM documents),
k AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_concat(regexp_split_to_array(p, '[^\p{{L}}\p{{M}}\p{{N}}]+'), list_transform(regexp_extract_all(p, '{_EXACT_SQL}'), lambda x: regexp_replace(x, '[^0-9a-z\p{{Han}}]+', '', 'g'))), lambda x: (length(x) >= 2 OR regexp_matches(x, '^[0-9]$')) AND x NOT IN ({_STOPS})))) AS tokens FROM t)
SELECT doc_id, len(tokens)::BIGINT AS tokens, md5(array_to_string(tokens, ' ')) AS digest FROM k""")
def search_tokens(spark, sf_dir) -> DataFrame:
    """Distinct search tokens: words, identifiers and measures squeezed, without the stop list."""
    t = table(spark, sf_dir, "documents").select("doc_id", lexical.search_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("digest"))


@query("SELECT doc_id, text[1:500] AS snippet, length(text) AS chars FROM documents")
def snippets(spark, sf_dir) -> DataFrame:
    """The first 500 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"), F.length("text").cast("long").alias("chars"))


_UNITS = text.UNIT_WORDS
_BARE = f"regexp_replace(regexp_replace(lower({{0}}), '[ _]', '', 'g'), '{_UNITS}', '', 'g')"
_TOKENS = f"list_distinct(list_filter(regexp_extract_all({_BARE}, '[a-z][a-z0-9_]*'), lambda t: length(t) > 1))"


@query(f"WITH p AS (SELECT item_id, {PLAIN.format('text')} AS t FROM benchmark), n AS (SELECT a.item_id, regexp_replace(lower(a.t), '[ _]', '', 'g') AS x, regexp_replace(lower(b.t), '[ _]', '', 'g') AS y, {_TOKENS.format('a.t')} AS u, {_TOKENS.format('b.t')} AS v FROM p a JOIN p b ON b.item_id = a.item_id + 1), s AS (SELECT *, len(list_intersect(u, v)) / least(len(u), len(v)) AS share FROM n) SELECT item_id, round(CASE WHEN least(len(u), len(v)) = 0 THEN 0 WHEN contains(x, y) OR contains(y, x) THEN greatest(share, 0.9) ELSE share END, 6) AS similarity FROM s")
def concept_similarity(spark, sf_dir) -> DataFrame:
    """Neighbouring benchmark items."""
    b = table(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select("item_id", F.round(text.concept_similarity(F.col("text"), F.col("other")), 6).alias("similarity"))

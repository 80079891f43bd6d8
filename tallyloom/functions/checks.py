"""Checks of generated text and judgments: what was added, what is missing, and what is to be done about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .text import let

#: References to standards, ends of terms that say nothing, phrases and particles around terms (fixed values).
REFERENCE = r"(?i)(?:GB(?:/T)?|JB/T|DL/T|Q/GDW|IEC|ISO)\s*[0-9][0-9A-Z.\-/]*"
GENERIC_ENDS = "(?:限值|测量|试验|要求|规定|标准|项目)+$"
PHRASES = ("请根据", "根据", "已绑定知识库", "知识库", "说明", "介绍", "解释", "请给出", "给出", "页码引用", "引用", "是什么", "定义")
PARTICLES = "[的之与及和并]"
_HAN = r"[\x{4e00}-\x{9fff}]"


def references(value: Column) -> Column:
    """Standards referred to, as letters and digits in capitals."""
    return F.array_distinct(F.transform(F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(0)), lambda r: F.regexp_replace(F.upper(r), "[^0-9A-Z]", "")))


def decimals(value: Column) -> Column:
    """Numbers as decimals, so that 1 and 1.0 are one."""
    return F.array_distinct(F.transform(F.regexp_extract_all(value, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: n.cast("decimal(30,10)")))


def decimal_tokens(value: Column) -> Column:
    """Numbers as texts without trailing zeros, each once."""
    found = F.regexp_extract_all(value, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(F.regexp_replace(n, r"(\.\d*?)0+$", "$1"), r"\.$", "")))


def anchors(query: Column) -> Column:
    """Terms of four Han characters or more that a rewrite of the query must keep."""

    def core(run: Column) -> Column:
        out = F.regexp_replace(run, GENERIC_ENDS, "")
        for phrase in PHRASES:
            out = F.replace(out, F.lit(phrase), F.lit(""))
        return F.regexp_replace(out, PARTICLES, "")

    runs = F.regexp_extract_all(query, F.lit(_HAN + "{4,}"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(runs, core), lambda a: F.length(a) >= 4))


def rewrite_issue(query: Column, rewrite: Column, most: int = 1024) -> Column:
    """Why a rewrite is refused: 'omitted', 'oversized', 'standard', 'number' or 'anchor'; null if it is not."""
    out = F.coalesce(text.canonical(rewrite), F.lit(""))
    return (
        F.when(out == "", "omitted").when(F.length(out) > most, "oversized").when(F.size(F.array_except(references(out), references(query))) > 0, "standard")
        .when(F.size(F.array_except(decimals(out), decimals(query))) > 0, "number").when(F.exists(anchors(query), lambda a: ~F.contains(out, a)), "anchor")
    )


def ungrounded(source: Column, generated: Column) -> Column:
    """'standard' or 'number' where a text has one that its source has not; else null."""
    new = lambda f: F.size(F.array_except(f(generated), f(source))) > 0
    return F.when(new(references), "standard").when(new(decimals), "number")


#: Commands that a query's equations are read by (fixed values).
EQUATION_SIGNS = {"leqslant": "≤", "leq": "≤", "le": "≤", "geqslant": "≥", "geq": "≥", "ge": "≥", "pm": "±", "times": "×", "cdot": "·"}


def query_text(value: Column) -> Column:
    """A query without equation tags, its commands as signs; a number cut by a tag is joined again."""
    out = F.regexp_replace(value, r"(?is)<eq\b[^>]*>(.*?\d)\s*</eq>\s*(\d+)(?=\D|$)", "$1$2")
    out = F.regexp_replace(out, r"(?i)</?eq\b[^>]*>", " ")
    for command, sign in EQUATION_SIGNS.items():
        out = F.regexp_replace(out, rf"\\{command}\b", sign)
    return text.canonical(F.replace(out, F.lit("\\%"), F.lit("%")))


def locate_text(value: Column) -> Column:
    """Text as places are looked for: no tags and white space, plain brackets and colons, lower case."""
    out = F.regexp_replace(value, "<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.lower(F.regexp_replace(F.translate(out, "：（）", ":()"), r"(?U)\s+", ""))


#: Words by which a report's page is told: kind, and those that must all be there (fixed values).
PAGE_KINDS = (
    ("summary", ("检测结果汇总",)), ("summary", ("检测项目", "标准要求", "结论")), ("summary", ("检测项目", "标准要求", "检测结果")), ("toc", ("检测结论", "检测依据")), ("body", ("报告正文",)),
)


def page_kind(located: Column) -> Column:
    out = F.lit("other")
    for kind, words in reversed(PAGE_KINDS):
        all_ = F.lit(True)
        for w in words:
            all_ = all_ & F.contains(located, F.lit(w))
        out = F.when(all_, kind).otherwise(out)
    return out


def requirement_key(value: Column, unit: Column) -> Column:
    """A requirement without what does not tell it apart: white space, its unit, forms of signs and brackets,
    trailing zeros."""
    out = F.translate(value, "（）：％≧≥＜＞", "():%≥≥<>")
    out = F.replace(F.replace(out, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    out = F.regexp_replace(out, r"(?U)\s+", "")
    plain_unit = F.trim(F.coalesce(unit, F.lit("")))
    without = lambda s: F.replace(F.replace(s, F.concat(F.lit("("), plain_unit, F.lit(")")), F.lit("")), plain_unit, F.lit(""))
    out = F.when(plain_unit.isin("", "/", "-"), out).otherwise(without(out))
    out = F.replace(F.replace(out, F.lit("(%)"), F.lit("")), F.lit("%"), F.lit(""))
    return F.lower(F.regexp_replace(F.regexp_replace(out, r"(\d+\.\d*?)0+(?!\d)", "$1"), r"\.(?!\d)", ""))


#: What a query is searched by, in order: tables, clauses, quantities, Han words, identifiers (fixed values).
TERM_PATTERNS = (r"表\s*[A-Za-z]?\s*\d+", r"第?\s*\d+(?:\.\d+)*\s*条", r"(?i)\d+(?:\.\d+)?\s*(?:kVA|kV|kW|A|V|%)?", _HAN + "{2,12}", r"[A-Za-z][A-Za-z0-9._-]{1,}")


def query_terms(query: Column) -> Column:
    """Terms of two characters or more in the order of their patterns, each once whatever its case."""
    squeezed, stripped = (lambda t: F.regexp_replace(t, r"\s+", "")), (lambda t: F.trim(t))
    found = [F.transform(F.regexp_extract_all(query, F.lit(p), F.lit(0)), squeezed if i < 2 else stripped) for i, p in enumerate(TERM_PATTERNS)]
    terms = F.filter(F.concat(*found), lambda t: F.length(t) >= 2)
    return let(terms, lambda ts: F.filter(ts, lambda t, i: F.array_position(F.transform(ts, lambda x: F.lower(x)), F.lower(t)) == i + 1))


def recovery(status: Column, issues: Column, remaining: Column, closed: Column, authority: Column, degraded: Column, delivered: Column, missing: Column) -> Column:
    """(action, reason) for a provisional judgment: contract failures first, then definite verdicts, failures of
    retrieval, missing parameters, and verdicts without evidence. Arrays may be null."""
    some = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0
    say = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    live = F.filter(issues, lambda i: ~F.startswith(i, F.lit("rejudge triggered:")) & (F.trim(i) != ""))
    definite = status.isin("supported", "mismatch")
    return (
        F.when(some(remaining), say("rejudge_only", "judge_consistency_failure")).when(some(live), say("rejudge_only", "judge_contract_failure"))
        .when(definite & (closed | (authority == "unknown")), say("accept_provisional", "definitive_with_valid_evidence")).when(definite, say("accept_provisional", "model_judgment_not_closed"))
        .when(some(degraded) & (delivered <= 0), say("runtime_failure", "retrieval_runtime_failure")).when(some(missing), say("agent_recovery", "applicability_parameter_missing"))
        .when(delivered <= 0, say("agent_recovery", "retrieval_no_candidates")).when(status == "not_audited", say("agent_recovery", "provisional_not_audited"))
        .when(status == "insufficient_context", say("accept_provisional", "judge_insufficient_without_explicit_retrieval_gap")).otherwise(say("accept_provisional", "not_applicable"))
    )


def role_issues(status: Column, kind: Column, roles: Column) -> Column:
    """Issues of a numeric verdict: it takes evidence of a nominal value, a tolerance one of a tolerance too."""
    nominal = F.when(~F.array_contains(roles, "nominal_rule"), F.when(F.size(roles) > 0, "only_other_roles").otherwise("no_nominal_rule"))
    tolerance = F.when((kind == "tolerance") & ~F.array_contains(roles, "tolerance_rule"), "no_tolerance_rule")
    numeric = status.isin("supported", "mismatch") & (kind != "text")
    return F.filter(F.when(numeric, F.array(nominal, tolerance)).otherwise(F.array().cast("array<string>")), lambda i: i.isNotNull())


def applicability_issues(definite: Column, given: Column, sources: Column, standards: Column) -> Column:
    """Distinct issues of the conditions (role, condition, source, state, quote) that a definite verdict rests on:
    each must be confirmed and quoted from its kind of source, and one of them must be a fact of the sample."""
    some = lambda xs, q: F.exists(xs, lambda x: text.quote_match(q, x) != "unmatched")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""

    def of(c: Column) -> Column:
        role = F.coalesce(c["role"], F.lit("sample_fact"))
        found = F.when(blank(c["quote"]), F.lit(False)).when(role == "standard_condition", some(standards, F.trim(c["quote"]))).otherwise(some(sources, F.trim(c["quote"])))
        return F.array(
            F.when(~role.isin("sample_fact", "standard_condition"), "invalid_applicability_evidence_role"), F.when(blank(c["condition"]) | blank(c["source"]), "missing_condition_source"),
            F.when(~F.coalesce(c["state"], F.lit("")).isin("confirmed"), "unresolved_applicability_condition"), F.when(~found, "unverified_applicability_quote"),
        )

    fact = F.exists(given, lambda c: F.coalesce(c["role"], F.lit("sample_fact")) == "sample_fact")
    all_ = F.concat(F.flatten(F.transform(given, of)), F.array(F.when(~fact, "missing_sample_parameter_evidence")))
    none = F.array().cast("array<string>")
    listed = F.array_distinct(F.filter(all_, lambda i: i.isNotNull()))
    return F.when(~definite, none).when(F.size(F.coalesce(given, F.array().cast("array<struct<role:string,condition:string,source:string,state:string,quote:string>>"))) == 0, F.array(F.lit("missing_applicability_checks"))).otherwise(listed)


#: Older names of verdicts, and those allowed (fixed values).
LEGACY_STATUS = {"match": "supported", "unevaluable": "insufficient_context", "out_of_scope": "not_audited"}
STATUSES = ("supported", "mismatch", "insufficient_context", "not_audited")


def judged(status: Column, keys: Column, known: Column) -> Column:
    """(status, keys) by contract: old names mapped, unknown keys dropped, and what is not allowed, or definite
    without evidence, down to insufficient_context."""
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LEGACY_STATUS.items() for x in p]), status), status)
    kept = F.filter(keys, lambda k: F.array_contains(known, k))
    bare = named.isin("supported", "mismatch") & (F.size(kept) == 0)
    return F.struct(F.when(~named.isin(*STATUSES) | bare, "insufficient_context").otherwise(named).alias("status"), kept.alias("keys"))


#: Words of a verdict in prose, those that deny it first (fixed values).
PROSE = (("unevaluable", "适用性未定|无法评估|无法判定|证据不足|证据不够"), ("out_of_scope", "不构成限值|无需检索|超出审查范围|不予审查"), ("mismatch", "不一致|不匹配|不符|不通过"), ("match", "一致|匹配|相符|通过"))


def verdict_text(value: Column) -> Column:
    """(verdict, mode) of a model's last message: 'strict' JSON, 'loose' fields, 'prose', or 'none'."""
    bare = F.trim(F.regexp_replace(value, "(?i)```(?:json)?", ""))

    def of(t: Column) -> Column:
        strict = F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0))
        field = F.try_variant_get(strict, "$.verdict", "string")
        loose = F.nullif(F.regexp_extract(t, r"""(?i)["']?verdict["']?\s*[:：]\s*["']?([a-z_]+)""", 1), F.lit(""))
        prose = F.lit(None).cast("string")
        for verdict, words in reversed(PROSE):
            prose = F.when(t.rlike(words), verdict).otherwise(prose)
        mode = F.when(field.isNotNull(), "strict").when(loose.isNotNull(), "loose").when(prose.isNotNull(), "prose").otherwise("none")
        return F.struct(F.coalesce(field, loose, prose).alias("verdict"), mode.alias("mode"))

    return let(bare, of)


def caption(value: Column, word: str = "表") -> Column:
    """(number, title) of a caption such as 表 3 title; null where it is none."""
    pattern = rf"(?s)^{word}\s*0*((?:[A-Za-z]\s*\.\s*)?\d+)(.*)$"
    t = F.trim(value)
    return F.when(t.rlike(pattern), F.struct(text.number_token(F.regexp_extract(t, pattern, 1)).alias("number"), F.trim(F.regexp_extract(t, pattern, 2)).alias("title")))


_VOLTAGE = r"(?i)^\s*\d+(?:\.\d+)?\s*(?:kV|V|MVA|kVA)\b"


def split_caption(number: Column, title: Column, greatest: Column) -> Column:
    """(number, title) where the digits of a number may hold the first ones of a title that leads with a
    voltage: 表110kV is table 1, 10 kV. ``greatest``: the greatest number so far, null at first. Of the ways
    to cut, the one that gives the next number is taken; else the first cut, if nothing came before or the
    whole number is more than five ahead."""
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(number) - 1, F.lit(1))), lambda i: F.struct(F.substr(number, F.lit(1), i).alias("number"), F.concat(F.substr(number, i + 1), title).alias("title"))), lambda c: c["title"].rlike(_VOLTAGE) & (F.length(c["number"]) < F.length(number)))
    whole = F.struct(number.alias("number"), title.alias("title"))

    def pick(cs: Column) -> Column:
        next_ = F.filter(F.concat(F.array(whole), cs), lambda c: c["number"].try_cast("int") == greatest + 1)
        ahead = greatest.isNull() | (number.try_cast("int") > greatest + 5)
        return F.when((F.size(cs) == 0) | ~number.rlike("^[0-9]+$"), whole).when(F.size(next_) > 0, F.try_element_at(next_, F.lit(1))).when(ahead, F.try_element_at(cs, F.lit(1))).otherwise(whole)

    return let(cuts, pick)


#: Marks of text in the wrong encoding (fixed values).
MOJIBAKE, REPLACED = "[ÃÂâæçèé]", "[ÃÂâæçèé\uFFFD]"


def repaired(value: Column) -> Column:
    """Text that was UTF-8 and was read as Latin-1, read again, where it has three marks or more and fewer marks
    and replacement characters after."""
    again = F.decode(F.encode(value, "ISO-8859-1"), "UTF-8")
    fits = ~value.rlike(r"[^\x00-\x{ff}]") & F.is_valid_utf8(F.encode(value, "ISO-8859-1").cast("string"))
    marks = lambda t: F.regexp_count(t, F.lit(REPLACED))
    return F.when((F.regexp_count(value, F.lit(MOJIBAKE)) >= 3) & fits, F.when(marks(again) < marks(value), again).otherwise(value)).otherwise(value)

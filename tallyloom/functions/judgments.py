"""Judgments: their own comparison checked, evidence selections validated, sample profiles filled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import direction
from .text import let

#: What a comparison may be and say (fixed values).
KINDS = ("exact", "upper_bound", "lower_bound", "tolerance", "range", "scope_count", "text")
OPERATORS = ("eq", "le", "lt", "ge", "gt", "range", "tolerance", "unknown", "")
#: Pieces of evidence that a selection may keep, and characters of a quote (fixed values).
MOST_RETAINED, QUOTE_CHARS = 8, 1600
#: Marks and prefixes of standards by rank (fixed values); what has none is 'other'.
SPECIFICATIONS = ("技术规范", "招标技术规范", "采购规范", "产品技术要求")
INDUSTRY = r"(?i)^(JB|DL|NB|HB|SH|SY|MT|YD|TB|CJ|JGJ|NY|HJ|HJ/T|NB/T|JB/T|DL/T)(/|$)"

#: A judgment as these functions take it; numbers are texts as the judge wrote them.
COMPARISON = "kind string, relation string, conclusion string, report_operator string, standard_operator string, report_value string, standard_value string, report_unit string, standard_unit string, report_scope string, standard_scope string, report_tolerance string, standard_tolerance string"


def _plain(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def first_number(text: Column) -> Column:
    found = F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"([-+]?\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def recomputed(c: Column) -> Column:
    """The relation that a comparison's own numbers have: 'equal', 'stricter', 'looser' or 'different'; null where
    they don't tell."""
    a, b = first_number(c["report_value"]), first_number(c["standard_value"])
    ta, tb = first_number(c["report_tolerance"]), first_number(c["standard_tolerance"])
    low = lambda f: F.lower(_plain(c[f]))
    units = (low("report_unit") == "") | (low("standard_unit") == "") | (low("report_unit") == low("standard_unit"))
    ways = [direction(low(f)) for f in ("report_operator", "standard_operator")]
    opposed = ways[0].isin("upper", "lower") & ways[1].isin("upper", "lower") & (ways[0] != ways[1])
    same = lambda x, y: F.abs(x - y) <= 1e-9
    scope = (low("report_scope") != "") & (low("report_scope") == low("standard_scope"))
    kind = _plain(c["kind"])
    beside = lambda inside: F.when(same(a, b), "equal").when(inside, "stricter").otherwise("looser")
    by_value = (
        F.when(F.coalesce(opposed, F.lit(False)), "different").when(kind == "exact", F.when(same(a, b), "equal").otherwise("different"))
        .when(kind == "scope_count", F.when(same(a, b) & scope, "equal").otherwise("different")).when(kind == "upper_bound", beside(a < b)).when(kind == "lower_bound", beside(a > b))
    )
    by_width = F.when(~same(a, b), "different").when(same(ta, tb), "equal").when(ta < tb, "stricter").otherwise("looser")
    known = a.isNotNull() & b.isNotNull() & units
    return F.when(known, F.when((kind == "tolerance") & ta.isNotNull() & tb.isNotNull(), by_width).otherwise(by_value))


def grounded(value: Column, unit: Column, texts: Column) -> Column:
    """Whether the value stands in one of the texts as a number of its own, with its unit within sixteen characters if
    it has one."""
    number = first_number(value)
    shown = F.regexp_replace(F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string")), r"([.+])", r"\\$1")
    word = F.regexp_replace(_plain(unit), r"([^\p{L}\p{N}\s])", r"\\$1")
    alone = F.concat(F.lit(r"(?<![\d.])"), shown, F.lit(r"(?![\d.])"))
    near = F.concat(F.lit("(?is)(?:"), shown, F.lit(r"\s*.{0,16}?"), word, F.lit("|"), word, F.lit(".{0,16}?"), shown, F.lit(")"))
    has = lambda t: F.regexp_like(t, alone) & ((word == "") | F.regexp_like(t, near))
    return F.coalesce(number.isNotNull() & F.exists(F.coalesce(texts, F.array().cast("array<string>")), has), F.lit(False))


def consistency_issues(status: Column, comparison: Column, evidence: Column) -> Column:
    """What a judgment's comparison has wrong, as an array of rule names in a fixed order: its relation is computed
    from its own operands and set against what it declares. A null comparison has no issue; one of an unknown kind, or
    a text comparison of numbers, that one alone. ``evidence``: the cited texts."""

    def of(x: Column) -> Column:
        c, computed = x["c"], x["computed"]
        status_, kind = x["status"], _plain(c["kind"])
        relation, conclusion = (F.when(_plain(c[f]) != "", _plain(c[f])).otherwise("unknown") for f in ("relation", "conclusion"))
        operator = lambda f: F.lower(_plain(c[f])).isin(*OPERATORS)
        a, b = first_number(c["report_value"]), first_number(c["standard_value"])
        ta, tb = first_number(c["report_tolerance"]), first_number(c["standard_tolerance"])
        off, supported, tolerance = computed.isin("different", "looser"), status_ == "supported", kind == "tolerance"
        fails_closed = (status_ == "mismatch") & (conclusion == "conflicts") & off & relation.isin("different", "looser")
        rules = {
            "invalid_report_operator": ~operator("report_operator"),
            "invalid_standard_operator": ~operator("standard_operator"),
            "conclusion_against_supported": supported & (conclusion == "conflicts"),
            "conclusion_against_mismatch": (status_ == "mismatch") & (conclusion == "supports"),
            "tolerance_without_nominals": tolerance & supported & (a.isNull() | b.isNull()),
            "tolerance_without_widths": tolerance & supported & (ta.isNull() | tb.isNull()),
            "nominal_not_in_evidence": tolerance & supported & ~grounded(c["standard_value"], c["standard_unit"], x["evidence"]),
            "relation_not_as_computed": computed.isNotNull() & ~relation.isin("unknown") & (relation != computed) & ~F.coalesce(fails_closed, F.lit(False)),
            "supports_what_is_off": off & (conclusion == "supports"),
            "conflicts_with_what_holds": computed.isin("equal", "stricter") & (conclusion == "conflicts"),
            "supported_but_off": supported & off,
        }
        found = F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda n: n.isNotNull())
        numeric = lambda f: _plain(c[f]).rlike(r"(?i)^[\s≤≥<>±+\-]?(?:\d|\.|\(|sqrt)")
        none = F.array().cast("array<string>")
        as_text = F.when(numeric("report_value") | numeric("standard_value"), F.array(F.lit("numbers_as_text"))).otherwise(none)
        return F.when(c.isNull(), none).when(~kind.isin(*KINDS), F.array(F.lit("invalid_kind"))).when(kind == "text", as_text).otherwise(found)

    return let(F.struct(_plain(status).alias("status"), comparison.alias("c"), recomputed(comparison).alias("computed"), evidence.alias("evidence")), of)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text_of(v: Column, path: str) -> Column:
    return _plain(F.try_variant_get(v, path, "string"))


def selection_state(raw: Column, sources: Column, most: int = MOST_RETAINED, chars: int = QUOTE_CHARS) -> Column:
    """An untrusted selection (JSON text) against its sources (array of key and text, those that may be kept):
    struct(ok, error, retained, unresolved, conflicts, sufficient, discarded).

    Kept are items whose key is a source's and whose quote, of at most ``chars``, stands in its text, each key and
    quote once; what is not kept is named in ``discarded`` by place and reason. A conflict counts among kept keys only.
    Output of another shape, too many items, none that holds, or a conflict over unknown keys is an error."""
    none = F.array().cast("array<string>")

    def items(v: Column) -> Column:
        key, quote = _text_of(v, "$.candidate_key"), _text_of(v, "$.quote")
        return F.struct(key.alias("key"), quote.alias("quote"), _text_of(v, "$.reason").alias("reason"), _is(v, "OBJECT").alias("object"))

    def checked(k: Column) -> Column:
        source = lambda i: F.filter(k["sources"], lambda s: s["key"] == i["key"])
        why = lambda i: (
            F.when(~i["object"], "is not an object").when(F.size(source(i)) == 0, "has unavailable candidate_key").when((i["quote"] == "") | (F.length(i["quote"]) > chars), "has invalid quote length")
            .when(~F.exists(source(i), lambda s: F.contains(F.coalesce(s["text"], F.lit("")), i["quote"])), "quote is not a source substring")
        )
        return F.transform(F.transform(k["list"], items), lambda i: F.struct(i.alias("item"), why(i).alias("why")))

    def state(k: Column) -> Column:
        seen = F.transform(F.filter(k["checked"], lambda x: x["why"].isNull()), lambda x: x["item"])
        kept = F.filter(seen, lambda x, i: F.array_position(F.transform(seen, lambda y: F.struct(y["key"], y["quote"])), F.struct(x["key"], x["quote"])) == i + 1)
        dropped = F.filter(F.transform(k["checked"], lambda x, i: F.when(x["why"].isNotNull(), F.concat(F.lit("retained["), i.cast("string"), F.lit("] "), x["why"]))), lambda d: d.isNotNull())
        return F.struct(k["v"].alias("v"), k["sources"].alias("sources"), k["list"].alias("list"), F.transform(kept, lambda x: F.struct(x["key"].alias("candidate_key"), x["quote"], x["reason"])).alias("kept"), dropped.alias("dropped"))

    def judged(k: Column) -> Column:
        v, keys = k["v"], F.transform(k["kept"], lambda x: x["candidate_key"])
        known = F.transform(k["sources"], lambda s: s["key"])
        unresolved = F.try_variant_get(v, "$.unresolved", "array<variant>")
        conflicts = F.try_variant_get(v, "$.conflicts", "array<variant>")
        named = lambda c: F.try_variant_get(c, "$.candidate_keys", "array<string>")
        bad = lambda c: ~_is(c, "OBJECT") | named(c).isNull() | F.exists(named(c), lambda x: ~F.coalesce(F.array_contains(known, x), F.lit(False)))
        among = lambda c: F.forall(named(c), lambda x: F.array_contains(keys, x))
        error = (
            F.when(~_is(v, "OBJECT") | v.isNull(), "selector output is not an object").when(k["list"].isNull(), "selector output has no retained array").when(F.size(k["list"]) > most, f"retained count exceeds {most}")
            .when((F.size(k["list"]) > 0) & (F.size(k["kept"]) == 0), "selector retained no grounded evidence")
            .when(unresolved.isNull() | F.exists(unresolved, lambda u: ~_is(u, "STRING")), "unresolved must be a string array").when(conflicts.isNull(), "conflicts must be an array")
            .when(F.exists(conflicts, bad), "conflicts has invalid candidate_keys")
        )

        def told(e: Column) -> Column:
            own = F.filter(F.transform(conflicts, lambda c: F.struct(named(c).alias("candidate_keys"), _text_of(c, "$.description").alias("description"), among(c).alias("among"))), lambda c: c["among"])
            loose = F.filter(F.transform(conflicts, lambda c, i: F.when(~among(c), F.concat(F.lit("conflicts["), i.cast("string"), F.lit("] dropped because its evidence was not retained")))), lambda d: d.isNotNull())
            early = e.isin("selector output is not an object", "selector output has no retained array", f"retained count exceeds {most}")
            ok = e.isNull()
            return F.struct(
                ok.alias("ok"), e.alias("error"), F.when(ok, k["kept"]).alias("retained"), F.when(ok, F.filter(F.transform(unresolved, lambda u: F.trim(F.try_variant_get(u, "$", "string"))), lambda u: u != "")).alias("unresolved"),
                F.when(ok, F.transform(own, lambda c: F.struct(c["candidate_keys"], c["description"]))).alias("conflicts"), F.when(ok, F.coalesce(F.try_variant_get(v, "$.evidence_sufficient", "boolean"), F.lit(False))).alias("sufficient"),
                F.when(F.coalesce(early, F.lit(False)), none).otherwise(F.concat(k["dropped"], F.when(ok, loose).otherwise(none))).alias("discarded"),
            )

        return let(error, told)

    first = F.struct(F.try_parse_json(raw).alias("v"), sources.alias("sources"))
    listed = lambda k: F.struct(k["v"].alias("v"), k["sources"].alias("sources"), F.try_variant_get(k["v"], "$.retained", "array<variant>").alias("list"))
    with_checks = lambda k: F.struct(k["v"].alias("v"), k["sources"].alias("sources"), k["list"].alias("list"), F.coalesce(checked(k), F.array().cast("array<struct<item:struct<key:string,quote:string,reason:string,object:boolean>,why:string>>")).alias("checked"))
    return let(let(let(let(first, listed), with_checks), state), judged)


def sample_profile(reported: Column, fills: Column, fields: Column, verified: Column) -> Column:
    """struct(effective, reported, evidence) of maps by key: what the report says, blanks filled from the decoded
    model among the schema's ``fields``, and for each key its value, source ('report_extraction', 'model_decode' or
    'missing') and verification. Keys that begin with _ are no parameters; a value is never replaced; every
    field is there, blank if nothing is known. ``verified``: keys whose quote was found."""
    no = F.create_map().cast("map<string,string>")

    def of(x: Column) -> Column:
        own, fill = x["own"], x["fill"]
        blank = lambda k: _plain(F.try_element_at(own, k)) == ""
        filled = F.map_filter(fill, lambda k, v: blank(k))
        keys = F.array_distinct(F.concat(F.map_keys(own), F.map_keys(filled), fields))
        value = lambda k: F.coalesce(F.try_element_at(filled, k), F.try_element_at(own, k), F.lit(""))
        as_map = lambda ks, f: F.map_from_entries(F.transform(ks, lambda k: F.struct(k, f(k))))
        inferred = lambda k: F.map_contains_key(filled, k)
        source = lambda k: F.when(inferred(k), "model_decode").when(value(k) != "", "report_extraction").otherwise("missing")
        sure = lambda k: F.when(inferred(k), "requires_review").when(F.array_contains(verified, k), "quote_verified").when(value(k) != "", "unverified").otherwise("missing")
        told = lambda k: F.struct(value(k).alias("value"), source(k).alias("source"), sure(k).alias("verification"))
        said = F.array_distinct(F.concat(F.map_keys(own), fields))
        return F.struct(as_map(keys, value).alias("effective"), as_map(said, lambda k: F.coalesce(F.try_element_at(own, k), F.lit(""))).alias("reported"), as_map(keys, told).alias("evidence"))

    own = F.map_filter(F.coalesce(reported, no), lambda k, v: (F.trim(k) != "") & ~F.trim(k).startswith("_"))
    fill = F.map_filter(F.coalesce(fills, no), lambda k, v: (_plain(v) != "") & ((F.size(fields) == 0) | F.array_contains(fields, F.trim(k))))
    clean = lambda m, trim: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.trim(e["key"]), F.trim(e["value"]) if trim else e["value"])))
    return let(F.struct(clean(own, False).alias("own"), clean(fill, True).alias("fill")), of)


def flattened(json: Column) -> Column:
    """The values of nested JSON in order, whatever their depth, with spaces between; keys are left out. A null is
    empty; what is no JSON is empty too."""
    token = r'"(?:[^"\\]|\\.)*"\s*:|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null'
    found = F.filter(F.regexp_extract_all(json, F.lit(token), F.lit(0)), lambda t: ~t.rlike(r'^".*:$'))
    shown = lambda t: F.when(t.startswith('"'), F.element_at(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 1)).when(t == "true", "True").when(t == "false", "False").when(t == "null", "").otherwise(t)
    return F.when(F.try_parse_json(json).isNotNull(), F.array_join(F.transform(found, shown), " ")).otherwise("")


#: Where lines end, and white space, of texts of any origin.
BREAKS, SPACES = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]", r"(?U)\s+"


def question_list(value: Column, most: int = 4, chars: int = 240, breaks: str = BREAKS, spaces: str = SPACES) -> Column:
    """Questions of a text, a line each: spaces joined, numbering left out, distinct, cut to ``chars``, ``most``."""
    line = lambda q: F.regexp_replace(F.regexp_replace(F.regexp_replace(q, spaces, " "), r"^\s*\d+[.、)]\s*", ""), r"^\p{Zs}+|\p{Zs}+$", "")
    found = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), breaks), line), lambda q: q != "")
    return F.slice(F.transform(F.array_distinct(found), lambda q: F.substring(q, 1, chars)), 1, most)


def standard_priority(number: Column, titles: Column) -> Column:
    """struct(rank, tier) of a source: specification, enterprise or industry, national, other."""
    no = F.upper(F.trim(F.coalesce(number, F.lit(""))))
    blob = F.concat(no, F.lit(" "), F.coalesce(titles, F.lit("")))
    tier = lambda r, t: F.struct(F.lit(r).alias("rank"), F.lit(t).alias("tier"))
    return F.when(blob.rlike("|".join(SPECIFICATIONS)), tier(1, "technical_spec")).when(no.rlike(r"^Q(/|\s*\d)") | no.rlike(INDUSTRY), tier(2, "enterprise_industry")).when(no.startswith("GB"), tier(3, "national")).otherwise(tier(4, "other"))


def evidence_card(candidate_key: Column, content_type: Column, standard_no: Column, titles: list[Column], text: Column, chunk_id: Column, roles: Column) -> Column:
    """The fixed columns of a candidate that a judge is shown; a blank id and empty roles are left null."""
    some = F.filter(roles, lambda r: F.coalesce(r, F.lit("")) != "")
    return F.struct(
        candidate_key.alias("candidate_key"), content_type.alias("content_type"), standard_no.alias("standard_no"), standard_priority(standard_no, F.concat_ws(" ", *titles)).alias("standard_priority"),
        text.alias("text"), F.when(_plain(chunk_id) != "", _plain(chunk_id)).alias("chunk_id"), F.when(F.size(some) > 0, some).alias("evidence_roles"),
    )

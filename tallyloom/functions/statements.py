"""Statements as claims: property, value, unit, comparator, scope, and how two claims compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import claims, text
from .text import let

_NUMBER = r"[-+]?\d+(?:[.,]\d+)?"
_HAN = r"\x{4e00}-\x{9fff}"
#: Words of a prescription, and what fills the field of a unit where there is none (fixed values).
PRESCRIBED, NO_UNIT = "应为|为|等于", ("", "/", "-", "—", "–", "无", "n/a", "na")
#: Words by which a text is evidence of a kind, in the order the kinds are reported (fixed values).
ROLES = {
    "nominal_rule": "应|应该|应当|不得|不应|至少|至多|必须|允许|限值|额定|规定",
    "tolerance_rule": "±|偏差|公差|容差|允许范围",
    "method_rule": "方法|程序|步骤|测量|施加|记录|进行|按照|依次",
    "applicability_rule": "如果|当|在.+?时|对于|适用|除非|取决于|条件|范围",
}
#: Signs of a constraint between its field and value (fixed values).
SIGNS = "<=|>=|≤|≥|<|>|=|等于|不大于|不小于|不超过|至少"
#: A field, a sign and a number; an entity of a scope; totals and counts for each (fixed patterns).
_CONSTRAINT = rf"(?i)([A-Za-z_][A-Za-z0-9_]*|[{_HAN}]{{2,20}})\s*({SIGNS})\s*({_NUMBER})\s*([A-Za-zμ%]+)?"
_ENTITY = rf"[{_HAN}A-Za-z][{_HAN}A-Za-z_-]{{0,15}}"
_SCOPE = rf"(?:总(?:计|共|数|数量|次数)?|共)\s*\d+(?:\.\d+)?|(?:每|各)\s*{_ENTITY}(?:\s*\d+(?:\.\d+)?)?"


def statement(value: Column) -> Column:
    """Plain text of a statement; equation tags leave no space."""
    return text.plain(F.regexp_replace(value, r"(?i)</?eq\b[^>]*>", ""))


def value_kind(value: Column) -> Column:
    """'expression', 'enum', 'range', 'quantity' or 'text' of a value in plain text."""
    several = (F.size(claims.numbers(value)) >= 2) & value.rlike("[≤<≥>]")
    return (
        F.when(value.rlike("[A-Za-z]") & value.rlike("[+*×÷/()]") | value.rlike("√.*[+*×÷/()]|[+*×÷/()].*√"), "expression").when(value.rlike(r"^[A-Za-z][A-Za-z0-9_.-]*$"), "enum")
        .when(value.rlike(_NUMBER), F.when(value.rlike("至|到|~|～") | several, "range").otherwise("quantity")).otherwise("text")
    )


def unit_in(value: Column) -> Column:
    """The first unit in a text, in lower case; else null."""
    return F.nullif(F.regexp_extract(F.lower(value), f"({text.UNIT_WORDS})", 1), F.lit(""))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, "^[ ，,。;]+|[ ，,。;]+$", "")


def scope(value: Column) -> Column:
    """(basis, totals, per): counts in all, and entities that a count is meant for each of."""
    found = F.regexp_extract_all(statement(value), F.lit(_SCOPE), F.lit(0))

    def sorted_out(ms: Column) -> Column:
        each = lambda m: m.rlike("^[每各]")
        totals = F.transform(F.filter(ms, lambda m: ~each(m)), lambda m: F.regexp_extract(m, r"(\d+(?:\.\d+)?)$", 1).cast("double"))
        per = F.transform(F.filter(ms, each), lambda m: F.struct(F.regexp_extract(m, rf"^[每各]\s*({_ENTITY})", 1).alias("entity"), F.nullif(F.regexp_extract(m, r"(\d+(?:\.\d+)?)$", 1), F.lit("")).cast("double").alias("count")))
        some = lambda a: F.size(a) > 0
        basis = F.when(some(totals) & some(per), "mixed").when(some(totals), "total").when(some(per), "per_entity").otherwise("unknown")
        return F.struct(basis.alias("basis"), totals.alias("totals"), per.alias("per"))

    return let(found, sorted_out)


def constraints(value: Column) -> Column:
    """Explicit predicates in a text: (field, operator, value, unit, source) each."""
    part = lambda m, i: F.regexp_extract(m, _CONSTRAINT, i)
    row = lambda m: F.struct(
        part(m, 1).alias("field"), claims.comparator(part(m, 2)).alias("operator"), F.replace(part(m, 3), F.lit(","), F.lit(".")).cast("double").alias("value"),
        F.nullif(F.lower(part(m, 4)), F.lit("")).alias("unit"), m.alias("source"),
    )
    return F.transform(F.regexp_extract_all(statement(value), F.lit(_CONSTRAINT), F.lit(0)), row)


def _claim(prop: Column, value: Column, whole: Column, operator: Column) -> Column:
    return F.struct(
        prop.alias("property"), value.alias("raw"), value_kind(value).alias("kind"), claims.numbers(value).alias("numbers"),
        F.coalesce(unit_in(value), unit_in(whole)).alias("unit"), operator.alias("operator"),
    )


#: What is before and after a colon, or a word of prescription (fixed patterns).
_AFTER_COLON, _AFTER_WORD = r"(?s)^([^:：]*)[:：]\s*(.+)$", rf"^(.{{1,120}}?)(?:{PRESCRIBED})\s*(.+)$"


def claim(value: Column) -> Column:
    """A statement as (property, raw, kind, numbers, unit, operator): what is before a colon or a word of
    prescription, and what is after it. Without either all of it is the property."""

    def split(p: Column) -> Column:
        pattern = F.when(p.rlike(_AFTER_COLON), 1).when(p.rlike(_AFTER_WORD), 2)
        side = lambda i: F.when(pattern == 1, F.regexp_extract(p, _AFTER_COLON, i)).when(pattern == 2, F.regexp_extract(p, _AFTER_WORD, i))
        raw = F.coalesce(F.trim(side(2)), F.lit(""))
        return _claim(F.coalesce(trimmed(side(1)), p), raw, p, claims.comparator(raw))

    return let(statement(value), split)


def requirement(value: Column, unit: Column, project: Column) -> Column:
    """A requirement as (claim, split, ready, reason). The property is looked for before a colon, before a word
    of prescription with a structured value, and in the field of a constraint; else it is the project's
    name. A unit given beside the text counts where the text has none. A claim is ready to be compared if
    it is one number, or a label."""

    def split(p: Column) -> Column:
        word = F.trim(F.regexp_extract(p, _AFTER_WORD, 2))
        structured = word.rlike(_NUMBER) | (value_kind(word) == "enum")
        name = F.coalesce(text.plain(project), F.lit(""))
        valued = p.rlike(_NUMBER) | (claims.comparator(p) != "eq")
        how = (
            F.when(p.rlike(_AFTER_COLON), "separator").when(p.rlike(_AFTER_WORD) & structured, "prescribed").when(p.rlike(_CONSTRAINT), "constraint")
            .when(valued & (name != ""), "project_and_text").when(valued, "value_only").when(name != "", "unstructured_with_project").otherwise("unparsed")
        )
        return F.struct(p.alias("p"), how.alias("how"), name.alias("name"))

    def cut(s: Column) -> Column:
        p, how = s["p"], s["how"]
        found = lambda i: F.regexp_extract(p, _CONSTRAINT, i)
        rest = F.trim(F.substr(p, F.instr(p, found(0)) + F.length(found(1))))
        prop = F.when(how == "separator", trimmed(F.regexp_extract(p, _AFTER_COLON, 1))).when(how == "prescribed", trimmed(F.regexp_extract(p, _AFTER_WORD, 1))).when(how == "constraint", found(1)).when(how == "value_only", "").when(how == "unparsed", p).otherwise(s["name"])
        raw = F.when(how == "separator", F.trim(F.regexp_extract(p, _AFTER_COLON, 2))).when(how == "prescribed", F.trim(F.regexp_extract(p, _AFTER_WORD, 2))).when(how == "constraint", rest).otherwise(p)
        return F.struct(how.alias("how"), prop.alias("prop"), raw.alias("raw"), p.alias("p"))

    def judged(x: Column) -> Column:
        made = _claim(x["prop"], x["raw"], x["p"], claims.comparator(F.when(x["raw"] != "", x["raw"]).otherwise(x["p"])))
        given = F.when(~F.lower(F.trim(F.coalesce(unit, F.lit("")))).isin(*NO_UNIT), unit_in(unit))
        whole = lambda c, reason: F.struct(c.withField("unit", F.coalesce(c["unit"], given)).alias("claim"), x["how"].alias("split"), reason.isin("scalar_quantity", "categorical").alias("ready"), reason.alias("reason"))
        return let(let(made, lambda c: F.struct(c.alias("c"), readiness(c).alias("reason"))), lambda k: whole(k["c"], k["reason"]))

    return let(let(let(statement(value), split), cut), judged)


def readiness(c: Column) -> Column:
    """Why a claim can or can't be compared by program."""
    n = F.size(c["numbers"])
    return (
        F.when(c["kind"] == "expression", "expression")
        .when(c["kind"].isin("quantity", "range"), F.when(n == 1, "scalar_quantity").when(n > 1, "multiple_numbers").otherwise("missing_number"))
        .when((c["kind"] == "enum") & (c["raw"] != "") | (c["kind"] == "text") & c["raw"].rlike(r"^[A-Za-z0-9_.+-]+$"), "categorical").otherwise("unstructured_text")
    )


def direction(operator: Column) -> Column:
    return F.when(operator.isin("le", "lt"), "upper").when(operator.isin("ge", "gt"), "lower").when(operator == "eq", "exact")


def compared(report: Column, evidence: Column, least_similarity: float = 0.35) -> Column:
    """(relation, tightness, reason) of two claims. Properties must be alike and units convertible; labels are
    equal or different; of two numbers, a bound on one side applies to an exact value on the other, and
    bounds of different directions are in conflict."""
    say = lambda relation, tightness, reason=None: F.struct(F.lit(relation).alias("relation"), F.lit(tightness).alias("tightness"), F.lit(reason).cast("string").alias("reason"))
    one_sided = lambda d: d.isin("upper", "lower")

    def measured(x: Column) -> Column:
        a, b = x["a"], x["b"]
        number = lambda c: F.try_element_at(c["numbers"], F.lit(1))
        return F.struct(
            a.alias("a"), b.alias("b"), text.concept_similarity(a["property"], b["property"]).alias("similarity"), claims.unit_alignment(a["unit"], b["unit"]).alias("units"),
            number(a).alias("x"), number(b).alias("y"), claims.in_base(number(a), a["unit"]).alias("base_x"), claims.in_base(number(b), b["unit"]).alias("base_y"),
            direction(a["operator"]).alias("da"), direction(b["operator"]).alias("db"),
        )

    def scaled(m: Column) -> Column:
        side = lambda c: F.when(m["units"] == "converted", m[f"base_{c}"]).otherwise(m[c])
        operator = F.when((m["db"] == "exact") & one_sided(m["da"]), m["a"]["operator"]).otherwise(m["b"]["operator"])
        opposed = (m["da"] != m["db"]) & ~((m["da"] == "exact") & one_sided(m["db"])) & ~((m["db"] == "exact") & one_sided(m["da"]))
        return let(F.struct(m.alias("m"), side("x").alias("x"), side("y").alias("y"), operator.alias("operator"), opposed.alias("opposed")), judged)

    def judged(j: Column) -> Column:
        m, tight = j["m"], claims.bound_tightness(j["x"], j["y"], j["operator"])
        label = lambda c: c["kind"].isin("enum", "text")
        bounded = j["operator"].isin("le", "lt", "ge", "gt")
        relation = lambda t: F.when(bounded, F.when(t.isin("equal", "stricter"), "supports").otherwise("conflicts")).otherwise(F.when(t == "equal", "equal").otherwise("different"))
        return (
            F.when(m["similarity"] < least_similarity, say("not_comparable", "not_comparable", "property_not_bound"))
            .when(label(m["a"]) | label(m["b"]), F.when(text.concept(m["a"]["raw"]) == text.concept(m["b"]["raw"]), say("equal", "equal")).otherwise(say("different", "different")))
            .when(m["units"] == "unavailable", say("not_comparable", "not_comparable", "unit_conversion_unavailable"))
            .when((F.size(m["a"]["numbers"]) != 1) | (F.size(m["b"]["numbers"]) != 1), say("not_comparable", "not_comparable", "non_scalar_or_ambiguous"))
            .when(j["opposed"], say("conflicts", "different", "operator_direction_conflict"))
            .otherwise(let(tight, lambda t: F.struct(relation(t).alias("relation"), t.alias("tightness"), F.lit(None).cast("string").alias("reason"))))
        )

    return let(let(F.struct(report.alias("a"), evidence.alias("b")), measured), scaled)


def categorical(report: Column, standard: Column) -> Column:
    """(relation, reason) of two labels; one that holds the other is ambiguous."""
    bare = lambda c: F.replace(F.lower(statement(c)), F.lit(" "), F.lit(""))
    say = lambda relation, reason=None: F.struct(F.lit(relation).cast("string").alias("relation"), F.lit(reason).cast("string").alias("reason"))

    def told(x: Column) -> Column:
        a, b = x["a"], x["b"]
        none = a.isNull() | b.isNull() | (a == "") | (b == "")
        return F.when(none, say(None, "categorical_value_missing")).when(a == b, say("equal")).when(F.contains(a, b) | F.contains(b, a), say(None, "categorical_enumeration_ambiguous")).otherwise(say("different"))

    return let(F.struct(bare(report).alias("a"), bare(standard).alias("b")), told)


def evidence_roles(value: Column, is_table: Column) -> Column:
    """Kinds of evidence a text is; a table states nominal values, and what shows no kind is a method."""


    def of(plain: Column) -> Column:
        has = {role: plain.rlike(words) for role, words in ROLES.items()}
        has["nominal_rule"] = has["nominal_rule"] | is_table
        return F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in has.items()]), lambda r: r.isNotNull())

    return let(let(statement(value), of), lambda roles: F.when(F.size(roles) > 0, roles).otherwise(F.array(F.lit("method_rule"))))


def header_similarity(prop: Column, header: Column) -> Column:
    """How well a column's header names a property. A header of two letters or fewer, beside its unit, counts
    only where the property has it in brackets."""
    core = F.regexp_replace(text.concept(header), text.UNIT_WORDS, "")
    token = F.regexp_replace(text.plain(F.regexp_replace(header, f"(?i){text.UNIT_WORDS}", "")), "^[ /]+|[ /]+$", "")
    plain = F.translate(text.plain(prop), "（）", "()")
    qualified = F.when((token != "") & F.contains(plain, F.concat(F.lit("("), token, F.lit(")"))), 1.0).otherwise(0.0)
    return F.when((text.plain(prop) == "") | (text.plain(header) == ""), 0.0).when(F.length(core) <= 2, qualified).otherwise(text.concept_similarity(prop, header))


def cell_match(cell: Column, target: Column) -> Column:
    """'exact' where a cell states the target, 'range' where its bound or range holds it, else null."""

    def of(c: Column) -> Column:
        values, op = c["values"], c["op"]
        first, pair = F.try_element_at(values, F.lit(1)), F.array_sort(F.slice(values, 1, 2))
        stated = F.exists(values, lambda v: F.abs(v - target) <= F.greatest(F.lit(1e-6), F.abs(target) * 1e-4))
        held = (
            F.when(op == "le", target <= first + 1e-9).when(op == "lt", target < first).when(op == "ge", target >= first - 1e-9).when(op == "gt", target > first)
            .when((op == "between") & (F.size(values) >= 2), (target >= F.element_at(pair, 1) - 1e-9) & (target <= F.element_at(pair, -1) + 1e-9)).otherwise(stated)
        )
        return F.when(F.size(values) == 0, F.lit(None)).when((op == "eq") & stated, "exact").when(held, "range")

    return let(let(statement(cell), lambda p: F.struct(claims.numbers(p).alias("values"), claims.comparator(p).alias("op"))), of)

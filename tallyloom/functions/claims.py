"""Numbers, units, bounds, intervals and verdicts as column expressions with three-valued logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import close, interval, plain_expression  # noqa: F401

#: Unit, base unit and scale (fixed values).
UNITS = {
    "w": ("w", 1.0), "kw": ("w", 1e3), "mw": ("w", 1e6), "va": ("va", 1.0), "kva": ("va", 1e3), "mva": ("va", 1e6), "v": ("v", 1.0), "kv": ("v", 1e3), "a": ("a", 1.0), "ka": ("a", 1e3), "ma": ("a", 1e-3),
    "hz": ("hz", 1.0), "khz": ("hz", 1e3), "mhz": ("hz", 1e6), "s": ("s", 1.0), "ms": ("s", 1e-3), "us": ("s", 1e-6), "μs": ("s", 1e-6), "%": ("ratio", 0.01), "db": ("db", 1.0), "dba": ("db", 1.0),
}
#: Signs of units that are shown in several ways (fixed values).
UNIT_VARIANTS = (("℃", "c"), ("°c", "c"), ("㎡", "m2"), ("ω", "ohm"), ("μ", "u"), ("µ", "u"))


def numbers(text: Column) -> Column:
    """All numbers; spaces before groups of three digits are left out and a decimal comma is a point."""
    tight = F.regexp_replace(text, r"(?<=\d)\s+(?=\d{3}(?:\D|$))", "")
    return F.transform(F.regexp_extract_all(tight, F.lit(r"[-+]?\d+(?:[.,]\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))


#: Signs and words of comparisons, looked for in this order (fixed values).
COMPARATORS = (("le", "≤|<=|不大于|不应超过"), ("ge", "≥|>=|不小于|不低于"), ("lt", "<"), ("gt", ">"), ("between", "至|到|~|～"))


def comparator(text: Column) -> Column:
    """'le', 'ge', 'lt', 'gt', 'between' or 'eq'."""
    out = F.lit("eq")
    for name, signs in reversed(COMPARATORS):
        out = F.when(text.rlike(signs), name).otherwise(out)
    return out


def _unit_map(i: int) -> Column:
    return F.create_map(*[F.lit(x) for u, v in UNITS.items() for x in (u, v[i])])


def folded_unit(unit: Column) -> Column:
    """A unit in lower case without spaces and brackets, its display variants made one."""
    out = F.regexp_replace(F.lower(plain_expression(unit)), r"[ \[\](){}]", "")
    for shown, meant in UNIT_VARIANTS:
        out = F.replace(out, F.lit(shown), F.lit(meant))
    return out


def base_unit(unit: Column) -> Column:
    return F.try_element_at(_unit_map(0), folded_unit(unit))


def unit_scale(unit: Column) -> Column:
    return F.try_element_at(_unit_map(1), folded_unit(unit))


def unit_alignment(a: Column, b: Column) -> Column:
    """'unitless', 'one_sided', 'same', 'converted' or 'unavailable'."""
    none = lambda u: u.isNull() | (F.trim(u) == "")
    return (
        F.when(none(a) & none(b), "unitless").when(none(a) | none(b), "one_sided").when(folded_unit(a) == folded_unit(b), "same")
        .when(base_unit(a) == base_unit(b), "converted").otherwise("unavailable")
    )


def in_base(value: Column, unit: Column) -> Column:
    return value * F.coalesce(unit_scale(unit), F.lit(1.0))


def tolerance(x: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.abs(x) * 1e-4)


def near(a: Column, b: Column) -> Column:
    """Equal within 1e-6 or one part in ten thousand; an infinite end is near none."""
    return (F.abs(a - b) < float("inf")) & (F.abs(a - b) <= F.greatest(F.lit(1e-6), F.greatest(F.abs(a), F.abs(b)) * 1e-4))


def bound_tightness(report: Column, standard: Column, operator: Column) -> Column:
    """How a reported bound stands to the standard's: 'equal' (to one part in 10^9), 'stricter', 'looser' or
    'different'. Strict comparisons are never equal, and an equal value is outside of them."""
    same = F.abs(report - standard) <= F.greatest(F.lit(1e-12), F.greatest(F.abs(report), F.abs(standard)) * 1e-9)
    low, high = operator.isin("le", "lt"), operator.isin("ge", "gt")
    return (
        F.when(~operator.isin("lt", "gt") & same, "equal").when(low & (report < standard) | high & (report > standard), "stricter")
        .when(low | high, "looser").otherwise("different")
    )


def interval_relation(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """'equal', 'subset', 'disjoint', 'superset' or 'overlap' of a to b; a null end is open."""
    inf = float("inf")
    # As displayed: the standard's end says how near is near.
    la, ha, lb, hb = F.coalesce(low_a, F.lit(-inf)), F.coalesce(high_a, F.lit(inf)), F.coalesce(low_b, F.lit(-inf)), F.coalesce(high_b, F.lit(inf))
    tl, th = F.when(F.abs(lb) == inf, 0.0).otherwise(tolerance(lb)), F.when(F.abs(hb) == inf, 0.0).otherwise(tolerance(hb))
    return (
        F.when(close(la, lb) & close(ha, hb), "equal").when((la >= lb - tl) & (ha <= hb + th), "subset").when((ha < lb - tl) | (la > hb + th), "disjoint")
        .when((la <= lb + tl) & (ha >= hb - th), "superset").otherwise("overlap")
    )


def constraint_state(value: Column, operator: Column, bound: Column) -> Column:
    """'satisfied', 'failed', or 'unresolved' where the value is unknown."""
    ok = (
        F.when(operator == "le", value <= bound).when(operator == "ge", value >= bound).when(operator == "lt", value < bound)
        .when(operator == "gt", value > bound).otherwise(near(value, bound))
    )
    return F.when(ok.isNull(), "unresolved").when(ok, "satisfied").otherwise("failed")


def applicability(states: Column) -> Column:
    """Of an array of states: any unresolved, else any failed, else applicable."""
    return F.when(F.array_contains(states, "unresolved"), "unresolved").when(F.array_contains(states, "failed"), "not_applicable").otherwise("applicable")


def scalar_verdict(report: Column, report_unit: Column, standard: Column, standard_unit: Column, operator: Column) -> Column:
    """(verdict, kind): units first, then equality, direction, and errors by powers of ten."""
    how = unit_alignment(report_unit, standard_unit)
    a, b = in_base(report, report_unit), in_base(standard, standard_unit)
    tight = bound_tightness(a, b, operator)
    say = lambda v, k: F.struct(F.lit(v).alias("verdict"), k.alias("kind") if isinstance(k, Column) else F.lit(k).alias("kind"))
    ratio = F.when((a != 0) & (b != 0), F.abs(a / b))
    tenfold = (ratio >= 10) | (ratio <= 0.1)
    return (
        F.when(report.isNull() | standard.isNull(), say("unevaluable", "missing_value")).when(how == "unavailable", say("unevaluable", "unit_mismatch"))
        .when(near(a, b) & (how == "converted"), say("match", "unit_equivalent")).when(near(a, b), say("match", "equal"))
        .when(tight == "stricter", say("match", "within_standard")).when(tenfold, say("mismatch", "magnitude_error")).otherwise(say("mismatch", "numeric_looser"))
    )


#: What each verdict is reported as (fixed values).
REPORTED = {"match": "supported", "mismatch": "mismatch", "unevaluable": "insufficient_context", "out_of_scope": "not_audited"}


def reported(verdict: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in REPORTED.items() for x in p]), verdict)

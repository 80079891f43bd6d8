"""Claimed values as intervals, read from tokens, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Display variants of signs and brackets (fixed values).
VARIANTS, PLAIN = "（）％＋－−﹣～，≦≧", "()%+---~,≤≥"
#: A standard's designation, whose digits are no claimed value (a fixed pattern).
DESIGNATION = r"(?i)[A-Z]{2,}(?:/[A-Z]+)?\s*\d+(?:\.\d+)*(?:\s*[-—]\s*\d{4})?"
#: Forms whose sign may be a convention of polarity, and those with a nominal value in the middle (fixed names).
BANDS = ("relative_symmetric", "absolute_symmetric")
MIRRORED = (*BANDS, "range", "scalar")
#: What a token is in a text's shape: its letter and pattern.
_TOKENS = (("S", r"[-+]\d+(?:\.\d+)?"), ("1", r"1(?![\d.])"), ("N", r"\d+(?:\.\d+)?"), ("r", "~|至|到"), ("l", "[≤<]"), ("g", "[≥>]"), ("p", "±"), ("+", r"\+"), ("-", "-"), ("%", "%"), ("(", r"\("), (")", r"\)"), ("w", r"[^\s\d±+\-%()~≤<≥>至到]+"))
_ANY = "|".join(p for _, p in _TOKENS)
_V = "[SN1]"
#: Shapes in the order they are looked for. Between ends: what is no number and no sign of comparison.
SHAPES = (
    ("two_sided_comparator", rf"{_V}l[^SN1lg]*l{_V}"),
    ("relative_symmetric", rf"{_V}\(1p{_V}%\)"),
    ("relative_one_sided", rf"{_V}\([^()]*?(?:S|[-+]{_V})%[^()]*\)"),
    ("relative_symmetric", rf"{_V}p{_V}%"),
    ("absolute_symmetric", rf"{_V}p{_V}"),
    ("range", rf"{_V}[u%]{{0,2}}r{_V}"),
)

def _none() -> Column:
    return F.lit(None).cast("double")


def make(low: Column | None, high: Column | None, form: str, center: Column | None = None) -> Column:
    d = lambda c: _none() if c is None else c.cast("double")
    return F.struct(d(low).alias("low"), d(high).alias("high"), F.lit(form).alias("form"), d(center).alias("center"))


def plain_expression(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(raw, VARIANTS, PLAIN), "<=", "≤"), ">=", "≥")


def _letter(token: Column) -> Column:
    out = F.lit("w")
    for letter, pattern in reversed(_TOKENS[:-1]):
        out = F.when(token.rlike(f"^(?:{pattern})$"), letter).otherwise(out)
    return F.when(token.rlike("^[A-Za-zμΩ°]{1,4}$"), "u").otherwise(out)  # a unit, which may stand between the ends of a range


def _signed(tokens: Column, shape: Column) -> Column:
    """The numbers of a stretch of tokens; a sign on its own goes with the number after it."""
    at = F.filter(F.sequence(F.lit(1), F.length(shape)), lambda i: F.substring(shape, i, F.lit(1)).isin("S", "N", "1"))
    sign = lambda i: F.when((i > 1) & (F.substring(shape, i - 1, F.lit(1)) == "-"), -1.0).otherwise(1.0)
    return F.transform(at, lambda i: sign(i) * F.element_at(tokens, i.cast("int")).cast("double"))


def interval(raw: Column, operator: Column | None = None) -> Column:
    """A claimed value as (low, high, form, center), or null where there is no one number.

    The text is cut into tokens - numbers, signs, brackets, words - whose letters are its shape. The first of SHAPES
    that the shape has decides the form, and the numbers are those of its tokens: a two-sided comparison, a share
    around or beside a base, a deviation, a range. Otherwise a single number is a bound or a scalar, as the comparison
    says. Numbers of designations of standards count for nothing."""
    from .claims import comparator, numbers

    op = comparator(raw) if operator is None else F.coalesce(operator, comparator(raw))

    def of_shape(form: Column, ns: Column, part: Column, o: Column) -> Column:
        first, last = F.element_at(ns, 1), F.element_at(ns, -1)
        # Of a base and a share in brackets the share is before the percent sign, and its sign tells the side.
        share = F.element_at(ns, F.greatest(F.size(F.filter(F.split(F.regexp_extract(part, r"^.*?%", 0), ""), lambda c: c.isin("S", "N", "1"))), F.lit(1)))
        span = F.abs(first) * F.abs(F.when(form == 2, last).when(form == 3, share).otherwise(last)) / 100
        up = F.when(form == 3, share > 0)
        limit = F.when(up, first + span).otherwise(first - span)
        beside = F.when(up, make(F.when(~o.isin("le", "lt"), F.least(first, limit)), limit, "relative_one_sided", first)).otherwise(make(limit, F.when(~o.isin("ge", "gt"), F.greatest(first, limit)), "relative_one_sided", first))
        around = lambda d, name: make(first - d, first + d, name, first)
        ends = lambda name: make(F.least(first, last), F.greatest(first, last), name)
        return F.when(form == 1, ends("two_sided_comparator")).when(form == 6, ends("range")).when(form == 3, beside).when(form == 5, around(F.abs(last), "absolute_symmetric")).otherwise(around(span, "relative_symmetric"))

    def of_number(text: Column, o: Column) -> Column:
        bound = lambda v: F.when(o.isin("le", "lt"), make(None, v, "bound")).when(o.isin("ge", "gt"), make(v, None, "bound")).otherwise(make(v, v, "scalar", v))
        return let(F.array_distinct(F.transform(numbers(text), lambda n: F.round(n, 9))), lambda vs: F.when(F.size(vs) == 1, bound(F.element_at(vs, 1))))

    def of_text(r: Column) -> Column:
        def of_tokens(x: Column) -> Column:
            tokens, shape = x["tokens"], x["shape"]
            parts = F.array(*[F.regexp_extract(shape, f"({p})", 1) for _, p in SHAPES])

            def found(ms: Column) -> Column:
                which = F.array_position(F.transform(ms, lambda m: m != ""), True)
                part = F.element_at(ms, F.greatest(which, F.lit(1)).cast("int"))
                own = lambda k: F.slice(tokens, F.position(k["p"], shape), F.length(k["p"]))
                return F.when(which > 0, let(F.struct(which.cast("int").alias("i"), part.alias("p")), lambda k: let(_signed(own(k), k["p"]), lambda ns: of_shape(k["i"], ns, k["p"], r["op"]))))

            return let(parts, lambda ms: F.coalesce(found(ms), of_number(r["text"], r["op"])))

        tokens = F.regexp_extract_all(r["text"], F.lit(_ANY), F.lit(0))
        return let(let(tokens, lambda ts: F.struct(ts.alias("tokens"), F.array_join(F.transform(ts, _letter), "").alias("shape"))), of_tokens)

    text = F.regexp_replace(plain_expression(raw), DESIGNATION, " ")
    return F.when(F.trim(raw) != "", let(F.struct(text.alias("text"), op.alias("op")), of_text))


def close(a: Column, b: Column) -> Column:
    """Equal to what is displayed of b: within 1e-6 or one part in ten thousand; open ends only to themselves."""
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    return F.when(infinite, a == b).otherwise(F.abs(a - b) <= F.greatest(F.lit(1e-6), F.abs(b) * 1e-4))


def midpoint(i: Column) -> Column:
    return F.coalesce(i["center"], (i["low"] + i["high"]) / 2, i["low"], i["high"])


def recorded(value: Column, tolerance: Column, operator: Column) -> Column:
    """A recorded value with its recorded tolerance, '+30%', '±0.5' or '3', as an interval: both ways without a sign,
    and of a bound the end that it has. Null where the tolerance holds no number."""
    text = plain_expression(tolerance)
    size, percent = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), text.rlike(r"\d\s*%")
    sign = F.regexp_extract(text, r"([-+±])\s*\d", 1)
    span = F.when(percent, F.abs(value) * size.try_cast("double") / 100).otherwise(size.try_cast("double"))

    def ends(d: Column) -> Column:
        low, high = F.when(sign == "+", value).otherwise(value - d), F.when(sign == "-", value).otherwise(value + d)
        return F.when(operator.isin("le", "lt"), make(None, high, "bound_with_tolerance", value)).when(operator.isin("ge", "gt"), make(low, None, "bound_with_tolerance", value)).otherwise(make(low, high, "absolute_symmetric", value))

    return F.when((size != "") & value.isNotNull(), let(span, ends))


def is_range_form(i: Column) -> Column:
    return F.coalesce(~i["form"].isin("bound", "scalar"), F.lit(False))


def standard_interval(raw: Column, numeric: Column, tolerance: Column, operator: Column) -> Column:
    """What a standard records as an interval: its text and tolerance, else its number; a tolerance that the text
    doesn't show widens the number."""
    said = F.concat_ws(" ", F.when(F.trim(raw) != "", raw), F.when(F.trim(tolerance) != "", tolerance))
    read = F.coalesce(interval(said, operator), F.when(numeric.isNotNull(), interval(numeric.cast("string"), F.coalesce(operator, F.lit("eq")))))
    return let(read, lambda i: F.when((F.trim(tolerance) != "") & numeric.isNotNull() & ~is_range_form(i), F.coalesce(recorded(numeric, tolerance, operator), i)).otherwise(i))


def direction(operator: Column) -> Column:
    return F.when(operator.isin("le", "lt"), "upper").when(operator.isin("ge", "gt"), "lower").when(operator == "eq", "exact")


def magnitude(a: Column, b: Column) -> Column:
    """How far apart two numbers are: as displayed, by ten times or more, or other."""
    ratio = F.abs(a) / F.abs(b)
    return F.when(close(a, b), "within_display_tolerance").when((a == 0) | (b == 0), "other").when((ratio >= 10) | (ratio <= 0.1), "magnitude").otherwise("other")


def scaled(i: Column, scale: Column) -> Column:
    return F.when(i.isNotNull(), F.struct((i["low"] * scale).alias("low"), (i["high"] * scale).alias("high"), i["form"].alias("form"), (i["center"] * scale).alias("center")))


def _bounded(i: Column, way: Column) -> Column:
    return F.struct(F.when(way == "lower", i["center"]).alias("low"), F.when(way == "upper", i["center"]).alias("high"), F.lit("bound").alias("form"), i["center"].alias("center"))


def _mirror(i: Column) -> Column:
    return F.struct((-i["high"]).alias("low"), (-i["low"]).alias("high"), i["form"].alias("form"), (-i["center"]).alias("center"))


def compare_intervals(left: Column, right: Column, left_operator: Column, right_operator: Column, tolerance_recorded: Column, left_scale: Column | None = None, right_scale: Column | None = None) -> Column:
    """How a reported interval stands to the standard's: relation ('equal', 'supports', 'conflicts', 'different' or
    'not_comparable'), tightness, interval_relation, center_relation, delta, band_decides, direction_resolved,
    polarity_normalized and reason.

    - A band around exactly the recorded limit, with no tolerance recorded, is not comparable.
    - A single number without direction takes the other side's: as a bound it no longer looks disjoint.
    - A negative band meets an unsigned one as its mirror image.
    - Of two bands the nominal values come first; then sets decide."""
    from .claims import interval_relation

    one = F.lit(1.0)
    ld, rd = direction(left_operator), direction(right_operator)
    ways = lambda d: d.isin("upper", "lower")

    def lined_up(x: Column) -> Column:
        l, r = x["l"], x["r"]  # noqa: E741
        to_right = (r["form"] == "scalar") & (rd == "exact") & F.coalesce(ways(ld), F.lit(False)) & r["center"].isNotNull()
        to_left = ~to_right & (l["form"] == "scalar") & (ld == "exact") & F.coalesce(ways(rd), F.lit(False)) & l["center"].isNotNull()
        unrecorded = l["form"].rlike("^(relative|absolute)") & r["form"].isin("bound", "scalar") & ~tolerance_recorded & F.coalesce(close(midpoint(l), midpoint(r)), F.lit(False))
        return F.struct(
            F.when(to_left, _bounded(l, rd)).otherwise(l).alias("l"), F.when(to_right, _bounded(r, ld)).otherwise(r).alias("r"), F.coalesce(to_right | to_left, F.lit(False)).alias("resolved"),
            (l["form"].isin(*BANDS) & r["form"].isin(*BANDS)).alias("bands"), unrecorded.alias("unrecorded"),
        )

    def turned(x: Column) -> Column:
        l, r = x["l"], x["r"]  # noqa: E741
        turn = l["form"].isin(*MIRRORED) & (F.coalesce(l["high"], F.lit(float("inf"))) < 0) & (F.coalesce(r["low"], F.lit(float("-inf"))) >= 0)
        return F.struct(F.when(turn, _mirror(l)).otherwise(l).alias("l"), r.alias("r"), turn.alias("turned"), x["resolved"].alias("resolved"), x["bands"].alias("bands"), x["unrecorded"].alias("unrecorded"))

    def judged(x: Column) -> Column:
        l, r = x["l"], x["r"]  # noqa: E741
        sets = interval_relation(l["low"], l["high"], r["low"], r["high"])
        bands = x["bands"] & l["center"].isNotNull() & r["center"].isNotNull()
        centers = F.when(bands, F.when(close(l["center"], r["center"]), "equal").otherwise("different"))

        def said(k: Column) -> Column:
            off, s = F.coalesce(k["c"] == "different", F.lit(False)), k["s"]
            cols = {
                "relation": F.when(off, "different").when(s == "equal", "equal").when(s == "subset", "supports").otherwise("conflicts"),
                "tightness": F.when(off, "different").when(s == "equal", "equal").when(s == "subset", "stricter").otherwise("looser"),
                "interval_relation": s, "center_relation": k["c"], "delta": F.when(off, magnitude(l["center"], r["center"])).otherwise(magnitude(midpoint(l), midpoint(r))),
                "band_decides": ~off & s.isin("superset", "overlap"), "direction_resolved": x["resolved"], "polarity_normalized": x["turned"], "reason": F.lit(None).cast("string"),
            }
            no = {"relation": F.lit("not_comparable"), "reason": F.lit("standard_tolerance_not_recorded"), "band_decides": F.lit(False), "direction_resolved": F.lit(False), "polarity_normalized": F.lit(False)}
            kinds = {"relation": "string", "tightness": "string", "interval_relation": "string", "center_relation": "string", "delta": "string", "band_decides": "boolean", "direction_resolved": "boolean", "polarity_normalized": "boolean", "reason": "string"}
            out = lambda of: F.struct(*[of.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
            missing = lambda side: out(no | {"reason": F.lit(f"{side}_interval_unparseable")})
            return F.when(left.isNull(), missing("left")).when(right.isNull(), missing("right")).when(x["unrecorded"], out(no)).otherwise(out(cols))

        return let(F.struct(sets.alias("s"), centers.alias("c")), said)

    sides = F.struct(scaled(left, left_scale if left_scale is not None else one).alias("l"), scaled(right, right_scale if right_scale is not None else one).alias("r"))
    return let(let(let(sides, lined_up), turned), judged)


def compare_scalars(left: Column, right: Column, left_operator: Column, right_operator: Column) -> Column:
    """How a reported number, in base units, stands to the standard's: relation, tightness, comparator_state, operator,
    delta, polarity_normalized and display_tolerance. An exact side takes the other's direction; opposite directions
    conflict whatever the numbers; where neither is a bound a negative value meets an unsigned one by its size."""
    from .claims import bound_tightness

    rop = F.coalesce(right_operator, F.lit("eq"))
    flip = left_operator.isin("eq", "between") & rop.isin("eq", "between", "tolerance", "range") & (left < 0) & (right >= 0)

    def of(x: Column) -> Column:
        a, ld, rd = x["a"], x["ld"], x["rd"]
        borrow_right, borrow_left = (ld == "exact") & rd.isin("upper", "lower"), (rd == "exact") & ld.isin("upper", "lower")
        yes = lambda c: F.coalesce(c, F.lit(False))
        against = ~yes(borrow_right) & ~yes(borrow_left) & yes(ld != rd)
        op = F.when(yes(borrow_left), left_operator).otherwise(rop)

        def judged(k: Column) -> Column:
            near = k["t"].isin("looser", "different") & (k["d"] == "within_display_tolerance")
            tight = F.when(near, "equal").otherwise(k["t"])
            bound = k["op"].isin("le", "lt", "ge", "gt")
            relation = F.when(bound, F.when(tight.isin("equal", "stricter"), "supports").otherwise("conflicts")).otherwise(F.when(tight == "equal", "equal").otherwise("different"))
            state = F.when(yes(borrow_right) | yes(borrow_left) | ld.eqNullSafe(rd), "aligned").otherwise("mixed")
            null = F.lit(None).cast("string")
            full = lambda *c: F.struct(*[v.alias(n) for n, v in zip(("relation", "tightness", "comparator_state", "operator", "delta", "polarity_normalized", "display_tolerance", "reason"), c)])
            return (
                F.when(left.isNull() | right.isNull(), full(F.lit("not_comparable"), null, null, null, null, F.lit(False), F.lit(False), F.lit("non_scalar_or_ambiguous")))
                .when(against, full(F.lit("conflicts"), null, F.lit("flipped"), null, k["d"], x["flip"], F.lit(False), null))
                .otherwise(full(relation, tight, state, k["op"], k["d"], x["flip"], near, null))
            )

        return let(F.struct(bound_tightness(a, right, op).alias("t"), magnitude(a, right).alias("d"), op.alias("op")), judged)

    return let(F.struct(F.when(flip, F.abs(left)).otherwise(left).alias("a"), direction(left_operator).alias("ld"), direction(rop).alias("rd"), F.coalesce(flip, F.lit(False)).alias("flip")), of)


def verdict(relation: Column, tightness: Column, sets: Column, delta: Column, flipped: Column, band_decides: Column, units: Column) -> Column:
    """(verdict, kind, tighter) of a comparison."""
    holds = relation.isin("equal", "supports")
    say = lambda v, k, t=False: F.struct(F.lit(v).alias("verdict"), F.lit(k).alias("kind"), F.lit(t).alias("tighter"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(relation == "not_comparable", say("unevaluable", "applicability_undetermined")).when(holds & yes(sets == "subset"), say("match", "exact", True)).when(holds & yes(tightness == "stricter"), say("match", "within_standard", True))
        .when(holds & yes(units == "converted"), say("match", "unit_equivalent")).when(holds, say("match", "exact")).when(yes(flipped), say("mismatch", "comparator_flip")).when(yes(delta == "magnitude"), say("mismatch", "magnitude_error"))
        .when(yes(band_decides), say("mismatch", "bandwidth_exceeded")).otherwise(say("mismatch", "numeric_looser"))
    )

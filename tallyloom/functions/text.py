"""Text functions as column expressions. Java's \\s is ASCII only, so (?U) stands where Unicode space counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """White space squeezed to single spaces and stripped."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def fingerprint(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def plain(html: Column) -> Column:
    """Text of markup: tags become spaces, the common entities their characters."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return canonical(out)


def search_text(text: Column) -> Column:
    """Plain text with full-width brackets and percent signs folded, in lower case."""
    return F.lower(F.translate(plain(text), "（）％", "()%"))


def dedupe_key(text: Column) -> Column:
    """Letters, digits and Han characters of the plain text, in lower case."""
    return F.regexp_replace(F.lower(plain(text)), r"(?U)[^\w\x{4e00}-\x{9fff}]+", "")


#: Prefixes of standards' numbers (fixed values). A slash before T may be left out.
STANDARD_PREFIXES = ("Q/GDW", "GB/T", "GB", "JB/T", "JB", "JGJ", "DBJ", "DB", "HJ", "DL", "YY", "JT", "BB")


def _folded(value: Column) -> Column:
    """In capitals, with plain slashes and hyphens, and single spaces for white space and plus signs."""
    return F.upper(F.trim(F.regexp_replace(F.translate(value, "∕／—－+", "//-- "), r"\s+", " ")))


def normal_standard_no(value: Column) -> Column:
    """A standard's number with separators in one form: no space around slash and hyphen, GB/T and JB/T with
    their slash."""
    tight = F.regexp_replace(_folded(value), " ?([/-]) ?", "$1")
    return F.regexp_replace(tight, r"^(GB|JB)[/ ]?T\b", "$1/T")


def standard_no(filename: Column) -> Column:
    """A standard's number such as GB/T 6451-2023 from a file name, in normal form; else null."""
    shapes = [x.replace("/T", " ?/? ?T").replace("Q/", "Q ?/ ?") for x in STANDARD_PREFIXES]
    found = F.regexp_extract(_folded(F.regexp_replace(filename, r"\.[^.]+$", "")), rf"(?:{'|'.join(shapes)}) ?[0-9.]+ ?- ?[0-9]{{4}}", 0)
    return F.nullif(normal_standard_no(found), F.lit(""))


def table_references(text: Column) -> Column:
    """Numbers of other tables that the text refers to, in order, each once."""
    cue = F.regexp_extract_all(text, F.lit(r"(?:详见|参见|见|如)\s*表\s*0*(\d+)|表\s*0*(\d+)\s*(?:所示|所列|中|如下)"), F.lit(0))
    return F.array_distinct(F.transform(cue, lambda m: F.regexp_extract(m, r"0*(\d+)", 1)))


def numbered_references(text: Column, word: str, most: int = 50) -> Column:
    """Numbers after ``word``; N~M stands for each from N to M, ``most`` of them at most."""
    found = F.regexp_extract_all(text, F.lit(rf"{word}\s*(\d+)(?:\s*[~～-]\s*(\d+))?"), F.lit(0))

    def spread(m: Column) -> Column:
        a, b = F.regexp_extract(m, r"(\d+)", 1).cast("int"), F.regexp_extract(m, r"\d+\s*[~～-]\s*(\d+)", 1)
        last = F.when(b == "", a).otherwise(F.least(b.try_cast("int"), a + most - 1))
        return F.when(last >= a, F.sequence(a, last)).otherwise(F.array(a))

    return F.array_distinct(F.flatten(F.transform(found, spread)))


def first_row_columns(html: Column) -> Column:
    """Non-empty cells of the first row of the first table."""
    row = F.regexp_extract(html, r"(?is)<table[^>]*>(.*?)</tr>", 1)
    cells = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.filter(F.transform(cells, plain), lambda c: c != "")


#: What commands with one argument, and those without, become (fixed values).
LATEX_WRAPPERS = {"text": "$1", "mathrm": " $1", "sqrt": "sqrt($1)"}
LATEX_SYMBOLS = {"times": "×", "sim": "～", "leqslant": "≤", "geqslant": "≥", "leq": "≤", "geq": "≥"}


def latex(text: Column) -> Column:
    """Simple LaTeX as plain text. Groups are opened from the inside until nothing changes, so at any depth: a group
    without braces in it gives way to its command's shape; commands not known go, their arguments stay."""
    group = r"\s*\{\s*([^{}]*?)\s*\}"

    def opened(t: Column) -> Column:
        t = F.regexp_replace(t, rf"\\frac{group}{group}", "($1)/($2)")
        for command, shape in LATEX_WRAPPERS.items():
            t = F.regexp_replace(t, rf"\\{command}{group}", shape)
        return F.regexp_replace(t, r"\{(\{[^{}]*\})\}", "$1")

    # No more rounds than there are groups; once a round changes nothing the rest is passed over.
    state = lambda t, done: F.struct(t.alias("t"), done.alias("done"))
    rounds = F.sequence(F.lit(1), F.greatest(F.regexp_count(text, F.lit(r"\{")), F.lit(1)))
    step = lambda a, _: F.when(a["done"], a).otherwise(let(opened(a["t"]), lambda new: state(new, new == a["t"])))
    out = F.aggregate(rounds, state(F.regexp_replace(text, r"\{(\{[^{}]*\})\}", "$1"), F.lit(False)), step)["t"]
    for command, symbol in LATEX_SYMBOLS.items():
        out = F.regexp_replace(out, rf"\\{command}(?![a-z])", symbol)
    out = F.regexp_replace(F.regexp_replace(out, r"\\[a-zA-Z]+", ""), r"\\[()\[\]]", " ")  # other commands, delimiters
    return canonical(F.regexp_replace(out, r"[{}\\]", ""))


def formula_density(text: Column) -> Column:
    """The share of operators among characters that are not white space."""
    compact = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    return F.when(compact > 0, F.regexp_count(text, F.lit(r"[=+*/^×÷√∑≤≥]")) / compact).otherwise(F.lit(0.0))


def number_token(value: Column) -> Column:
    """Without spaces, in capitals, without leading zeros if all are digits."""
    tight = F.upper(F.regexp_replace(value, r"\s+", ""))
    return F.when(tight.rlike(r"^\d+$"), F.regexp_replace(tight, r"^0+(?=\d)", "")).otherwise(tight)


def keyword_list(value: Column, most: int = 8, chars: int = 80) -> Column:
    """Parts of a list in one text: trimmed, distinct, cut to ``chars``, ``most`` of them."""
    parts = F.transform(F.split(value, "[,，;；、\n]"), lambda k: F.substring(F.trim(k), 1, chars))
    return F.slice(F.array_distinct(F.filter(parts, lambda k: k != "")), 1, most)


def quote_match(quote: Column, source: Column) -> Column:
    """'exact', 'format_only' where only white space and markup differ, or 'unmatched'."""
    return F.when(F.contains(source, quote), "exact").when(F.contains(dedupe_key(source), dedupe_key(quote)), "format_only").otherwise("unmatched")


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


#: Units as they are looked for in a text, those that hold another one first (fixed values).
UNIT_WORDS = "kva|mva|khz|mhz|kv|ka|kw|mw|ms|μs|us|ma|va|dba|db|hz|s|%|v|a|w"


def concept(text: Column) -> Column:
    """Plain text in lower case without spaces and underscores, as concepts are compared."""
    return F.translate(F.lower(plain(text)), " _", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def concept_tokens(concept_: Column) -> Column:
    """Of a concept(): words of two letters or more and pairs of neighbouring Han characters, units left out."""

    def of(bare: Column) -> Column:
        words = F.filter(F.regexp_extract_all(bare, F.lit("[a-z][a-z0-9_]*"), F.lit(0)), lambda t: F.length(t) > 1)
        pairs = let(F.regexp_replace(bare, r"[^\x{4e00}-\x{9fff}]", ""), lambda han: F.when(F.length(han) == 1, F.array(han)).otherwise(bigrams(han)))
        return F.array_distinct(F.concat(words, pairs))

    return let(F.regexp_replace(concept_, UNIT_WORDS, ""), of)


def concept_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller number; 0.9 at least where one text holds the other, 0 where one has none."""

    def of(x: Column) -> Column:
        least = F.least(F.size(x["s"]), F.size(x["t"]))
        share = F.size(F.array_intersect(x["s"], x["t"])) / least
        within = F.contains(x["a"], x["b"]) | F.contains(x["b"], x["a"])
        return F.when(least == 0, F.lit(0.0)).when(within, F.greatest(share, F.lit(0.9))).otherwise(share)

    tokens = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), concept_tokens(x["a"]).alias("s"), concept_tokens(x["b"]).alias("t"))
    return let(let(F.struct(concept(a).alias("a"), concept(b).alias("b")), tokens), of)


def is_empty(c: Column, kind: str = "string") -> Column:
    return c.isNull() | (F.size(c) == 0 if kind.startswith(("array", "map")) else F.trim(c.cast("string")) == "")


def fill_empty(a: Column, b: Column, kind: str = "string") -> Column:
    return F.when(is_empty(a, kind), b).otherwise(a)


def document_text(*labels: Column, body: Column) -> Column:
    """Labels that aren't empty joined by ' | ', an empty line, and the body."""
    head = F.concat_ws(" | ", *[F.when(~is_empty(c), c) for c in labels])
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))


def rerank_text(*labels: Column, body: Column, most: int = 2400) -> Column:
    """Labels that aren't empty joined by ' | ', a line break, and the plain body, cut to ``most`` characters."""
    parts = F.struct(F.concat_ws(" | ", *[F.when(~is_empty(c), F.trim(c)) for c in labels]).alias("head"), F.coalesce(plain(body), F.lit("")).alias("body"))
    both = lambda x: F.when((x["head"] != "") & (x["body"] != ""), F.concat(x["head"], F.lit("\n"), x["body"])).otherwise(F.concat(x["head"], x["body"]))
    return F.substring(let(parts, both), 1, most)


def snippet(text: Column, chars: int = 500) -> Column:
    return F.substring(text, 1, chars)


def windows(text: Column, term: Column, radius: int = 100, most: int = 3) -> Column:
    """Up to ``most`` stretches around a term, each ``radius`` characters to both sides. Places come from the
    lengths of what the term cuts the text into, so a long text is read once."""
    pieces = F.split(F.lower(text), F.concat(F.lit("\\Q"), F.lower(term), F.lit("\\E")), most + 1)

    def around(ps: Column) -> Column:
        start = lambda k: F.aggregate(F.slice(ps, 1, k), F.lit(0), lambda a, p: a + F.length(p)) + (k - 1) * F.length(term) + 1
        cut = lambda i: F.substr(text, F.greatest(i - radius, F.lit(1)), F.length(term) + F.least(i - 1, F.lit(radius)) + radius)
        return F.when(F.size(ps) > 1, F.transform(F.sequence(F.lit(1), F.size(ps) - 1), lambda k: let(start(k), cut))).otherwise(F.array().cast("array<string>"))

    return let(pieces, around)

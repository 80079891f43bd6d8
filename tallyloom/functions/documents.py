"""What a chunk's text and its file's name tell about it, and the standards a report declares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .text import let

#: Ends of blocks that are ends of lines (fixed values).
_LINE_ENDS = r"(?i)</(?:p|div|h\d|br|tr|table)>"
#: Prefixes of standards that a report may declare (fixed values).
DECLARED = ("GB/T", "GB", "JB/T", "DL/T", "Q/GDW", "IEC", "ISO")
_BASIS = "(?:检测|检验)依据"


def _caption(html: Column) -> Column:
    """The first line before the first table that is a caption."""
    before = F.regexp_extract(html, r"(?is)^(.*?)<table\b", 1)
    lines = F.split(F.regexp_replace(F.regexp_replace(before, _LINE_ENDS, "\n"), "<[^>]+>", ""), "\n")
    return F.try_element_at(F.filter(F.transform(lines, lambda x: text.canonical(x)), lambda x: x.rlike(r"^表\s*0*\d+")), F.lit(1))


def auto_metadata(html: Column, filename: Column) -> Column:
    """(standard_no, content_type, table_no, table_title, table_columns); a table's fields only where there is one,
    as elsewhere a table's number is a reference."""
    table = html.rlike(r"(?i)<table\b")
    kind = F.when(F.trim(F.coalesce(html, F.lit(""))) == "", F.lit(None)).when(table, "table").otherwise("text")

    def of(line: Column) -> Column:
        title = F.regexp_replace(F.regexp_extract(line, r"^表\s*0*\d+(.*)$", 1), "^[ ：:;；]+|[ ：:;；]+$", "")
        columns = text.first_row_columns(html)
        return F.struct(
            text.standard_no(filename).alias("standard_no"), kind.alias("content_type"), F.when(table, F.regexp_extract(line, r"^表\s*0*(\d+)", 1)).alias("table_no"),
            F.when(table & (title != ""), title).alias("table_title"), F.when(table & (F.size(columns) > 0), columns).alias("table_columns"),
        )

    return let(_caption(html), of)


def backfilled(found: Column, stored: Column) -> Column:
    """Stored fields, and for those that are empty what was found."""
    fields = ("standard_no", "content_type", "table_no", "table_title")
    return F.struct(*[text.fill_empty(stored[f], found[f]).alias(f) for f in fields])


def declared_standards(markdown: Column) -> Column:
    """Standards in the cell beside 'basis', or else in the section of that name, in order, each once."""
    cells = F.regexp_extract_all(markdown, F.lit(rf"(?is)<td\b[^>]*>\s*{_BASIS}\s*</td>\s*<td\b[^>]*>(.*?)</td>"), F.lit(1))
    sections = F.regexp_extract_all(markdown, F.lit(rf"(?is)(?:^|\n)#{{1,6}}\s*{_BASIS}\s*\n(.*?)(?=\n#{{1,6}}\s|\z)"), F.lit(1))
    shapes = "|".join(p.replace("/", " ?/ ?") for p in DECLARED)
    pattern = rf"(?<![A-Z0-9])(?:{shapes}) ?[0-9]+(?:\.[0-9]+)* ?- ?[0-9]{{4}}"
    folded = lambda b: F.upper(text.canonical(F.translate(text.plain(b), "∕／", "//")))
    spaced = lambda n: F.regexp_replace(text.normal_standard_no(n), "^([A-Z/]+) ?", "$1 ")
    found = lambda blocks: F.flatten(F.transform(blocks, lambda b: F.transform(F.regexp_extract_all(folded(b), F.lit(pattern), F.lit(0)), spaced)))
    return F.array_distinct(F.when(F.size(cells) > 0, found(cells)).otherwise(found(sections)))

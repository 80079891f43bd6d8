"""Layered metadata, boxes and usage records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_layers(flat: Column, layers: dict[str, tuple[str, ...]], renames: dict[str, str] | None = None) -> Column:
    """A flat map as a struct of maps by layer: each key goes where it is listed, under its new name if any."""
    new = F.create_map(*[F.lit(x) for pair in (renames or {"": ""}).items() for x in pair])

    def layer(name: str, keys: tuple[str, ...]) -> Column:
        own = F.map_filter(flat, lambda k, v: k.isin(*keys) & v.isNotNull())
        return F.transform_keys(own, lambda k, v: F.coalesce(F.try_element_at(new, k), k)).alias(name)

    return F.struct(*[layer(name, keys) for name, keys in layers.items()])


def merged(base: Column, later: Column) -> Column:
    """Two maps as one; later values stand, unless null."""
    kept = F.map_filter(later, lambda k, v: v.isNotNull())
    names = F.map_keys(kept)
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(names, k)), kept)


def filled(target: Column, fallback: Column) -> Column:
    """``target`` with values of ``fallback`` where it has none or an empty one."""
    full = F.map_filter(target, lambda k, v: v.isNotNull() & (v != ""))
    names = F.map_keys(full)
    return F.map_concat(full, F.map_filter(fallback, lambda k, v: ~F.array_contains(names, k)))


def box(values: Column) -> Column:
    """(x0, y0, x1, y1) in 0 to 1: thousandths are scaled, ends ordered; null where degenerate."""
    v = F.transform(values, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.array_max(values) > 1.5, x / 1000).otherwise(x))))
    at = lambda i: F.element_at(v, i)
    b = F.struct(F.least(at(1), at(3)).alias("x0"), F.least(at(2), at(4)).alias("y0"), F.greatest(at(1), at(3)).alias("x1"), F.greatest(at(2), at(4)).alias("y1"))
    return F.when((F.size(values) == 4) & (at(1) != at(3)) & (at(2) != at(4)), b)


def usage(json: Column) -> Column:
    """Token counts of a provider's answer by any of their names; null where there is none of them."""
    first = lambda *paths: F.coalesce(*[F.get_json_object(json, p).try_cast("long") for p in paths])
    i, o = first("$.prompt_tokens", "$.input_tokens", "$.k"), first("$.completion_tokens", "$.output_tokens")
    known = i.isNotNull() | o.isNotNull()
    total = F.coalesce(first("$.total_tokens"), F.when(known, F.coalesce(i, F.lit(0)) + F.coalesce(o, F.lit(0))))
    return F.struct(F.when(known, F.coalesce(i, F.lit(0))).alias("input_tokens"), F.when(known, F.coalesce(o, F.lit(0))).alias("output_tokens"), total.alias("total_tokens"))


def unique_status(statuses: Column) -> Column:
    """The one status that all decided rows have; 'conflict' for several, 'open' for none."""
    decided = F.array_distinct(F.filter(statuses, lambda s: s.isNotNull() & (s != "unevaluable")))
    return F.when(F.size(decided) == 1, F.element_at(decided, 1)).when(F.size(decided) > 1, "conflict").otherwise("open")


def closed(cited: Column, read: Column) -> Column:
    """An aggregate of rows: something is cited, and all that is cited has been read. ``cited`` and ``read`` are of a
    row; nothing is collected."""
    return F.coalesce(F.bool_or(cited), F.lit(False)) & F.coalesce(F.bool_and(F.when(cited, read)), F.lit(False))

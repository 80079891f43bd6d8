"""Ordered rows within a document, file or conversation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(rows: DataFrame, key: str, order: list[str | Column], columns: list[str], start: Callable[[], Any], step: Callable[..., tuple[Any, Any]], name: str, kind: str) -> DataFrame:
    """A fold over each key's rows in order: ``step`` takes the state that the rows before left and a row's values of
    ``columns``, and gives that of the new column ``name`` and the state after. A task streams sorted rows, so of a key of
    any length it holds a batch, and short keys cost no more than their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *columns))):
                if not begun or not (k == now or k != k and now != now):
                    now, state, begun = k, start(), True
                value, state = step(state, *values)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.type_for_alias(kind))], [*batch.schema.names, name])

    schema = rows.withColumn(name, F.lit(None).cast({"int64": "long"}.get(kind, kind))).schema
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def carried_titles(rows: DataFrame, keys: list[str], order: str, title: str, continued: Column) -> Column:
    """A continued row's title is the last one before it of a row that is not continued."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.when(continued, F.coalesce(F.last(F.when(~continued, F.col(title)), ignorenulls=True).over(before), F.col(title))).otherwise(F.col(title))


def continues_previous(keys: list[str], order: str, page: str, same: list[str]) -> Column:
    """The row before is of the same kind and on the page before."""
    w = Window.partitionBy(*keys).orderBy(order)
    ok = F.col(page) == F.lag(page).over(w) + 1
    for c in same:
        ok = ok & F.col(c).eqNullSafe(F.lag(c).over(w))
    return F.coalesce(ok, F.lit(False))


def duplicate_marks(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """duplicate_of: the first row of the key, for later ones. Found by an aggregate and a join, so that a
    common key is not one task."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("first"))
    cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = rows.join(first.withColumnsRenamed({k: f"_{k}" for k in keys}), cond)
    return joined.select(*rows.columns, F.when(F.col(order) != F.col("first"), F.col("first")).alias("duplicate_of"))


def tail(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def from_first(rows: DataFrame, key: str, order: str, wanted: Column) -> DataFrame:
    """Rows from each key's first wanted one on."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("seen", F.max(wanted.cast("int")).over(w)).filter("seen = 1").drop("seen")


def subtree_ends(rows: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """end: the order of the last row below each heading: those before the next of its level or less."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        ends, open_ = [0] * len(pdf), []
        for i, depth in enumerate(pdf[level]):
            while open_ and pdf[level][open_[-1]] >= depth:
                ends[open_.pop()] = int(pdf[order][i - 1])
            open_.append(i)
        for i in open_:
            ends[i] = int(pdf[order].iloc[-1])
        return pdf.assign(end=ends)

    return rows.groupBy(key).applyInPandas(walk, rows.withColumn("end", F.lit(0).cast("long")).schema)


def section_paths(rows: DataFrame, key: str, order: str, level: str, title: str) -> DataFrame:
    """path: the titles of the headings that enclose each row; a row of null level is text under the last. What is held
    of a key are the headings that are open."""

    def step(stack: list, depth: int | None, name: str) -> tuple[str, list]:
        if depth is not None:
            stack = [s for s in stack if s[0] < depth] + [(depth, name)]
        return " / ".join(s[1] for s in stack), stack

    return folded(rows, key, [order], [level, title], list, step, "path", "string")


def packed(rows: DataFrame, key: str, order: str, size: str, most_size: int, most_rows: int = 1 << 30) -> DataFrame:
    """part: rows of a key in order, a new part where size or number would pass its limit. What a part holds
    decides where the next begins, so each document is walked in order."""

    def step(state: tuple, s: float | None) -> tuple[int, tuple]:
        part, held, n = state
        s = math.nan if s is None else s  # no size passes its limit from there on
        if n and (held + s > most_size or n >= most_rows):
            part, held, n = part + 1, 0, 0
        return part, (part, held + s, n + 1)

    return folded(rows, key, [order], [size], lambda: (0, 0, 0), step, "part", "int64")


def budget_prefix(rows: DataFrame, key: str, order: str, size: str, limit: int, least: int) -> DataFrame:
    """taken: what each row gets of a budget in order, while more than ``least`` is left of it. What is left is
    the budget less the running sum of sizes, as after a stop nothing is left to take."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(limit) - F.coalesce(F.sum(size).over(before), F.lit(0))
    return rows.withColumn("left", left).withColumn("taken", F.when(F.col("left") > least, F.least(F.col(size), F.col("left"))).otherwise(0).cast("long")).drop("left")


def preferred(rows: DataFrame, key: str, rank: Column, order: str) -> DataFrame:
    """One row of each key: the least rank, then the first."""
    kept = rows.withColumn("_r", rank).groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct("_r", order)).alias("r"))
    return kept.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def novelty(rows: DataFrame, key: str, step: str, item: str) -> DataFrame:
    """key, step, items, fresh, zeros: distinct items of a step, those not seen in an earlier one, and how many
    steps in a row have had none."""
    first = rows.groupBy(key, item).agg(F.min(step).alias("first"))
    steps = rows.select(key, step, item).distinct().join(first, [key, item])
    s = steps.groupBy(key, step).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col(step) == F.col("first")).alias("fresh"))
    w = Window.partitionBy(key).orderBy(step)
    island = F.sum(F.when(F.col("fresh") > 0, 1).otherwise(0)).over(w)
    s = s.withColumn("island", island)
    run = Window.partitionBy(key, "island").orderBy(step)
    return s.withColumn("zeros", F.sum(F.when(F.col("fresh") == 0, 1).otherwise(0)).over(run).cast("long")).drop("island")

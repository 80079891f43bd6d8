"""Substring matches of a stated set of patterns against all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words of texts and patterns.
_SPACE = r"[\x20\x09-\x0D]+"
#: Patterns of a block and their characters, bytes of text of one, patterns that are looked for one by one, and texts
#: that are taken from a batch at once.
BLOCK, CHARS, TEXT_BYTES, FEW, ROWS = 20_000, 1 << 20, 16 << 20, 64, 256


def _finder(patterns: pa.Table):
    """A function from texts to the places of patterns and of texts that hold them: by an automaton over all patterns."""
    same: dict[str, list[int]] = {}
    for i, t in enumerate(patterns.column("pattern").to_pylist()):
        same.setdefault(t, []).append(i)
    automaton = None
    if len(same) > FEW:
        automaton = ahocorasick.Automaton()
        for t in same:
            automaton.add_word(t, t)
        automaton.make_automaton()

    def find(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, pa.Array]:
        found, at = [], []
        for first in range(0, len(texts) if same else 0, ROWS):
            for row, text in enumerate(texts.slice(first, ROWS).to_pylist(), first):
                held = {t for t in same if t in text} if automaton is None else {t for _, t in automaton.iter(text)}
                for t in held:
                    found += same[t]
                    at += [row] * len(same[t])
        return pa.array(found, pa.int64()), pa.array(at, pa.int64())

    return find


def _scan(patterns: pa.Table, rows: pa.Table) -> pa.Table:
    """The texts of a block that hold patterns of another."""
    found, at = _finder(patterns)(rows.column("text"))
    return pa.table({"pattern_id": patterns.column("pattern_id").take(found), "id": rows.column("id").take(at)})


def _scanner(patterns: pa.Table):
    """As _scan(), of batches of rows where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(patterns)
        for rows in batches:
            found, at = find(rows.column("text"))
            yield pa.RecordBatch.from_arrays([patterns.column("pattern_id").combine_chunks().take(found), rows.column("id").take(at)], ["pattern_id", "id"])

    return run


def containing(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pattern_id, id: rows whose text contains the pattern as it is. ``patterns``: pattern_id, text. Empty and
    null patterns match nothing; rows of one id each count.

    Patterns that are few and short enough to be sent to all tasks (BLOCK, CHARS) are looked for where texts are read,
    all at once, and nothing else is shuffled. Of more: a word within a pattern, with white space on both sides, is a word of every text that contains it. Each
    pattern of three words or more is keyed by its rarest such word; texts meet the patterns of their words,
    and contains() decides. Patterns of fewer words have no such word: they and the texts are dealt into blocks,
    and each pair of blocks is a task, so texts are sent once for each BLOCK of such patterns.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    said = patterns.filter("text <> ''").select(F.col("pattern_id").cast("long").alias("pattern_id"), F.col("text").alias("pattern"))
    n, chars = said.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("pattern").cast("long")), F.lit(0))).first()
    if n <= BLOCK and chars <= CHARS:
        # In order, so that equal questions make equal plans.
        return rows.filter("text <> ''").mapInArrow(_scanner(said.toArrow().sort_by([("pattern_id", "ascending"), ("pattern", "ascending")])), "pattern_id long, id long")
    # Narrow, and merged: what exploding makes of a table is many times what the planner takes it for.
    words = rows.select("id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), _SPACE))).alias("word"))
    parts = F.split("text", _SPACE)
    inner = patterns.filter("text <> ''").select("pattern_id", F.col("text").alias("pattern"), F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))).alias("inner"))
    asked = inner.select("pattern_id", "pattern", F.explode("inner").alias("word"))
    often = words.hint("merge").join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # A word that no text has rules its pattern out.
    keys = asked.join(often, "word", "left").groupBy("pattern_id", "pattern").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    pairs = words.hint("merge").join(keys, "word").select("pattern_id", "pattern", F.col("id").alias("d")).distinct()
    found = pairs.hint("merge").join(rows, F.col("d").eqNullSafe(F.col("id"))).filter(F.contains("text", F.col("pattern"))).select("pattern_id", "id")
    short = inner.filter(F.size("inner") == 0).select(F.col("pattern_id").cast("long").alias("pattern_id"), "pattern")
    n = short.count()
    if not n:
        return found
    texts = rows.filter("text <> ''")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many, parts = math.ceil(n / BLOCK), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TEXT_BYTES))
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    deal = lambda b, *c: F.pmod(F.xxhash64(*c), F.lit(b)).cast("int")
    left = short.withColumn("pb", deal(many, "pattern_id", "pattern")).withColumn("tb", every(parts))
    right = texts.select(F.col("id").alias("id"), F.col("text").alias("text")).withColumn("tb", deal(parts, "id", "text")).withColumn("pb", every(many))
    return found.unionAll(left.groupBy("pb", "tb").cogroup(right.groupBy("pb", "tb")).applyInArrow(_scan, "pattern_id long, id long"))


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether the text holds any of the terms, case folded; % and _ are letters like others."""
    low = F.lower(text)
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(low, F.lit(t.lower()))
    return hit


def hit_ratio(text: Column, tokens: Column) -> Column:
    """The share of tokens that occur in the text; 0 without tokens."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.contains(text, t))) / F.size(tokens)).otherwise(F.lit(0.0))

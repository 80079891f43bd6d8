"""Divergence of sources by their terms, from distinct count columns.

Most terms of a language are rare and share the way they are spread over its sources. Terms with the same sparse
vector of counts by source are one column with a multiplicity: what two sources differ by is evaluated once a
distinct column and multiplied. Only the report of single terms goes back to the terms themselves.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_bytes, written

#: A-Z to lower case, other ASCII that is no letter to a space.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i > 127 else 32 for i in range(256))
#: Terms that a task counts before it sends them.
_HELD = 500_000
#: Sources of a block, and distinct columns that a pair of blocks is compared by at once.
SOURCES, COLUMNS = 128, 4096


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sent() -> pa.RecordBatch:
        keys = [k for k, (n, _) in held.items() for _ in range(len(n))]
        n = [x for c, _ in held.values() for x in c.items()]
        docs = [d[t] for (c, d) in held.values() for t in c]
        terms = pa.array([t for t, _ in n], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), terms, pa.array([x for _, x in n], pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    held: dict = defaultdict(lambda: (Counter(), Counter()))
    before = 0
    for batch in batches:
        for text, lang, source in zip(text_bytes(batch), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            n, docs = held[lang, source]
            before += -len(n)
            words = text.translate(_FOLD).split()
            n.update(words)
            docs.update(set(words))
            before += len(n)
            if before > _HELD:
                yield sent()
                held.clear()
                before = 0
    yield sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that have it); null texts, languages and sources are ''."""
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return base.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> str:
    """SQL for 1 + floor(1000000000 * count / total) of longs, in two steps so that no product leaves a long."""
    return f"(1 + ({count} * 32000) div {total} * 31250 + (({count} * 32000) % {total} * 31250) div {total})"


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    q, r = np.divmod(count * 32000, total)
    return 1 + q * 31250 + r * 31250 // total


def _compare(key, columns: pa.Table, sources: pa.Table) -> pa.Table:
    """For two blocks of sources: by how much each source of the one differs from each of the other, over these
    columns, beyond what it would if it had none of their terms. Shard 0 adds that for all terms."""
    _, i, j, shard = (k.as_py() for k in key)
    block, at, total, v = (sources.column(c).to_numpy() for c in ("block", "at", "total", "v"))
    order = np.argsort(at)
    block, at, total, v = block[order], at[order], total[order], int(v[0]) if len(v) else 0
    out = pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "value")})
    if not len(at) or not columns.num_rows and shard:
        return out
    none = shares(np.full(len(at), 5), total) if v else np.zeros(len(at), np.int64)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    diff = np.zeros((len(left), len(right)), np.int64) if shard else v * np.abs(none[left][:, None] - none[right])
    if columns.num_rows:
        ids, row = np.unique(columns.column("id").to_numpy(), return_inverse=True)
        many = np.zeros(len(ids), np.int64)
        many[row] = columns.column("m").to_numpy()
        p = np.tile(none, (len(ids), 1))
        place = np.searchsorted(at, columns.column("at").to_numpy())
        p[row, place] = shares(columns.column("n").to_numpy() + 5, total[place])
        q = np.ascontiguousarray(p[:, right])
        for s, source in enumerate(left):
            diff[s] += many @ np.abs(p[:, source][:, None] - q)
        diff -= many.sum() * np.abs(none[left][:, None] - none[right])
    a, b = np.meshgrid(at[left], at[right], indexing="ij")
    cells = [(a.ravel(), b.ravel(), diff.ravel())] + [(b.ravel(), a.ravel(), diff.ravel())] * (i != j)
    a, b, value = (np.concatenate(x) for x in zip(*cells))
    keep = a != b
    return pa.table({"a": a[keep], "b": b[keep], "value": value[keep]})


def _compared(key, columns: pa.Table, sources: pa.Table) -> pa.Table:
    out = _compare(key, columns, sources)
    return out.append_column("lang", pa.array([key[0].as_py()] * out.num_rows, pa.string()))


def divergence(docs: DataFrame, min_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank for every (lang, source) of ``docs``.

    Terms are runs of ASCII letters and of characters beyond ASCII, only A-Z in lower case; a language keeps
    those that ``min_docs`` of its rows have. A source's share of a term is 1 + floor(10^9 * (count + 5) / (N + 5 * V)).
    Part 'pair' has each other source of the language, value the sum of the shares' differences over all kept terms
    (0 where none is kept). Part 'term' has the ``most_terms`` kept terms that the source uses and whose share is
    furthest above the language's. Ties go by item in UTF-8 order.

    Null texts, languages and sources count as ''. Every row is a document, so repeated rows count again; ids and
    other columns are not read, whatever their names. A source without terms takes part. An empty table gives an
    empty result.

    A language's sources are dealt into blocks; a column goes to those pairs of blocks of which it has a source,
    and its terms beyond the first ``most_terms`` are never moved for the report, as none of them can be in it.
    """
    spark = docs.sparkSession
    counts = term_counts(docs)
    spread = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("column"))
    kept = written(spread.filter(F.col("docs") >= min_docs).select("lang", "term", "n", "column"), "kept-terms")
    distinct = written(kept.groupBy("lang", "column").agg(F.count(F.lit(1)).alias("m")).withColumn("id", F.monotonically_increasing_id()), "distinct-columns")
    cells = distinct.select("lang", "id", "m", F.inline("column").alias("source", "n"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("all")), "lang", "left").fillna(0)
    sums = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = groups.join(sums, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", place.cast("long").alias("at"), "v", (F.coalesce("n", F.lit(0)) + 5 * F.col("v")).alias("total"), (F.col("all") + 5 * F.col("v")).alias("all_total"))
    block = F.floor(F.col("at") / SOURCES)
    sources = written(sources.withColumn("block", block).withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1), "sources")

    shards = max(1, math.ceil(distinct.count() / COLUMNS))

    def dealt(rows: DataFrame, block: str) -> DataFrame:
        other = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return other.withColumn("i", F.least(block, "other")).withColumn("j", F.greatest(block, "other"))

    # Columns of its own: a cogroup can't tell the two sides of one table apart.
    named = sources.select("lang", "source", F.col("at").alias("place"), F.col("block").alias("own"), F.col("blocks").alias("blocks"))
    columns = dealt(cells.join(named, ["lang", "source"]), "own").select("lang", "i", "j", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "m", F.col("place").alias("at"), "n")
    each = dealt(sources, "block").select("lang", "i", "j", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", F.col("at").alias("at"), "total", "v").distinct()
    keys = ["lang", "i", "j", "shard"]
    found = columns.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(_compared, "a long, b long, value long, lang string")
    pairs = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda c, to: sources.select("lang", F.col("at").alias(c), F.col("source").alias(to))
    pairs = pairs.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])

    own = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "column").orderBy("term"))).filter(F.col("place") <= most_terms)
    once = first.groupBy("lang", "column", "n").agg(F.collect_list("term").alias("terms")).select("lang", F.col("n").alias("all_n"), "terms", F.inline("column").alias("source", "n"))
    valued = once.join(sources, ["lang", "source"]).withColumn("value", F.expr(share("(n + 5)", "total")) - F.expr(share("(all_n + 5)", "all_total"))).filter("value > 0")
    terms = valued.select("lang", "source", "value", F.explode("terms").alias("item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(own).alias("rank"))
    return ranked(pairs, "pair").unionAll(ranked(terms, "term").filter(F.col("rank") <= most_terms))

"""Exact top-k inner products, pruned by segment statistics from coarse to fine.

A vector cut into segments has a mean and a deviation for each. By Cauchy-Schwarz the inner product of two
vectors is at most the sum over segments of length * (mean * mean + deviation * deviation), and so their
distance is at least what follows from it. Bounds of 1, 4 and 16 segments and of segments of two components are
taken in turn; only pairs whose bound reaches the k-th best exact score found so far go on. A query's survivors are
scored in the order of their bounds, the most promising first, so that the rest meets a threshold near the last one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

LEVELS = (1, 4, 16)
#: A level that ruled out less than this of the pairs it saw is passed over from then on; candidates of a query that
#: are scored at once before the others meet the threshold anew.
USEFUL, FOREMOST = 0.01, 64


def scaled(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v, floor(scale * x) of each component. Rows without an id, and vectors that are null or
    empty or hold a null or non-finite component, take no part. Rows of one id count once, as the least."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & fine)
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _segments(x: np.ndarray, count: int) -> np.ndarray:
    """Columns whose inner product with another vector's columns is the bound."""
    cuts = np.linspace(0, x.shape[1], min(count, x.shape[1]) + 1).astype(int)
    n = np.diff(cuts)
    total, square = np.add.reduceat(x, cuts[:-1], axis=1), np.add.reduceat(x * x, cuts[:-1], axis=1)
    mean = total / n
    deviation = np.sqrt(np.maximum(square / n - mean * mean, 0))
    return np.concatenate([mean * np.sqrt(n), deviation * np.sqrt(n)], axis=1)


def levels(d: int) -> list[int]:
    """Numbers of segments for vectors of d components."""
    return sorted({*(min(level, d) for level in LEVELS), max(d // 2, 1)})


def _widths(d: int) -> list[int]:
    return [2 * level for level in levels(d)]


def _stats(x: np.ndarray) -> np.ndarray:
    return np.concatenate([_segments(x, level) for level in levels(x.shape[1])], axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Of lists: their lengths, and by length a matrix of those of it."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    size = np.diff(ends)
    return size, {int(d): values[ends[:-1][size == d][:, None] + np.arange(d)] for d in np.unique(size)}


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, by_size = _matrix(batch.column("v"))
        ids = batch.column("vec_id")
        for d, v in by_size.items():
            stats = _stats(v.astype(np.float64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32)), pa.array(stats.ravel()))
            at = pa.array(np.flatnonzero(size == d))
            yield pa.RecordBatch.from_arrays([ids.take(at), batch.column("v").take(at), flat], names=["vec_id", "v", "stats"])


def described(rows: DataFrame) -> DataFrame:
    """vec_id, v and stats, the segment statistics of all levels, computed once a vector."""
    return rows.mapInArrow(_describe, "vec_id long, v array<long>, stats array<double>")


class Block(NamedTuple):
    """Vectors of one length: ids, components, and for each level the columns of its bound."""

    ids: np.ndarray
    v: np.ndarray
    levels: list[np.ndarray]

    def part(self, a: int, b: int) -> Block:
        return Block(self.ids[a:b], self.v[a:b], [s[a:b] for s in self.levels])


def _load(table: pa.Table) -> dict[int, Block]:
    ids, out = table.column("vec_id").to_numpy(), {}
    size, by_size = _matrix(table.column("v"))
    _, stats = _matrix(table.column("stats"))
    for d, v in by_size.items():
        of = stats[sum(_widths(d))]
        if len(of) != len(v):  # short lengths may share a width
            of = _stats(v.astype(np.float64))
        out[d] = Block(ids[size == d], v, np.split(of, np.cumsum(_widths(d))[:-1], axis=1))
    return out


class Best:
    """The k best (score, id) of each query so far, and how many exact scores were taken."""

    def __init__(self, n: int, k: int):
        self.k, self.row, self.id, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least, self.exact = np.full(n, -np.inf), np.zeros(n, np.int64)

    def add(self, row: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        row, id_, score = np.concatenate([self.row, row]), np.concatenate([self.id, id_]), np.concatenate([self.score, score])
        order = np.lexsort((id_, -score, row))
        row, id_, score = row[order], id_[order], score[order]
        counts = np.bincount(row, minlength=len(self.least))
        best = np.arange(len(row)) - (np.cumsum(counts) - counts)[row] < self.k
        self.row, self.id, self.score = row[best], id_[best], score[best]
        full = np.flatnonzero(counts >= self.k)
        self.least[full] = np.maximum(self.least[full], self.score[np.cumsum(np.minimum(counts, self.k))[full] - 1])


def refine(best: Best, q: Block, c: Block, useful: list[bool] | None = None) -> None:
    """Adds what is better among the pairs of two blocks. Bounds go from coarse to fine, each for the pairs that
    still reach the query's k-th best exact score; a query's survivors are scored in the order of their bounds, until
    a bound is under the threshold that the scores so far give. ``useful``: levels to take, kept up to date."""
    useful = [True] * len(q.levels) if useful is None else useful
    useful[-1] = True  # the finest orders the survivors
    # A bound is taken a little high, by more than rounding can have cost. The coarsest columns hold the norm.
    slack = 1e-9 * np.linalg.norm(q.levels[0], axis=1) * np.linalg.norm(c.levels[0], axis=1).max(initial=0) + 1e-6
    alive = q.ids[:, None] != c.ids[None, :]
    bound = np.full(alive.shape, np.inf)
    known = np.isfinite(best.least).all()
    for n, (a, b) in enumerate(zip(q.levels, c.levels)):
        if not useful[n]:
            continue
        before = np.count_nonzero(alive)
        if before > alive.size / 8:
            bound = a @ b.T + slack[:, None]
        else:
            i, j = np.nonzero(alive)
            bound[i, j] = np.einsum("ij,ij->i", a[i], b[j]) + slack[i]
        alive &= bound >= best.least[:, None]
        useful[n] = not known or before - np.count_nonzero(alive) >= USEFUL * before
    found: list[tuple] = []
    for i in range(len(q.ids)):
        j = np.flatnonzero(alive[i])
        if not len(j):
            continue
        own = bound[i, j]
        order, at, least = np.argsort(-own), 0, best.least[i]
        top = np.zeros(0, np.int64)
        scores = []
        while at < len(order) and own[order[at]] >= least:
            some = order[at : at + FOREMOST]
            score = c.v[j[some]] @ q.v[i]
            scores.append(score)
            at += len(some)
            top = np.concatenate([top, score])
            if len(top) >= best.k:
                top = np.partition(top, -best.k)[-best.k :]
                least = max(least, top[0])
        scored, score = j[order[:at]], np.concatenate(scores) if scores else top
        best.exact[i] += at
        found.append((np.full(len(scored), i), c.ids[scored], score))
    if found:
        best.add(*(np.concatenate(x) for x in zip(*found)))


def _search(k: int, queries_at_once: int = 512, rows_at_once: int = 4096):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            by_size = _load(rows)
            least = dict(zip(queries.column("vec_id").to_pylist(), queries.column("least").to_pylist()))
            for d, q in _load(queries).items():
                useful: list[bool] = []
                for s in range(0, len(q.ids) if d in by_size else 0, queries_at_once):
                    some, c = q.part(s, s + queries_at_once), by_size[d]
                    useful = useful or [True] * len(some.levels)
                    best = Best(len(some.ids), k)
                    best.least = np.array([-np.inf if least[x] is None else least[x] for x in some.ids.tolist()], np.float64)
                    for t in range(0, len(c.ids), rows_at_once):
                        refine(best, some, c.part(t, t + rows_at_once), useful)
                    # Exact scores taken are told once a query, with its first row or on a row of their own.
                    first = np.concatenate([[True], best.row[1:] != best.row[:-1]])[: len(best.row)]
                    out.append((some.ids[best.row], best.id, best.score, np.where(first, best.exact[best.row], 0)))
                    none = np.setdiff1d(np.arange(len(some.ids)), best.row)
                    out.append((some.ids[none], np.full(len(none), -1), np.zeros(len(none), np.int64), best.exact[none]))
        cols = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64)] * 4
        told = pa.array(cols[1], mask=cols[1] == -1) if len(cols[1]) and any(len(o[0]) for o in out[1::2]) else pa.array(cols[1])
        return pa.table({"query_id": pa.array(cols[0]), "vec_id": told, "score": pa.array(cols[2]), "exact": pa.array(cols[3])})

    return run


def searched(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, block_bytes: int = 16 << 20) -> DataFrame:
    """top_k() with n_exact, how many of a query's exact scores the bounds did not rule out.

    Rows are dealt into blocks by a hash of the id, so equal vectors are no hot key; a block holds as many vectors
    as ``block_bytes`` do with their statistics. Queries meet one block first. Their k-th best scores there are
    thresholds that go with them to all other blocks, each pair of a block of rows and one of queries a task that keeps
    k rows a query. A table of n vectors is sent once for each block of queries.
    """
    rows = written(described(scaled(vectors, scale)), "described")
    asked = F.col("vec_id") % query_every == 0
    n, m, d = rows.agg(F.count(F.lit(1)), F.count_if(asked), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    block = max(block_bytes // (8 * (max(d, 1) + sum(_widths(max(d, 1))))), 256)
    row_blocks = max(math.ceil(n / block), 1)
    place = lambda b: F.pmod(F.xxhash64("vec_id"), F.lit(b)).cast("int")
    every = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    dealt = rows.withColumn("rb", place(row_blocks))
    # Columns of its own: a cogroup can't tell the two sides of one table apart.
    queries = rows.filter(asked).select(*[F.col(c).alias(c) for c in rows.columns])

    def best(left: DataFrame, of: DataFrame, blocks: tuple[int, int], size: int) -> DataFrame:
        query_blocks = max(math.ceil(m / size), 1)
        left = left.withColumn("qb", place(query_blocks)).withColumn("rb", every(*blocks))
        right = of.withColumn("qb", every(0, query_blocks))
        return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(_search(k), "query_id long, vec_id long, score long, exact long")

    # The first block is met in small groups of queries, as it is the only one.
    found = best(queries.withColumn("least", F.lit(None).cast("long")), dealt.filter("rb = 0"), (0, 1), 64)
    if row_blocks > 1:
        first = written(found, "first-block")
        own = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        least = first.filter("vec_id IS NOT NULL").withColumn("_n", F.row_number().over(own)).filter(F.col("_n") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("least"))
        others = best(queries.join(least, F.col("vec_id") == F.col("_q"), "left").drop("_q"), dealt.filter("rb > 0"), (1, row_blocks), block)
        found = first.unionAll(others)
    own = Window.partitionBy("query_id")
    ranked = found.withColumn("n_exact", F.sum("exact").over(own)).filter("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(own.orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_exact")


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, block_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``query_every`` the k best of all
    other rows by integer inner product, ties to smaller ids; fewer rows where there are fewer.

    Only vectors of a query's own length are compared with it. Inner products must fit 64 bits. Columns
    beside vec_id and embedding are left out, whatever their names. An empty table gives an empty result.
    """
    return searched(vectors, k, query_every, scale, block_bytes).drop("n_exact")

"""Exact nearest vectors by cosine, a stated set of queries against all rows in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, as doubles; null where a norm is zero or lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def _unit(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors; rows of another length or without a direction are not scored."""
    lists = table.column("v").combine_chunks()
    values, ends = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
    right = np.diff(ends) == size
    x = values[ends[:-1][right][:, None] + np.arange(size)]
    norm = np.linalg.norm(x, axis=1)
    ok = norm > 0
    return table.column("id").to_numpy()[right][ok], x[ok] / norm[ok][:, None]


def _search(k: int, size: int, digits: int, queries_at_once: int = 256, rows_at_once: int = 8192):
    def best(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
        return some[np.lexsort((ids[some], -score[some]))][:k]

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            q_ids, q = _unit(queries, size)
            ids, x = _unit(rows, size)
            for a in range(0, len(q_ids) if len(ids) else 0, queries_at_once):
                held = [(np.zeros(0, np.int64), np.zeros(0))] * len(q_ids[a : a + queries_at_once])
                for b in range(0, len(ids), rows_at_once):
                    score = np.round(q[a : a + queries_at_once] @ x[b : b + rows_at_once].T, digits)
                    for i, s in enumerate(score):
                        top = best(s, ids[b : b + rows_at_once])
                        near = np.concatenate([held[i][0], ids[b : b + rows_at_once][top]]), np.concatenate([held[i][1], s[top]])
                        top = best(near[1], near[0])
                        held[i] = near[0][top], near[1][top]
                out += [(np.full(len(d), q_ids[a + i]), d, s) for i, (d, s) in enumerate(held)]
        cols = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "score"), map(pa.array, cols))))

    return run


def knn(queries: DataFrame, rows: DataFrame, k: int, size: int, digits: int = 6, block_bytes: int = 64 << 20) -> DataFrame:
    """query_id, id, score, rank: the k nearest rows of each query by cosine rounded to ``digits``, ties to
    smaller ids. Both sides have id and v (array); vectors of another length than ``size`` are not scored.

    Queries and rows are dealt into blocks by a hash of the id, each pair of blocks is one task that keeps k
    rows a query, and those are ranked. A block holds as many vectors as ``block_bytes`` do, so that rows
    are sent once for each such block of queries.
    """
    block = max(block_bytes // (8 * size), 512)
    n_q, n = queries.count(), rows.count()
    q_blocks, r_blocks = max(1, math.ceil(n_q / block)), max(1, math.ceil(n / block), min(8, math.ceil(n / 512)))
    deal = lambda b: F.pmod(F.xxhash64("id"), F.lit(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    left = queries.select("id", "v").withColumn("qb", deal(q_blocks)).withColumn("rb", every(r_blocks))
    right = rows.select("id", "v").withColumn("rb", deal(r_blocks)).withColumn("qb", every(q_blocks))
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(_search(k, size, digits), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)

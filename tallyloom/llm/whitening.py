"""Whitening of embeddings by a digit-slice GEMM: an exact integer covariance from float64 matrix products.

Entries are integers. Centred and multiplied by the number of rows they stay integers, y = n * x - S, and are cut
into limbs of 20 bits. Products of limbs summed over a few thousand rows fit the 53 bits of a double, so BLAS
multiplies them exactly; sums of limb products are put together as big integers, merged over all tasks, and only
the finished covariance is rounded, once, before its eigenvectors are taken.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Bits of a limb, and rows of one product: 2 * 19 + 13 bits are under a double's 53.
BITS, ROWS = 20, 8192
#: Products added up in 64 bits before they are sent.
_FLUSH = 100
#: Integers under this stay in 64-bit arrays; beyond it the same code runs on Python's integers.
_SMALL = 1 << 61
#: Eigenvalues under this share of the largest are taken as zero.
_ZERO = 1e-13


def entries(batch: pa.RecordBatch, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of a batch's usable rows and their entries floor(scale * c) + shift, by length of vector."""
    lists = batch.column("v")
    for at in range(0, batch.num_rows, ROWS):
        part = lists.slice(at, ROWS)
        values = part.flatten()
        size = part.value_lengths().fill_null(0).to_numpy()
        c = values.cast(pa.float64()).fill_null(float("nan")).to_numpy()
        ends = np.cumsum(size)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(scale * c)
            bad = ~(np.abs(x) < 2.0**62)
        bad = np.diff(np.concatenate([[0], np.cumsum(bad)])[np.concatenate([[0], ends])]) > 0
        for d in np.unique(size[size > 0]):
            rows = np.flatnonzero((size == d) & ~bad)
            if len(rows):
                yield rows + at, x[(ends[rows] - d)[:, None] + np.arange(d)].astype(np.int64) + shift


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, total)) < _SMALL:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of ``BITS`` bits, the least first, as doubles."""
    half, out = 1 << (BITS - 1), []
    while not out or y.any():
        low = (y + half) % (1 << BITS) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> BITS
    return out


def add_products(sums: dict[int, np.ndarray], y: np.ndarray) -> None:
    """Adds the limb products of y's transpose with y to ``sums``, by the number of limbs they are shifted."""
    digits = limbs(y)
    for a, left in enumerate(digits):
        for b in range(a, len(digits)):
            product = (left.T @ digits[b]).astype(np.int64)
            sums[a + b] = sums.get(a + b, 0) + (product if a == b else product + product.T)


def _sums(scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = {}, defaultdict(int)
        for batch in batches:
            for _, x in entries(batch, scale, shift):
                d = x.shape[1]
                small = int(np.abs(x).max()) < _SMALL // ROWS
                own = x.sum(0) if small else x.astype(object).sum(0)
                total[d] = total.get(d, 0) + own.astype(object)
                n[d] += len(x)
        for d, s in total.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "n": pa.array([n[d]] * d, pa.int64()), "s": pa.array(list(map(str, s)))})

    return run


def _products(scale: int, shift: int, fits: dict):
    def rows(d: int, sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        i, j = np.triu_indices(d)
        m = len(i) * len(sums)
        value = np.concatenate([s[i, j] for s in sums.values()])
        return pa.RecordBatch.from_pydict({"d": pa.array(np.full(m, d, np.int32)), "k": pa.array(np.repeat(np.array(list(sums), np.int32), len(i))), "i": pa.array(np.tile(i, len(sums)).astype(np.int32)), "j": pa.array(np.tile(j, len(sums)).astype(np.int32)), "value": pa.array(value)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, added = defaultdict(dict), 0
        for batch in batches:
            for _, x in entries(batch, scale, shift):
                d = x.shape[1]
                add_products(held[d], centred(x, *fits[d]))
                added += 1
                if added == _FLUSH:
                    yield from (rows(d, s) for d, s in held.items())
                    held, added = defaultdict(dict), 0
        yield from (rows(d, s) for d, s in held.items())

    return run


def _whiten(scale: int, shift: int, fits: dict, axes: dict):
    """axes: by length, the matrix of components over the roots of their eigenvalues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in entries(batch, scale, shift):
                d = x.shape[1]
                n, total = fits[d]
                y = centred(x, n, total)
                small = y.dtype != object and int(np.abs(y).max()) ** 2 * d < 1 << 63
                deviation = (y * y if small else y.astype(object) ** 2).sum(1)
                w = (y.astype(np.float64) / n) @ axes[d]
                ends = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), n)), pa.array(list(map(str, deviation))), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))],
                    names=["vec_id", "d", "n", "deviation", "w"],
                )

    return run


def _by_length(values: dict[int, list[float]]) -> Column:
    """The values of a row's length."""
    entry = [x for d, v in values.items() for x in (F.lit(int(d)), F.array(*[F.lit(float(c)) for c in v]))]
    return F.element_at(F.create_map(*entry), F.col("d"))


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, deviation_wide, whitened, explained and identity_error: a row for
    each usable row of ``vectors`` and each of its first ``components`` components.

    Vectors that are null or empty, or hold a null, a non-finite entry or one whose integer no long holds, take no
    part. All others are the fit list; rows of null or repeated ids are rows of their own. Vectors of several
    lengths are a fit list for each length. ``deviation`` is exact; beyond a long it is null, and deviation_wide
    has it as a decimal. A component without variance has whitened 0 and no part in identity_error; equal
    eigenvalues keep the order that the solver gives, the same for all rows. Columns beside the two are left out,
    whatever their names. An empty table gives an empty result.

    Two passes of bounded state find the sums and the products; what reaches the driver are numbers by component,
    or pair of components, and limb, however many the rows.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    sums = base.mapInArrow(_sums(scale, shift), "d int, i int, n long, s string").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d", "i").collect()
    fits: dict[int, tuple[int, list[int]]] = {}
    for r in sums:
        fits.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))
    schema = "vec_id long, d int, n long, deviation string, w array<double>"
    products = base.mapInArrow(_products(scale, shift, fits), "d int, k int, i int, j int, value long").groupBy("d", "k", "i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    exact = {d: np.zeros((d, d), object) for d in fits}
    for r in products:
        exact[r["d"]][r["i"], r["j"]] += int(r["value"]) << (BITS * r["k"])
    axes, explained, live = {}, {}, {}
    for d, g in exact.items():
        cubed = fits[d][0] ** 3
        v = np.array([[g[min(i, j), max(i, j)] / cubed for j in range(d)] for i in range(d)], np.float64)
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        live[d] = (e > 0) & (e > _ZERO * e[0])
        axes[d] = np.where(live[d], u / np.sqrt(np.where(live[d], e, 1)), 0)
        explained[d] = np.where(live[d], e / (np.trace(v) or 1), 0).tolist()
    out = written(base.mapInArrow(_whiten(scale, shift, fits, axes), schema), "whitened")
    if not fits:
        means, errors = {0: [0.0]}, {0: [0.0]}
    else:
        most = max(len(x) for x in explained.values())
        w = [F.get("w", F.lit(i)) for i in range(most)]
        means = {r["d"]: [x or 0.0 for x in r[1:]] for r in out.groupBy("d").agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(w)]).collect()}
        apart = out.withColumn("_m", _by_length(means))
        off = [w[i] - F.get("_m", F.lit(i)) for i in range(most)]
        cells = [(i, j) for i in range(most) for j in range(i, most)]
        errors = {}
        for r in apart.groupBy("d").agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in cells]).collect():
            of = live[r["d"]]
            errors[r["d"]] = [max([abs(r[f"c{i}_{j}"] - (i == j)) for i, j in cells if j < len(of) and of[i] and of[j]], default=0.0)]
    rows = out.select("*", F.posexplode("w").alias("at", "whitened"))
    wide = F.col("deviation").cast("decimal(38,0)")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.when(wide <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), wide).cast("long").alias("deviation"), wide.alias("deviation_wide"), "whitened",
        F.get(_by_length(explained or {0: [0.0]}), F.col("at")).alias("explained"), F.get(_by_length(errors), F.lit(0)).alias("identity_error"),
    )

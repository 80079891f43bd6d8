"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of n-grams of each order and a uniform one are mixed; the weights depend on how often
the context was seen, in buckets of powers of two, and are learned by expectation-maximisation on a part of the
training documents whose counts are deleted first, so that the estimates meet text they have not counted.

Counts are looked up the way they are made. Documents are bundled; a bundle lists each of its n-grams once, by
hash, with its own count; lists meet by part of the hash range, where counts are summed and sent back to the
bundles in the order of their lists. A frequent n-gram is one entry a bundle, and nothing is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import group_count, grouped, text_bytes, written

_U = np.uint64
#: What a document's rows are for: scored only, weights are learned on them, counted only.
TEST, DELETED, COUNTED = 0, 1, 2
#: Bytes of text in a bundle, and words whose hashes a worker remembers.
BUNDLE_BYTES, _KNOWN_WORDS = 4 << 20, 100_000
#: A blank is in no word, so these are the hashes of no word.
_END, _START = _U(xxhash.xxh3_64_intdigest(b" end")), _U(xxhash.xxh3_64_intdigest(b" start"))
#: Buckets of context frequency; estimates are told apart by quarters of a power of two when weights are learned.
BUCKETS, _FINE = 64, 4


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens of each text with its end, and for each order the hash of the n-gram that ends at each token. A-Z count
    as lower case, words end at ASCII white space; before its first word a text has start marks."""
    if len(_words) > _KNOWN_WORDS:
        _words.clear()
    hashes = []
    for text in texts:
        words = text.lower().split()  # both as the contract has them: ASCII only
        h = np.empty(len(words) + 1, np.uint64)
        h[:-1] = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
        h[-1] = _END
        hashes.append(h)
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out, before = [word], _START
    with np.errstate(over="ignore"):
        for _ in range(1, order):
            context = np.empty_like(word)
            context[1:] = out[-1][:-1]
            context[first] = before
            out.append(_mix(context * _U(0x9E3779B97F4A7C15) + word))
            before = _mix(np.array([before]) * _U(0x9E3779B97F4A7C15) + _START)[0]
    return sizes, out


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, so that like bytes are together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _list_bytes(sorted_: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_, prepend=_U(0)))


def _place(unique: np.ndarray, parts: int) -> np.ndarray:
    return ((unique >> _U(20)) % _U(parts)).astype(np.int64)


def _bundle(size: int):
    """Documents of a kind together, about ``size`` bytes of text, or one that is longer."""

    def sent(kind: int, ids: list, texts: list) -> pa.RecordBatch:
        name, blob = uuid.uuid4().int >> 65, zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64()), pa.array([kind], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
            names=["bundle", "kind", "ids", "sizes", "blob"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for kind, id_, text in zip(batch.column("kind").to_pylist(), batch.column("doc_id").to_pylist(), text_bytes(batch)):
                own = held.setdefault(kind, [0, [], []])
                own[0] += len(text) + 16
                own[1].append(id_)
                own[2].append(text)
                if own[0] >= size:
                    yield sent(kind, *held.pop(kind)[1:])
        for kind, (_, ids, texts) in held.items():
            yield sent(kind, ids, texts)

    return run


def _texts(row: dict) -> list[bytes]:
    raw, ends = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(sum(row["sizes"]), 1)), np.cumsum([0, *row["sizes"]]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _ask(order: int, parts: int):
    """A bundle's distinct n-grams, by part: hashes and own counts for each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lists: dict[int, list] = {}
                for k, g in enumerate(grams(_texts(row), order)[1]):
                    unique, n = np.unique(g, return_counts=True)
                    part = _place(unique, parts)
                    by = np.argsort(part, kind="stable")
                    cuts = np.flatnonzero(np.diff(part[by])) + 1
                    for rows in np.split(by, cuts) if len(by) else []:
                        at = lists.setdefault(int(part[rows[0]]), [[b""] * order, [b""] * order])
                        at[0][k] = _list_bytes(unique[rows])
                        if row["kind"] != TEST:
                            at[1][k] = _planes(n[rows].astype(np.uint64))
                m = len(lists)
                binary = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(lists), pa.int32()), pa.array([row["bundle"]] * m, pa.int64()), pa.array([row["kind"]] * m, pa.int32()), pa.array([x[0] for x in lists.values()], binary), pa.array([x[1] for x in lists.values()], binary)],
                    names=["part", "bundle", "kind", "grams", "counts"],
                )
        _words.clear()  # workers live on, and later stages need the room

    return run


def _answer(order: int):
    """Sums the counts of a part's n-grams and gives each bundle those of its list, in its order: all that are trained
    on, and for a deleted bundle also without the deleted. The first row has the part's tokens and types."""

    def run(table: pa.Table) -> pa.Table:
        asked, own = table.column("grams").to_pylist(), table.column("counts").to_pylist()
        kinds = table.column("kind").to_numpy()
        total, kept = [[b""] * order for _ in kinds], [[b""] * order for _ in kinds]
        stats = np.zeros((len(kinds), 4), np.int64)
        for k in range(order):
            lists = [np.cumsum(_unplanes(x[k])) for x in asked]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            unique, at = np.unique(np.concatenate(lists), return_inverse=True)
            n = np.concatenate([_unplanes(c[k]) if kind != TEST else np.zeros(m, np.uint64) for c, kind, m in zip(own, kinds, sizes)])
            kind = np.repeat(kinds, sizes)
            count = [np.bincount(at[kind == x], n[kind == x], len(unique)).astype(np.uint64) for x in (COUNTED, DELETED)]
            both = count[0] + count[1]
            if k == 0:
                stats[0] = both.sum(), np.count_nonzero(both), count[0].sum(), np.count_nonzero(count[0])
            for i, own_at in enumerate(np.split(at, np.cumsum(sizes)[:-1])):
                total[i][k] = _planes(both[own_at])
                if kinds[i] == DELETED:
                    kept[i][k] = _planes(count[0][own_at])
        binary = pa.list_(pa.binary())
        cols = [table.column("part"), table.column("bundle"), table.column("kind"), pa.array(total, binary), pa.array(kept, binary), *(pa.array(s) for s in stats.T)]
        return pa.table(dict(zip(("part", "bundle", "kind", "total", "kept", "n", "v", "kept_n", "kept_v"), cols)))

    return run


def _counts(g: list[np.ndarray], parts: int, answers: pa.Table, column: str) -> list[np.ndarray]:
    """For each order, the count of the n-gram that ends at each token."""
    by_part = np.argsort(answers.column("part").to_numpy())
    lists, out = answers.column(column).to_pylist(), []
    for k, x in enumerate(g):
        unique, at = np.unique(x, return_inverse=True)
        count = np.empty(len(unique), np.uint64)
        if len(unique):
            count[np.argsort(_place(unique, parts), kind="stable")] = np.concatenate([_unplanes(lists[i][k]) for i in by_part])
        out.append(count[at].astype(np.float64))
    return out


def estimates(counts: list[np.ndarray], sizes: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token's context, and a row of estimates for each: uniform, then of each order. A bucket is
    the longest context that was seen, and the power of two of how often."""
    f = np.zeros((len(counts) + 1, len(counts[0])))
    f[0], f[1] = 1 / (v + 1), counts[0] / max(n, 1)
    bucket = np.zeros(len(counts[0]), np.int64)
    last = np.cumsum(sizes) - 1
    for k in range(1, len(counts)):
        seen = np.empty_like(counts[0])
        seen[1:] = counts[k - 1][:-1]
        seen[last - sizes + 1] = counts[0][last]  # start marks were seen as often as ends
        np.divide(counts[k], seen, out=f[k + 1], where=seen > 0)
        bucket = np.where(seen > 0, (k - 1) * BUCKETS + 1 + np.log2(np.maximum(seen, 1)).astype(np.int64), bucket)
    return bucket, f


class Model(NamedTuple):
    """Training tokens and types, and for each bucket the weights of the uniform and each order's estimate."""

    n: int
    v: int
    weights: np.ndarray


def _level(bucket: np.ndarray, order: int) -> np.ndarray:
    """How many estimates a bucket's contexts have."""
    return np.minimum(2 + (np.maximum(bucket, 1) - 1) // BUCKETS + (bucket > 0), order + 1)


def learn(bucket: np.ndarray, f: np.ndarray, n: np.ndarray, order: int, rounds: int = 300) -> np.ndarray:
    """Weights by expectation-maximisation over cells of ``n`` held-out tokens with estimates ``f`` (a row for each
    cell). Each estimate a bucket can have begins with a part of a token, so none ends at zero; without held-out tokens
    a bucket has the weights of all tokens of its level."""
    size = 1 + max(order - 1, 0) * BUCKETS
    can = np.arange(order + 1) < _level(np.arange(size), order)[:, None]
    level = _level(np.arange(size), order)
    prior = can / can.sum(1, keepdims=True)
    weights = prior.copy()
    for _ in range(rounds):
        share = weights[bucket] * f
        total = np.maximum(share.sum(1, keepdims=True), 1e-300)
        got = np.zeros_like(weights)
        np.add.at(got, bucket, share / total * n[:, None])
        pooled = np.zeros((order + 2, order + 1))
        np.add.at(pooled, level, got)
        pooled = pooled[level] + prior
        new = got + pooled / pooled.sum(1, keepdims=True)
        new = np.where(can, new, 0) / new.sum(1, keepdims=True)
        done = np.abs(new - weights).max() < 1e-7
        weights = new
        if done:
            break
    return weights


def _cells(order: int, parts: int, n: int, v: int):
    """Of a deleted bundle: tokens, and sums of their estimates, by bucket and size of each estimate."""

    def run(bundle: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = bundle.to_pylist()
        sizes, g = grams(_texts(row), order)
        bucket, f = estimates(_counts(g, parts, answers, "kept"), sizes, n, v)
        with np.errstate(divide="ignore"):
            fine = np.where(f[1:] > 0, np.floor(_FINE * np.log2(f[1:])), -9999).astype(np.int64)
        key, first, at, many = np.unique(np.concatenate([bucket[None], fine]), axis=1, return_index=True, return_inverse=True, return_counts=True)
        sums = [np.bincount(at.ravel(), x, key.shape[1]) for x in f[1:]]
        lists = lambda rows: pa.array([r.tolist() for r in np.array(rows).T])
        return pa.table({"bucket": pa.array(key[0].astype(np.int32)), "fine": lists(key[1:]), "n": pa.array(many.astype(np.int64)), **{f"f{i}": pa.array(x) for i, x in enumerate(sums)}})

    return run


def _score(order: int, parts: int, model: Model):
    def run(bundle: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in bundle.to_pylist():
            sizes, g = grams(_texts(row), order)
            counts = _counts(g, parts, answers, "total")
            bucket, f = estimates(counts, sizes, model.n, model.v)
            p = np.einsum("ij,ji->i", model.weights[bucket], f)
            base = (counts[0] + 0.1) / (model.n + 0.1 * (model.v + 1))
            first = np.cumsum(sizes) - sizes
            known = np.add.reduceat((counts[0] > 0).astype(np.int64), first)
            out.append(pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array([row["kind"] == TEST] * len(sizes)), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(sizes), model.n)), "base_score": pa.array(np.add.reduceat(np.log10(base), first)), "score": pa.array(np.add.reduceat(np.log10(p), first))}))
        _words.clear()
        return pa.concat_tables(out)

    return run


def interpolated_scores(docs: DataFrame, order: int = 2, bundle_bytes: int = BUNDLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    Rows whose crc32 of the id as text is divisible by 10 are held out and give no counts; those that leave 1 are
    counted too, and before that the weights are learned on them from the counts of all others. Null ids are
    trained on. ``score`` is the base-10 logarithm of the model's probability of a text's words and its end; the
    model's probabilities of what can follow a context sum to 1, words that no training text has taken as one more
    type. Null, empty and blank texts are their end alone. Every row is a document, repeated rows too; equal texts
    get equal scores; other columns are not read, whatever their names. Without training rows all scores are 0.
    An empty table gives an empty result.

    N-grams are told apart by 64-bit hashes. What is collected is one row a cell of bucket and quarter powers of two of
    the estimates, at most BUCKETS * 160 ** order, however many the rows. A text is held whole beside its bundle.
    """
    spark = docs.sparkSession
    rest = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 10
    kind = F.when(rest == 0, TEST).when(rest == 1, DELETED).otherwise(COUNTED).cast("int")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), kind.alias("kind"))
    bundles = written(base.mapInArrow(_bundle(bundle_bytes), "bundle long, kind int, ids array<long>, sizes array<long>, blob binary"), "bundles", compression="none")
    size = bundles.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x + 8))).first()[0] or 0
    parts = group_count(spark, size * 8 / 6 * order)
    asked = bundles.mapInArrow(_ask(order, parts), "part int, bundle long, kind int, grams array<binary>, counts array<binary>")
    answers = written(grouped(asked, "part", parts).applyInArrow(_answer(order), "part int, bundle long, kind int, total array<binary>, kept array<binary>, n long, v long, kept_n long, kept_v long"), "answers")
    n, v, kept_n, kept_v = (x or 0 for x in answers.agg(*[F.sum(c) for c in ("n", "v", "kept_n", "kept_v")]).first())
    f = [f"f{i}" for i in range(order)]
    met = lambda of, rows: of.groupBy("bundle").cogroup(rows.select("bundle", "part", "total", "kept").groupBy("bundle"))
    some = met(bundles.filter(F.col("kind") == DELETED), answers.filter(F.col("kind") == DELETED))
    cells = some.applyInArrow(_cells(order, parts, kept_n, kept_v), "bucket int, fine array<long>, n long, " + ", ".join(f"{c} double" for c in f))
    cells = cells.groupBy("bucket", "fine").agg(*[F.sum(c).alias(c) for c in ("n", *f)]).toArrow()
    many = cells.column("n").to_numpy()
    means = np.stack([np.full(len(many), 1 / (kept_v + 1)), *(cells.column(c).to_numpy() / np.maximum(many, 1) for c in f)], 1)
    weights = learn(cells.column("bucket").to_numpy(), means, many, order) if n else np.eye(order + 1)[np.zeros(1 + max(order - 1, 0) * BUCKETS, int)]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met(bundles, answers).applyInArrow(_score(order, parts, Model(n, v, weights)), schema)

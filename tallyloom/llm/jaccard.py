"""Exact Jaccard join of word-shingle sets by universe partition and pigeonhole.

Two sets of sizes a and b that link differ in at most k = (a + b) * (100 - t) / (100 + t) shingles. Shingles
are hashed into segments; a set's sizes fall into bands so narrow that linked sets are in the same band or in
neighbouring ones, and each band has its own k and number of segments. Differences spread over the segments,
so one of k + 1 units of budget goes unspent:

- a segment of budget 1 that is equal in both sets;
- three segments of budget 2, of which two are equal (indexed by each subset of two);
- a segment of budget 2 that differs by one shingle at most (indexed whole and with each shingle left out).

Which kind a band uses is decided by cost: the signatures it writes, and the collisions to expect among the
band's number of sets at the signatures' length. Budget is given beyond k + 1, and as many of a set's signatures, those
of the fewest shingles, are dropped again: an equal signature has equal weight in both sets, so the heaviest of
those that two linked sets share has enough lighter ones below it to stay in both.

Sets that share a signature are candidates. Each set also has a sketch, the parities of its shingles in many
cells; sets differ in at least as many shingles as sketches do in bits, which rules out most candidates. What
is left falls into families, within which all pairs are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BUNDLES, group_count, grouped, in_slices, spread_join, text_bytes, written

_U = np.uint64
PLAIN, SUBSETS, DELETIONS = 0, 1, 2
#: Shingles of sets compared in one task, and words whose hashes a worker remembers; both bound memory.
FAMILY_SHINGLES, _KNOWN_WORDS = 750_000, 100_000
#: Rows whose sets a task holds at once.
ROWS = 1000
#: Sets with one signature that are written as pairs; more are compared in a task, in blocks of BLOCK_SETS.
PAIR_SETS, BLOCK_SETS = 6, 2048
#: Classes that a task remembers to have indexed.
_KNOWN_CLASSES = 100_000
#: A row of a signature: with its others; so too, and its task has many more; one of those, on its own.
PLAIN_ROW, MANY_HERE, APART = 0, 1, 2


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer over 64 bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    return x * _U(0xD6E8FEB86659FD93) ^ (x >> _U(29))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct hashes of ``width`` words in a row, sorted. A-Z count as lower case, words end
    at ASCII white space; with fewer words the whole sequence is one, and without words there is none."""
    out = []
    powers = [_U(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(width)]
    if len(_words) > _KNOWN_WORDS:
        _words.clear()
    for text in texts:
        words = text.lower().split()  # both as the contract has them: ASCII only
        h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
        if len(h) >= width:
            s = h[: len(h) - width + 1] * powers[0]
            for i in range(1, width):
                s = s + h[i : len(h) - width + 1 + i] * powers[i]
        else:
            s = sum((h[i : i + 1] * powers[i] for i in range(len(h))), h[:0] if not len(h) else np.full(1, len(h), np.uint64))
        out.append(np.unique(mix(s)))
    return out


def set_key(s: np.ndarray) -> int:
    """The name of a class of equal sets."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def band_starts(percent: int, largest: int) -> list[int]:
    """Least sizes of the bands."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return out


def most_apart(a, b, percent: int):
    """Shingles in which linked sets of sizes a and b can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def choose_kind(size: int, k: int, sets: int) -> int:
    """The cheapest kind for a band: signatures written, and those of other sets met by chance at each. Two
    sets that aren't linked are taken to share a shingle with probability e^-2."""
    cost = []
    for units, signatures, tokens in ((k + 1, k + 1, size / (k + 1)), (k // 2 + 1, 3 * (k // 2 + 1), 2 * size / (3 * (k // 2 + 1))), (k // 2 + 1, k // 2 + 1 + size, size / (k // 2 + 1) - 1)):
        cost.append(signatures * (1 + sets * math.exp(-2 * tokens)))
    return int(np.argmin(cost)) if k else PLAIN


def spare(kind: int, k: int) -> int:
    """Units beyond what k needs, and so signatures that a set drops."""
    return 0 if k < 6 or kind == DELETIONS else (k + 1) // 4 if kind == PLAIN else (k // 2 + 1) // 5


def sketch(s: np.ndarray, percent: int) -> bytes:
    """Parities of a set's shingles in a power of two of cells, four times the differences of a link or more."""
    k = most_apart(len(s), len(s) * 100 // percent, percent)
    cells = 1 << max(6, (4 * k).bit_length())
    place = (mix(s ^ _U(0x5C5C5C5C5C5C5C5C)) & _U(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def allocate(counts: dict[int, int], percent: int) -> dict[int, tuple[int, int, int, int, int]]:
    """For each band: its first size, the next band's, its kind, number of segments and spare units.
    ``counts``: sets by band."""
    starts = band_starts(percent, 1 << 31)
    plan = {}
    for band in range(max(counts, default=-1) + 2):
        top = starts[band + 1] - 1
        k = most_apart(top, top, percent)
        kind = choose_kind(top, k, counts.get(band, 0) + counts.get(band - 1, 0))
        c = spare(kind, k)
        plan[band] = starts[band], starts[band + 1], kind, (k + 1 + c, 3 * (k // 2 + 1 + c), k // 2 + 1)[kind], c
    return plan


def signature_count(plan: dict, band: int) -> int:
    """The most signatures a set of the band has, in its own and the next."""
    count = lambda first, following, kind, segments, c: segments + following - 1 if kind == DELETIONS else segments - c
    return count(*plan[band]) + count(*plan[band + 1])


def signatures(sets: list[np.ndarray], plan: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and which set each is of."""
    starts = np.array([p[0] for p in plan.values()])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    band = np.searchsorted(starts, sizes, side="right") - 1
    sigs, of = [], []
    for step in (0, 1):
        # In its own band, and in the next as the smaller of a pair.
        for i in np.flatnonzero(sizes > 0):
            n, b = int(sizes[i]), int(band[i]) + step
            first, following, kind, segments, c = plan[b]
            partner = n * 100 // percent
            if partner < first:
                continue
            k = most_apart(n, min(partner, following - 1), percent)
            s = sets[i]
            seg = (mix(s ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(segments)).astype(np.int64)
            total, many = np.zeros(segments, np.uint64), np.bincount(seg, minlength=segments)
            np.add.at(total, seg, s)
            base = _U(b * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            place = lambda m: base + np.arange(m, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F)  # noqa: B023, E731
            if kind == PLAIN:
                got, weight = total[: k + 1 + c] + place(k + 1 + c), many[: k + 1 + c]
            elif kind == SUBSETS:
                t, w = total.reshape(-1, 3)[: k // 2 + 1 + c], many.reshape(-1, 3)[: k // 2 + 1 + c]
                got = np.stack([t[:, 0] + t[:, 1] * _U(3), t[:, 1] + t[:, 2] * _U(5), t[:, 2] + t[:, 0] * _U(7)], 1).ravel()
                got, weight = got + place(len(got)), np.stack([w[:, 0] + w[:, 1], w[:, 1] + w[:, 2], w[:, 2] + w[:, 0]], 1).ravel()
            else:
                units = k // 2 + 1
                inside = seg < units
                got = np.concatenate([total[:units] + place(units), total[seg[inside]] - s[inside] + place(units)[seg[inside]]])
            if c:
                got = got[np.lexsort((got, weight))[c:]]
            sigs.append(mix(got))
            of.append(np.full(len(got), i))
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(of)


def _keys(width: int, percent: int):
    starts = np.array(band_starts(percent, 1 << 31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in in_slices(batches, ROWS):
                sets = shingle_sets(text_bytes(batch), width)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                key = [set_key(s) for s in sets]
                marks = [sketch(s, percent) if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n), pa.array((np.searchsorted(starts, n, side="right") - 1).astype(np.int32)), pa.array(key, pa.int64()), pa.array(marks, pa.binary())], names=["doc_id", "text_hash", "n", "band", "cls", "sketch"])
        _words.clear()  # workers live on, and later stages need the room

    return run


def _marked(sig: np.ndarray, cls: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kinds of rows, and the signatures of ``many`` with those that have more than PAIR_SETS rows here."""
    _, first, at, n = np.unique(sig, return_index=True, return_inverse=True, return_counts=True)
    kind = np.where(n[at] > PAIR_SETS, APART, PLAIN_ROW).astype(np.uint8)
    kind[first[n > PAIR_SETS]] = MANY_HERE
    kind[np.isin(sig, many)] = APART
    return kind, np.union1d(many, sig[kind == MANY_HERE])


def _index(width: int, percent: int, plan: dict, parts: int):
    """Rows of signature, class and kind, by part. Rows of one signature go to one part, but a task sends there no
    more than one batch's few and a mark once it has more of them; the others go by signature and class, so that a
    signature of a third of all documents is no hot key. A class is indexed once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        many = np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            for batch in in_slices(batches, ROWS):
                own = {}
                for s in shingle_sets(text_bytes(batch), width):
                    if len(s) and (key := set_key(s)) not in done:
                        own.setdefault(key, s)
                if len(done) >= _KNOWN_CLASSES:
                    done.clear()
                done.update(own)
                sig, of = signatures(list(own.values()), plan, percent)
                cls = np.array(list(own), np.int64)[of] if own else np.zeros(0, np.int64)
                kind, many = _marked(sig, cls, many)
                part = (np.where(kind == APART, mix(sig ^ mix(cls.view(np.uint64))), sig) >> _U(40)) % _U(parts)
                order = np.argsort(part, kind="stable")
                sig, cls, kind, part = sig[order], cls[order], kind[order], part[order]
                cuts = np.flatnonzero(np.diff(part)) + 1 if len(part) else np.zeros(0, int)
                blobs = [b"".join(x.tobytes() for x in cols) for cols in zip(*(np.split(x, cuts) for x in (sig, cls, kind)))] if len(sig) else []
                yield pa.RecordBatch.from_arrays([pa.array(part[np.concatenate([[0], cuts])].astype(np.int32) if len(sig) else [], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])
        _words.clear()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Classes that share a signature: each pair (a, b) of a few, or rows (a: signature, b: class) of many."""
    sig, cls, kind = [], [], []
    for blob in table.column("blob").to_pylist():
        n = len(blob) // 17
        sig.append(np.frombuffer(blob, np.uint64, n))
        cls.append(np.frombuffer(blob, np.int64, n, 8 * n))
        kind.append(np.frombuffer(blob, np.uint8, n, 16 * n))
    sig, cls, kind = np.concatenate(sig), np.concatenate(cls), np.concatenate(kind)
    order = np.lexsort((kind, cls, sig))
    sig, cls, kind = sig[order], cls[order], kind[order]
    marked = np.isin(sig, sig[kind == MANY_HERE])
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])[: len(sig)]  # copies came from several tasks
    apart = new & (kind == APART)
    own, own_cls = sig[new & ~apart], cls[new & ~apart]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
    size = np.diff(np.append(start, len(own)))
    many = (np.repeat(size, size) > PAIR_SETS) | marked[new & ~apart]
    pairs = [np.zeros((0, 2), np.int64)]
    for step in range(1, PAIR_SETS):
        near = np.flatnonzero(~many[step:] & (own[step:] == own[:-step]))
        pairs.append(np.stack([own_cls[near], own_cls[near + step]], 1))
    few = np.unique(np.concatenate(pairs), axis=0)
    a = np.concatenate([few[:, 0], own[many].view(np.int64), sig[apart].view(np.int64)])
    b = np.concatenate([few[:, 1], own_cls[many], cls[apart]])
    return pa.table({"a": pa.array(a), "b": pa.array(b), "many": pa.array(np.arange(len(a)) >= len(few))})


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches at the size of the least of them: cells that fall together add their parities."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least), np.uint8)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, least), axis=0)
    return out.view(np.uint64)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _possible(percent: int):
    """Pairs whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            k = most_apart(na, nb, percent)
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            for i in np.flatnonzero(ok).tolist():
                ok[i] = _apart(*_folded([sa[i], sb[i]])) <= k[i]
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return run


def spanning(n: int, first: int, near) -> list[tuple[int, int]]:
    """Edges that join what ``near`` joins: near(i) says which of n items i is linked to.

    ``first`` is compared with all. Links within its component change nothing, so from then on only items
    outside of it are compared with all others.
    """
    label, edges = np.arange(n), []
    for i in [first, *range(n)]:
        if i == first or label[i] != label[first]:
            for j in np.flatnonzero(near(i)).tolist():
                if label[j] != label[i]:
                    edges.append((i, j))
                    label[label == label[j]] = label[i]
        if i == first and (label == label[first]).all():
            break
    return edges


def _compare_many(percent: int):
    """A forest of the possible links among the classes of each signature."""

    def run(table: pa.Table) -> pa.Table:
        group = np.stack([table.column(c).to_numpy() for c in ("sig", "i", "j")], 1)
        cls, size, marks = table.column("cls").to_numpy(), table.column("n").to_numpy(), table.column("sketch").to_pylist()
        order = np.lexsort(group.T[::-1])
        cuts = np.flatnonzero((np.diff(group[order], axis=0) != 0).any(1)) + 1
        edges = []
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                x, n = _folded([marks[r] for r in rows]), size[rows]
                near = lambda i: (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (_apart(x, x[i]) <= most_apart(n, n[i], percent))  # noqa: B023, E731
                edges += [(int(cls[rows[a]]), int(cls[rows[b]])) for a, b in spanning(len(rows), 0, near)]
        a, b = zip(*edges) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _blocks(rows: DataFrame, sizes: DataFrame, key: str, item: str) -> DataFrame:
    """``rows`` with i and j, the pairs of a group's blocks that each row takes part in. ``sizes``: key, n rows
    of it, and its number of blocks."""
    own = spread_join(rows, sizes, [key], item).withColumn("_own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
    spread = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).drop("_own", "_other", "blocks")


def candidate_edges(met: DataFrame, classes: DataFrame, percent: int, sketch_bytes: float) -> DataFrame:
    """a, b: enough of the classes' possible links to join each family. ``classes``: cls, n, sketch."""
    side = lambda x: classes.select(F.col("cls").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    pairs = met.filter("not many").select("a", "b").distinct()
    both = pairs.join(side("a"), F.col("a") == F.col("ca")).join(side("b"), F.col("b") == F.col("cb"))
    few = both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible(percent), "a long, b long")
    many = met.filter("many").select(F.col("a").alias("sig"), F.col("b").alias("cls"))
    sizes = many.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK_SETS).cast("int")), "signature-sizes")
    dealt = _blocks(many, sizes, "sig", "cls").withColumnRenamed("cls", "m").join(classes, F.col("m") == F.col("cls"))
    copies = sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    tasks = group_count(met.sparkSession, copies * (sketch_bytes + 40))
    bundle = F.pmod(F.xxhash64("sig", "i", "j"), F.lit(BUNDLES * tasks)).cast("int").alias("bundle")
    return few.unionAll(grouped(dealt.select(bundle, "sig", "i", "j", "cls", "n", "sketch"), "bundle", tasks).applyInArrow(_compare_many(percent), "a long, b long"))


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of positions whose edges join all linked sets: enough of them, not each."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    of = np.repeat(np.arange(len(sets)), sizes)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posts, ends = of[np.argsort(token, kind="stable")], np.cumsum(often)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    lists = np.split(token, cuts[1:-1])

    def near(i: int) -> np.ndarray:
        t = lists[i][often[lists[i]] > 1]
        n = often[t]
        flat = posts[np.repeat(ends[t] - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        both = np.bincount(flat, minlength=len(sets))
        return 100 * both >= percent * (sizes[i] + sizes - both)

    # The one that shares most with the others comes first.
    return spanning(len(sets), int(np.argmax(np.add.reduceat(often[token], cuts[:-1]) / np.maximum(sizes, 1))), near)


def _verify(width: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        edges = []
        with np.errstate(over="ignore"):
            family = np.stack([table.column(c).to_numpy() for c in ("family", "i", "j")], 1)
            cls, texts = table.column("cls").to_numpy(), table.column("text")
            order = np.lexsort(family.T[::-1])
            cuts = np.flatnonzero((np.diff(family[order], axis=0) != 0).any(1)) + 1
            for rows in np.split(order, cuts):
                if len(rows) > 1:
                    sets = shingle_sets([x or b"" for x in texts.take(pa.array(rows)).cast(pa.binary()).to_pylist()], width)
                    edges += [(int(cls[rows[a]]), int(cls[rows[b]])) for a, b in linked(sets, percent)]
        _words.clear()
        a, b = zip(*edges) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``: as jaccard_members() has them."""
    return jaccard_members(docs, width, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def jaccard_members(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and family for every row of ``docs``: rows whose sets have
    a similarity of ``percent`` or more are linked, component_id is the least doc_id that links lead to, and
    family a name of the component that no other has; null for rows without shingles.

    Null, empty and blank texts have no shingles and link with nothing, not even with each other. Rows with
    equal sets are one class, compared once. Null ids take part and are never a component's id unless all
    of it are null. A text of any length is one set. Columns beside id and text are left out, whatever their names.
    An empty table gives an empty result.

    A family of candidates with more shingles than FAMILY_SHINGLES is dealt into blocks, and each pair of
    blocks is a task; what a task gives back are edges enough to join its links, at most one a set.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    keys = written(base.mapInArrow(_keys(width, percent), "doc_id long, text_hash long, n long, band int, cls long, sketch binary"), "shingle-keys")
    bands = keys.filter("n > 0").groupBy("band").agg(F.count_distinct("cls").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum(F.length("sketch")).alias("marks")).collect()  # a row a band: a logarithm of the largest size
    plan = allocate({r["band"]: r["n"] for r in bands}, percent)
    parts = group_count(spark, sum(17 * r["rows"] * signature_count(plan, r["band"]) for r in bands))
    blobs = base.mapInArrow(_index(width, percent, plan, parts), "part int, blob binary")
    met = written(grouped(blobs, "part", parts).applyInArrow(_meet, "a long, b long, many boolean"), "met")
    # One document stands for each class.
    reps = keys.filter("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash", "n", "sketch")).alias("r"))
    reps = reps.select("cls", "r.doc_id", "r.text_hash", "r.n", "r.sketch")
    sketch_bytes = sum(r["marks"] for r in bands) / max(sum(r["rows"] for r in bands), 1)
    candidates = components(candidate_edges(met, reps.select("cls", "n", "sketch"), percent, sketch_bytes))
    family = candidates.join(reps, candidates["node"] == reps["cls"]).select("cls", F.col("root").alias("family"), F.col("doc_id").alias("rep"), F.col("text_hash").alias("rep_hash"), F.col("n").alias("size"))
    family = written(family, "families")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / FAMILY_SHINGLES).cast("int").alias("blocks"), F.sum("size").alias("shingles"))
    sizes = written(sizes, "family-sizes")
    dealt = _blocks(family, sizes.drop("shingles"), "family", "cls").select("cls", "family", "rep", "rep_hash", "i", "j")
    # Merged at every size: the families grow with the documents, so neither side is one to broadcast.
    texts = dealt.hint("merge").join(base.withColumnRenamed("doc_id", "d"), F.col("rep").eqNullSafe(F.col("d")) & (F.col("rep_hash") == F.col("text_hash"))).dropDuplicates(["cls", "family", "i", "j"])
    tasks = group_count(spark, 8 * (sizes.agg(F.sum(F.col("shingles") * F.col("blocks"))).first()[0] or 0))  # a shingle is a word of text
    bundle = F.pmod(F.xxhash64("family", "i", "j"), F.lit(BUNDLES * tasks)).cast("int").alias("bundle")
    edges = grouped(texts.select(bundle, "cls", "family", "i", "j", "text"), "bundle", tasks).applyInArrow(_verify(width, percent), "a long, b long")
    roots = components(edges)
    classes = keys.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r")
    named = named.join(least, F.col("root") == F.col("r")).select(F.col("cls").alias("c"), "component", F.col("root").alias("family"))
    joined = keys.join(named, (F.col("cls") == F.col("c")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "family")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without those that another row of their component
    stands for: the one of the least id, null ids last, and of that id's texts the first by hash. Rows of one
    id and text are one document, of which one row stays, the first by a hash of its columns; texts without
    shingles stay."""
    members = jaccard_members(docs, width, percent).select("doc_id", "text_hash", "family").filter("family IS NOT NULL")
    members = written(members, "members")
    own = lambda: F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")
    first = written(members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min(own()).alias("first")), "first")
    gone = spread_join(members, first, ["family"], "text_hash").filter(own() != F.col("first")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    kept = hashed.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_t")), "left_anti")
    one = kept.groupBy("doc_id", "_hash").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return one.select("_row.*")

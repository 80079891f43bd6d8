"""Exact removal of repeated byte strings by merging the shards' sorted suffixes.

A suffix array or Burrows-Wheeler transform of everything does not fit one task, so suffixes are first put
where equal ones meet. Of the grams in a string of ``depth`` bytes the one with the least hash is its anchor;
equal strings have equal anchors at equal places. Every shard lists its anchors, each with the strings it
stands for. Where an anchor occurs in several surroundings, the shards' lists are merged as Burrows-Wheeler
transforms are: the interleave starts in shard order, and each round refines the runs still tied by the next
symbols to the right, or by the preceding ones to the left (those a transform holds). The symbol at which
two neighbours part is their common prefix; intervals of neighbours with enough in common, left and right of
the anchor together, are repeated strings, of which all but the first occurrence are marked.

A gram of more surroundings than one task is to hold is refined before: of a string of ``depth`` bytes around it,
half of the rest is to the left of it or to the right, so its strings are dealt by those 38 bytes. What is
still too many then, the edges of a passage that very many documents hold, goes string by string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import group_count, grouped, split_ranges, spread_join, text_bytes, written

GRAM = 24
_CHUNK = 1 << 20
_U = np.uint64
_AT = np.dtype([("fp", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("at", "<i8"), ("lo", "<i8"), ("hi", "<i8")])
#: Surroundings of a gram that one task holds, about 200 bytes each.
HOT = 1 << 18
_ROW = "kind int, fp long, doc_id long, text_hash long, at long, lo long, hi long"
_RANGE = "doc_id long, text_hash long, lo long, hi long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    return (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)


def _chunks(texts: list[bytes], depth: int) -> Iterator[list[tuple[int, int, int]]]:
    """Stretches (text, first string start, end of string starts) of about _CHUNK bytes together."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - depth + 1, 0), _CHUNK):
            b = min(a + _CHUNK, len(t) - depth + 1)
            held.append((i, a, b))
            size += b - a + depth
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors(texts: list[bytes], depth: int) -> tuple[np.ndarray, ...]:
    """text, fp, ctx, at, lo, hi of each anchor: its place, and the first and last start of the strings of
    ``depth`` bytes it stands for; fp is a hash of its gram, ctx of all its strings' bytes."""
    out = []
    grams = depth - GRAM + 1
    for held in _chunks(texts, depth):
        raw = b"".join([texts[i][a : b + depth - 1] for i, a, b in held]) + bytes(GRAM + 8)
        n = len(raw) - GRAM - 8
        word = np.ndarray(n + GRAM, "<u8", raw, strides=(1,))
        with np.errstate(over="ignore"):
            fp = _mix(word[:n] * _U(0x9E3779B97F4A7C15) + word[8 : n + 8] * _U(0xC2B2AE3D27D4EB4F) + word[16 : n + 16] * _U(0x165667B19E3779F9))
        low = (fp >> _U(24)) << _U(24) | np.arange(n, dtype=np.uint64)
        span = 1
        least = low
        while 2 * span <= grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < grams:
            least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
        counts = np.array([b - a for _, a, b in held])
        base = np.cumsum(counts + depth - 1) - (counts + depth - 1)
        run, inside = split_ranges(counts)
        place = (least[base[run] + inside] & _U(0xFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (run[1:] != run[:-1])]))
        last = np.append(edge[1:], len(place)) - 1
        at, of = place[edge], run[edge]
        lo, hi = base[of] + inside[edge], base[of] + inside[last]
        ctx = np.array([xxhash.xxh3_64_intdigest(raw[a : b + depth], p - a) for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist())], np.uint64)
        shift = np.array([a for _, a, _ in held])[of] - base[of]
        out.append((np.array([i for i, _, _ in held])[of], fp[at], ctx, at + shift, lo + shift, hi + shift))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _deal(parts: int, part: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One row a part: the part, and its rows column by column, so that like bytes are together."""
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1]) if len(part) else np.zeros(0, int)
    blobs = [b"".join(np.ascontiguousarray(x[f]).tobytes() for f in rows.dtype.names) for x in np.split(rows, cuts[1:])] if len(part) else []
    return pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _undeal(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    out = []
    for blob in table.column("blob").to_pylist():
        rows, p = np.empty(len(blob) // dtype.itemsize, dtype), 0
        for f in dtype.names:
            size = len(rows) * dtype[f].itemsize
            rows[f] = np.frombuffer(blob, dtype[f].base, offset=p, count=size // dtype[f].base.itemsize).reshape(rows[f].shape)
            p += size
        out.append(rows)
    return np.concatenate(out) if out else np.empty(0, dtype)


def _once(rows: np.ndarray, *fields: str) -> np.ndarray:
    """Rows in order of ``fields`` and occurrence, one of each: repeated rows of a document are one."""
    keys = (*fields, "doc", "text", "at")
    r = rows[np.lexsort([rows[k] for k in reversed(keys)])]
    new = np.ones(len(r), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= r[k][1:] != r[k][:-1]
    return r[new]


def _heads(r: np.ndarray) -> np.ndarray:
    """Which rows, in order of anchor and surroundings, are the first of theirs."""
    return np.concatenate([[True], (r["fp"][1:] != r["fp"][:-1]) | (r["ctx"][1:] != r["ctx"][:-1])])[: len(r)]


def _list(depth: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                doc, hash_ = part.column("doc_id").fill_null(-(1 << 63)).to_numpy(), part.column("text_hash").to_numpy()
                of, *cols = anchors(text_bytes(part), depth)
                rows = np.empty(len(of), _AT)
                for f, c in zip(("fp", "ctx", "at", "lo", "hi"), cols):
                    rows[f] = c
                rows["doc"], rows["text"] = doc[of], hash_[of]
                # Of equal surroundings here only the first goes on as an anchor, to the part of its surroundings.
                # For the rest all is known: at = -1 says so. They go by document and stretch of it, so that a passage
                # of many documents is no hot key, and in that order, so that like numbers are together.
                rows = _once(rows, "fp", "ctx")
                later = ~_heads(rows)
                known, rows = rows[later], rows[~later]
                known = known[np.lexsort((known["lo"], known["text"], known["doc"]))]
                known["at"], known["fp"], known["ctx"] = -1, 0, 0
                by = np.concatenate([rows["fp"] ^ _mix(rows["ctx"]), known["doc"].view(_U) ^ _mix(known["text"].view(_U) ^ _mix(known["lo"].view(_U) >> _U(20)))])
                yield _deal(parts, (_mix(by) >> _U(33)).astype(np.int64) % parts, np.concatenate([rows, known]))

    return run


def _rows(kind: int, r: np.ndarray) -> list:
    return [np.full(len(r), kind, np.int32), r["fp"].astype(np.int64), r["doc"], r["text"], r["at"], r["lo"], r["hi"]]


def _same_surroundings(table: pa.Table) -> pa.Table:
    """kind 0: ranges of string starts known to be repeats; kind 1: the first anchor of each surroundings."""
    rows = _undeal(table, _AT)
    known, rows = rows[rows["at"] < 0], rows[rows["at"] >= 0]
    r = _once(rows, "fp", "ctx")
    first = _heads(r)
    cols = [np.concatenate(x) for x in zip(_rows(0, known), _rows(0, r[~first]), _rows(1, r[first]))]
    return pa.table(dict(zip(("kind", "fp", "doc_id", "text_hash", "at", "lo", "hi"), map(pa.array, cols))))


def _side_dtype(depth: int) -> np.dtype:
    side = depth - GRAM
    return np.dtype([("fp", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("at", "<i8"), ("lo", "<i8"), ("hi", "<i8"), ("left", "u1", (side,)), ("right", "u1", (side,))])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each document its id (the least for null), text hash, text and the columns fp, at, lo, hi asked of it;
    a repeated row of a document once, as the join brings them one after another."""
    seen = None
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            texts, lists = text_bytes(batch), batch.column("asked")
            ends, flat = lists.offsets.to_numpy(), lists.values
            cols = [flat.field(f).to_numpy() for f in ("fp", "at", "lo", "hi")]
            doc, hash_ = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(), batch.column("text_hash").to_numpy()
            for i, text in enumerate(texts):
                if seen != (doc[i], hash_[i]):
                    seen = doc[i], hash_[i]
                    yield doc[i], hash_[i], text, *(c[ends[i] : ends[i + 1]] for c in cols)


def _surroundings(depth: int, parts: int):
    dtype, side = _side_dtype(depth), depth - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.arange(side)
        for doc, hash_, text, *asked in _asked(batches):
            t = np.concatenate([np.zeros(side, np.uint8), np.frombuffer(text, np.uint8), np.zeros(side, np.uint8)])
            for some in range(0, len(asked[0]), 8192):  # a long text has very many
                fp, at, lo, hi = (x[some : some + 8192] for x in asked)
                rows = np.zeros(len(fp), dtype)
                rows["fp"], rows["at"], rows["lo"], rows["hi"] = fp.view(np.uint64), at, lo, hi
                rows["doc"], rows["text"] = doc, hash_
                p = at[:, None] + side
                # The left side is read away from the anchor. What no string of the anchor holds is zero.
                rows["left"] = np.where(near < (at - lo)[:, None], t[p - 1 - near], 0)
                rows["right"] = np.where(near < (hi + depth - GRAM - at)[:, None], t[p + GRAM + near], 0)
                yield _deal(parts, ((rows["fp"] >> _U(17)) % _U(parts)).astype(np.int64), rows)

    return run


def _halves(depth: int):
    """Anchors by a longer gram: those of the strings that have half of the rest to the left of it, and those
    that have more than half to the right."""
    half = (depth - GRAM) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, hash_, text, _, at, lo, hi in _asked(batches):
            rows = [], [], [], []
            for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
                for low, high, start, seed in ((a, min(b, p - half), p - half, 1), (max(a, p - half + 1), b, p, 2)):
                    if low <= high:
                        key = xxhash.xxh3_64_intdigest(text[start : start + GRAM + half], seed) - (1 << 63)
                        for c, v in zip(rows, (key, p, low, high)):
                            c.append(v)
            n = len(rows[0])
            cols = [np.full(n, doc), np.full(n, hash_), *(np.array(c, np.int64) for c in rows)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["doc_id", "text_hash", "fp", "at", "lo", "hi"])

    return run


def _strings(depth: int):
    """Each string of the anchors by a hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, hash_, text, _, _, lo, hi in _asked(batches):
            at = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[p : p + depth]) for p in at.tolist()), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), hash_)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(at)], names=["doc_id", "text_hash", "h1", "h2", "at"])

    return run


def interleave(start: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by ``start`` and then their symbols (bytes of a row), and how many symbols each row
    in that order has in common with the one before; -1 where ``start`` differs.

    Rounds refine the runs that are tied so far, eight symbols each; rows whose run is settled are left."""
    n, size = symbols.shape
    wide = np.zeros((n, -(-size // 8) * 8), np.uint8)
    wide[:, :size] = symbols
    words = wide.view(">u8").astype(np.uint64)
    order = np.argsort(start, kind="stable")
    s = start[order]
    common = np.full(n, size, np.int64)
    edge = np.concatenate([[True], s[1:] != s[:-1]])[:n]
    common[edge] = -1
    for c in range(words.shape[1]):
        run = np.cumsum(edge) - 1
        tied = np.flatnonzero((np.bincount(run, minlength=1) > 1)[run]) if n else np.zeros(0, int)
        if not len(tied):
            break
        w = words[order[tied], c]
        again = np.lexsort((w, run[tied]))
        order[tied] = order[tied][again]
        w, r = w[again], run[tied]
        part = np.flatnonzero((w[1:] != w[:-1]) & (r[1:] == r[:-1])) + 1
        apart = w[part] ^ w[part - 1]
        # Leading zero bytes of the difference, from the place of its highest bit.
        high = np.zeros(len(apart), np.int64)
        for shift in (32, 16, 8):
            up = (apart >> _U(shift)) > 0
            high += up * (shift // 8)
            apart = np.where(up, apart >> _U(shift), apart)
        common[tied[part]] = np.minimum(8 * c + 7 - high, size)
        edge[tied[part]] = True
    return order, common


def repeated(rows: np.ndarray, depth: int) -> np.ndarray:
    """For rows of _side_dtype in order of occurrence: which offsets before the anchor start a string that
    starts earlier too; a row of depth - GRAM + 1 flags each."""
    side, n = depth - GRAM, len(rows)
    out = np.zeros((n, side + 1), bool)
    classes = []
    for f in ("left", "right"):
        order, common = interleave(rows["fp"], rows[f])
        classes.append((order, common))
    least, most = rows["at"] - rows["hi"], rows["at"] - rows["lo"]
    for o in range(side + 1):
        use = np.flatnonzero((least <= o) & (o <= most))
        if len(use) < 2:
            continue
        key = np.zeros(n, np.int64)
        for (order, common), needed in zip(classes, (o, side - o)):
            named = np.empty(n, np.int64)
            named[order] = np.cumsum(common < needed)  # an interval with that much in common has one name
            key = key * (n + 1) + named
        _, first, place = np.unique(key[use], return_index=True, return_inverse=True)
        out[use, o] = first[place] != np.arange(len(use))
    return out


def _merge(depth: int):
    dtype = _side_dtype(depth)

    def run(table: pa.Table) -> pa.Table:
        rows = _undeal(table, dtype)
        rows = _once(rows, "fp", "lo", "hi")  # an anchor at a cut of a long text is two rows, of different strings
        bounds = np.concatenate([[0], np.flatnonzero(rows["fp"][1:] != rows["fp"][:-1]) + 1, [len(rows)]])
        out, at = [], 0
        while at < len(bounds) - 1:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 50_000, side="right")) - 1)
            some = rows[bounds[at] : bounds[end]]  # whole anchors
            some = some[np.lexsort((some["at"], some["text"], some["doc"]))]
            flags = repeated(some, depth)[:, ::-1]  # now in order of start
            padded = np.pad(flags.astype(np.int8), ((0, 0), (1, 1)))
            step = np.diff(padded, axis=1)
            (i, a), (_, b) = np.nonzero(step == 1), np.nonzero(step == -1)
            base = some["at"][i] - (depth - GRAM)
            out.append((some["doc"][i], some["text"][i], base + a, base + b - 1))
            at = end
        cols = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("doc_id", "text_hash", "lo", "hi"), map(pa.array, cols))))

    return run


def _stretches(lo: np.ndarray, hi: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each stretch that strings with starts from lo to hi cover together."""
    order = np.argsort(lo, kind="stable")
    first, end = lo[order], np.maximum.accumulate(hi[order] + depth)
    new = np.concatenate([[True], first[1:] > end[:-1]])[: len(first)]
    return first[new], np.append(end[:-1][new[1:]], end[-1:])


def _remove(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):  # so that texts of few rows are held again
                batch = whole.slice(at, 1000)
                cols = [[], [], [], []]
                for text, found in zip(text_bytes(batch), batch.column("found")):
                    kept, gone, spans = text, 0, 0
                    if found.is_valid and len(found.values):
                        first, end = _stretches(*(found.values.field(f).to_numpy() for f in ("lo", "hi")), depth)
                        gone, spans = int((end - first).sum()), len(first)
                        kept = b"".join([text[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(text)])])
                    for c, v in zip(cols, (len(text), gone, spans, kept)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _null(doc: str = "doc_id") -> Column:
    """Ids that are null travel as the least."""
    return F.when(F.col(doc) > -(1 << 63), F.col(doc))


def _texts(docs: DataFrame, anchors_: DataFrame) -> DataFrame:
    asked = anchors_.groupBy(_null().alias("d"), F.col("text_hash").alias("t")).agg(F.collect_list(F.struct("fp", "at", "lo", "hi")).alias("asked"))
    return docs.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).select("doc_id", "text_hash", "text", "asked")


def _shared(anchors_: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Of anchors (fp, doc_id, text_hash, at, lo, hi) those whose gram others have too: of grams that a task
    holds, of grams with more surroundings than that, and how many of each there are."""
    grams = written(anchors_.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("hot", F.col("n") > HOT), f"{name}-grams")
    met = written(spread_join(anchors_, grams, ["fp"], "text_hash").select("hot", "fp", "doc_id", "text_hash", "at", "lo", "hi"), f"{name}-shared")
    sums = {r["hot"]: r["n"] for r in grams.groupBy("hot").agg(F.sum("n").alias("n")).collect()}
    return met.filter("not hot"), met.filter("hot"), sums.get(False, 0), sums.get(True, 0)


def repeat_ranges(docs: DataFrame, depth: int = 100) -> DataFrame:
    """doc_id, text_hash, lo, hi: starts of strings that start earlier too, for ``docs`` with doc_id, text
    and text_hash."""
    spark, side = docs.sparkSession, depth - GRAM
    # A hash is least among a string's grams at two of side + 2 places.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = group_count(spark, size * 2 / (side + 2) * _AT.itemsize)
    listed = docs.mapInArrow(_list(depth, parts), "part int, blob binary")
    rows = written(grouped(listed, "part", parts).applyInArrow(_same_surroundings, _ROW), "anchors")

    def compared(anchors_: DataFrame, n: int) -> DataFrame:
        groups = group_count(spark, n * _side_dtype(depth).itemsize)
        return grouped(_texts(docs, anchors_).mapInArrow(_surroundings(depth, groups), "part int, blob binary"), "part", groups).applyInArrow(_merge(depth), _RANGE)

    few, many, n_few, n_many = _shared(rows.filter("kind = 1"), "anchor")
    out = rows.filter("kind = 0").select("doc_id", "text_hash", "lo", "hi").unionAll(compared(few, n_few))
    if n_many:
        halves = written(_texts(docs, many).mapInArrow(_halves(depth), "doc_id long, text_hash long, fp long, at long, lo long, hi long"), "halves")
        few, many, n_few, n_many = _shared(halves, "half")
        out = out.unionAll(compared(few, n_few))
    if n_many:
        strings = written(_texts(docs, many).mapInArrow(_strings(depth), "doc_id long, text_hash long, h1 long, h2 long, at long"), "strings")
        place = lambda: F.struct("doc_id", "text_hash", "at")
        first = written(strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place()).alias("first")).filter("n > 1"), "first-strings")
        later = spread_join(strings, first, ["h1", "h2"], "at").filter(place() != F.col("first"))
        out = out.unionAll(later.select("doc_id", "text_hash", F.col("at").alias("lo"), F.col("at").alias("hi")))
    return out.withColumn("doc_id", _null())


def remove_repeats(docs: DataFrame, depth: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every row of ``docs``: each byte goes that is
    covered by a string of ``depth`` bytes which starts earlier too, in a document of smaller id or in the
    same one. Strings are judged on the texts as given and never cross documents.

    A null text is empty. A null id is less than all others; rows of one id with different texts are
    documents in a fixed order, and rows of one id and text are one document, whose result each of them
    gets. Texts of any length are cut only for work, not for results. Columns beside id and text are left out, whatever
    their names. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    found = repeat_ranges(base, depth).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    met = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select("doc_id", "text", "found")
    return met.mapInArrow(_remove(depth), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


"""Match ratios of texts by matching blocks, and their use on pages and in documents."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: In texts of this many characters or more, characters that are over a hundredth of the second text start no block.
POPULAR_FROM = 200
#: Cells of two texts that are compared as the bits of one number; larger ones go row by row.
_CELLS = 1 << 26
#: A match of a cursor looks this far back and ahead, and has this score at least.
BACK, AHEAD, FLOOR = 1, 6, 0.30


def dedupe_key(text: str | None) -> str:
    """The text in lower case without tags, entities decoded, of word characters only."""
    text = re.sub(r"<[^>]+>", "", text or "")
    if "&#" in text:  # unescape() fails on numbers of over 4,300 digits; none of eight is a character
        text = re.sub(r"&#[1-9][0-9]{7,};?", "\ufffd", re.sub(r"&#0+(?=[0-9])", "&#", text))
    return re.sub(r"\W+", "", unescape(text).lower())


@F.pandas_udf(StringType())
def _keys(texts: pd.Series) -> pd.Series:
    return texts.map(dedupe_key)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _popular(y: str) -> set[str]:
    """Characters of y that are too frequent to start a block."""
    return {c for c, n in Counter(y).items() if n > len(y) // 100 + 1} if len(y) >= POPULAR_FROM else set()


def _grid(x: str, y: str, popular: set[str]) -> tuple[int, int]:
    """Which places of x and y can start a block, as the bits of one number, and the bits of a row: a row is a place of
    x, and ends with at least one bit that is never set, so that a block is set bits at a fixed distance."""
    size = len(y) // 8 + 1
    places = dict.fromkeys(set(x) - popular, 0)
    for j, c in enumerate(y):
        if c in places:
            places[c] |= 1 << j
    rows, none = {c: v.to_bytes(size, "little") for c, v in places.items()}, bytes(size)
    return int.from_bytes(b"".join([rows.get(c, none) for c in x]), "little"), 8 * size


def _part(grid: int, width: int, rows: int, blo: int, bhi: int) -> int:
    """The first rows of a grid, of the places from blo to bhi of y alone."""
    return grid & int.from_bytes((((1 << bhi) - (1 << blo)).to_bytes(width // 8, "little")) * rows, "little")


def _first_longest(part: int, width: int) -> tuple[int, int, int]:
    """Row, place and size of the longest block in a part of the grid, the first of equals: starts of blocks of
    1, 2, 4 ... are found by shifts of all at once, then the sizes between."""
    if not part:
        return 0, 0, 0
    doubled, size = [part], 1
    while longer := doubled[-1] & (doubled[-1] >> size * (width + 1)):
        doubled.append(longer)
        size *= 2
    starts = doubled.pop()
    while doubled:
        if longer := starts & (doubled.pop() >> size * (width + 1)):
            starts, size = longer, size + (1 << len(doubled))
    return *divmod((starts & -starts).bit_length() - 1, width), size


def _longest_by_rows(a: np.ndarray, b: np.ndarray, usable: np.ndarray) -> tuple[int, int, int]:
    """As _first_longest(), of two texts whose grid is too large to hold."""
    i = j = size = 0
    run = np.zeros(len(b) + 1, np.int32)
    for row, c in enumerate(a):
        run[1:] = np.where((b == c) & usable, run[:-1] + 1, 0)
        at = int(run.argmax())
        if run[at] > size:
            size = int(run[at])
            i, j = row - size + 1, at - size
    return i, j, size


def match_ratio(x: str, y: str, least: float = 0.0) -> float:
    """Twice the characters in matching blocks over those of both texts: the longest block, then those of what is to
    the left and to the right of it. A ratio below ``least`` need not be worked out: what is returned is then
    some bound of it that is below ``least`` too."""
    if not x and not y:
        return 1.0
    popular, total = _popular(y), len(x) + len(y)
    small = len(x) * len(y) <= _CELLS
    if small:
        grid, width = _grid(x, y, popular)
    else:
        a, b = codes(x), codes(y)
        usable = ~np.isin(b, codes("".join(popular)))
        grid = width = 0
    # What is left can't match more than the shorter side of each part; large parts come first.
    matched, left, todo = 0, min(len(x), len(y)), deque([(0, len(x), 0, len(y), grid)])
    while todo:
        if 2 * (matched + left) / total < least:
            return 2 * (matched + left) / total
        alo, ahi, blo, bhi, part = todo.popleft()
        left -= min(ahi - alo, bhi - blo)
        if alo < ahi and blo < bhi:
            if small:
                part = _part(part, width, ahi - alo, blo, bhi)
                i, j, size = _first_longest(part, width)
            else:
                i, j, size = _longest_by_rows(a[alo:ahi], b[blo:bhi], usable[blo:bhi])
                j += blo
            # What can't start a block may still be one beside nothing: the part's first places.
            i, j = (i + alo, j) if size else (alo, blo)
            while i > alo and j > blo and x[i - 1] == y[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and x[i + size] == y[j + size]:
                size += 1
            if size:
                matched += size
                for p in ((alo, i, blo, j, part), (i + size, ahi, j + size, bhi, part >> (i + size - alo) * width)):
                    if p[0] < p[1] and p[2] < p[3]:
                        left += min(p[1] - p[0], p[3] - p[2])
                        todo.append(p)
    return 2 * matched / total


def match_score(a: str, b: str, least: float = 0.0) -> float:
    """The greater of the match ratio and, where the shorter key is in the longer one, the share it has of it. As with
    the ratio, a score below ``least`` need not be worked out."""
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    return max(len(short) / len(long) if short in long else 0.0, match_ratio(a, b, least))


def _letters(keys: list[str]) -> np.ndarray:
    """How often each key has each character of any."""
    flat = codes("".join(keys))
    seen, at = np.unique(flat, return_inverse=True)
    of = np.repeat(np.arange(len(keys)), np.fromiter(map(len, keys), np.int64, len(keys)))
    return np.bincount(of * len(seen) + at, minlength=len(keys) * len(seen)).reshape(len(keys), len(seen))


def first_similar(keys: list[str], ratio: float) -> list[int | None]:
    """For each key the first earlier one whose match ratio with it reaches ``ratio``; none for an empty key, and no
    empty key is found. No ratio is above what the letters in common allow, which rules most out."""
    place: dict[str, int] = {}
    for i, k in enumerate(keys):
        place.setdefault(k, i)
    distinct = [k for k in place if k]
    letters, size = _letters(distinct), np.fromiter(map(len, distinct), np.int64, len(distinct))
    found: dict[str, int | None] = {}
    for i, k in enumerate(distinct):
        near = 2 * np.minimum(letters[:i], letters[i]).sum(1) >= ratio * (size[:i] + size[i])
        found[k] = next((place[distinct[j]] for j in np.flatnonzero(near) if match_ratio(k, distinct[j], ratio) >= ratio), None)
    # A copy has the same earlier keys before it, and its first occurrence.
    return [None if not k else found[k] if found[k] is not None else place[k] if place[k] < i else None for i, k in enumerate(keys)]


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as shuffles have: a small row can be long work, so tasks aren't joined by
    their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _first_similar_of_blocks(block: list[str], ratio: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts, types = None, [], [], []

        def found() -> pa.RecordBatch:
            out = [None if j is None else ids[j] for j in first_similar([dedupe_key(t) for t in texts], ratio)]
            columns = [pa.array([k] * len(ids), t) for k, t in zip(key, types)] + [pa.array(ids, pa.int64()), pa.array(out, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[*block, "id", "similar_to"])

        for batch in batches:
            types = [batch.schema.field(b).type for b in block]
            for new, id_, text in zip(zip(*(batch.column(b).to_pylist() for b in block)), batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if new != key:
                    if ids:
                        yield found()
                    key, ids, texts = new, [], []
                ids.append(id_)
                texts.append(text)
        if ids:
            yield found()

    return run


def similar_texts(rows: DataFrame, block: list[str], ratio: float = 0.95) -> DataFrame:
    """block, id, similar_to: the first earlier text of the block whose match ratio, of dedupe keys, reaches
    ``ratio``; an empty key is like no other. Blocks are pages of a file, so what is compared is small; copies are
    compared once. A block's rows stream by in order, and one block is held."""
    types = dict(rows.dtypes)
    ordered = _dealt(rows.select(*block, F.col("id").cast("long").alias("id"), "text"), *block).sortWithinPartitions(*block, "id")
    return ordered.mapInArrow(_first_similar_of_blocks(block, ratio), ", ".join([*(f"{b} {types[b]}" for b in block), "id long", "similar_to long"]))


class Cursor:
    """The state of one document's fold: entries from the one before the cursor on, and the cursor."""

    def __init__(self):
        self.entries: list[tuple[int, str, Counter]] = []
        self.first = self.cursor = 0

    def add(self, entry: int, key: str) -> None:
        self.entries.append((entry, key, Counter(key)))

    def match(self, key: str) -> tuple[int | None, float]:
        """The best entry in reach, the first of equals, and its score; the cursor goes behind it and never back."""
        best, score = None, 0.0
        if key:
            # The most alike by letters come first; what can't reach the best any more is passed over.
            letters, reach = Counter(key), []
            for place in range(max(0, self.cursor - BACK), min(self.first + len(self.entries), self.cursor + AHEAD)):
                _, other, own = self.entries[place - self.first]
                reach.append((-2 * (letters & own).total() / (len(key) + len(other)), place, other))
            for bound, place, other in sorted(reach):
                if best is None or -bound > score or -bound == score and place < best or len(key) != len(other) and (key in other or other in key):
                    s = match_score(key, other, score)
                    if best is None or s > score or s == score and place < best:
                        best, score = place, s
        if best is None or score < FLOOR:
            return None, score
        found = self.entries[best - self.first][0]
        self.cursor = max(self.cursor, best + 1)
        passed = max(self.cursor - BACK, 0) - self.first
        if passed > 0:
            del self.entries[:passed]
            self.first += passed
        return found, score


def _fold(doc_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, state = None, Cursor()
        for batch in batches:
            out = []
            for new, kind, id_, key in zip(*(batch.column(c).to_pylist() for c in ("doc", "kind", "id", "key"))):
                if new != doc:
                    doc, state = new, Cursor()
                if kind:
                    out.append((doc, id_, *state.match(key)))
                else:
                    state.add(id_, key)
            doc_, id_, entry, score = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc_, doc_type), pa.array(id_, pa.int64()), pa.array(entry, pa.int64()), pa.array(score, pa.float64())], names=["doc", "id", "entry", "score"])

    return run


def cursor_matches(items: DataFrame, entries: DataFrame) -> DataFrame:
    """doc, id, entry, score: for each item the entry of its document that is most like it among those from one
    before to five after the cursor, if its score is 0.30 or more; the cursor then goes behind that entry. Both sides
    have doc, id (their order) and text; keys are compared, and entries without one don't count.

    A document is one fold over rows in order: an item's cursor is at most six entries further than the item before
    had it, so an entry need only come before the item of a sixth of its place, and rows stream by. What is held
    are the entries from the cursor on, by key alone."""
    doc_type = dict(items.dtypes)["doc"]
    keyed = lambda df, kind: df.filter("doc IS NOT NULL").select("doc", F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), _keys("text").alias("key"))
    rows = keyed(entries, 0).filter("key <> ''").unionAll(keyed(items, 1))
    place = F.row_number().over(Window.partitionBy("doc", "kind").orderBy("id")) - 1
    rows = rows.withColumn("at", F.when(F.col("kind") == 0, F.floor(place / AHEAD)).otherwise(place).cast("long"))
    ordered = _dealt(rows, "doc").sortWithinPartitions("doc", "at", "kind", "id")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[doc_type]
    return ordered.mapInArrow(_fold(arrow), f"doc {doc_type}, id long, entry long, score double")

"""Segmentation of Han text by a dictionary: a word graph over a trie, the best path by word weights."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a dictionary that tasks are sent: it is a parameter, and more is an error.
MAX_WORDS = 1_000_000
#: Java's names; what is no letter, mark or number parts words.
GAP, HAN_OR_NOT = r"[^\p{L}\p{M}\p{N}]+", r"\p{IsHan}+|\P{IsHan}+"
#: Cells of a graph (32 MB), and rows whose pieces are segmented at once.
CELLS, ROWS = 1 << 22, 256
#: A Han character that is part of words, the ranges first as they rule most others out. The last of a run is left out,
#: each other one is followed by the next, and one alone stays. Java looks behind by code points only where the pattern
#: itself has one beyond 16 bits.
_HAN_LETTER = "[\\x{2e80}-\\x{a000}\\x{f900}-\\x{faff}\U00016f00-\U0003fffd&&[\\p{IsHan}]&&[\\p{L}\\p{M}\\p{N}]]"
_BIGRAM = "(?<=H)H(?!H)|(H)(?=(H))|(H)".replace("H", _HAN_LETTER)
_CHAR = np.uint64(21)
_NONE = -np.inf
_HAN = regex.compile(r"\p{Han}")


class Trie:
    """A dictionary's words as edges (node, character) to nodes, sorted, so that all places of a text walk it at
    once; a node that ends a word has the logarithm of the word's share of all weight."""

    def __init__(self, words: Iterable[tuple[str, float]]):
        weights: dict[str, float] = {}
        for word, weight in words:
            if word and weight > 0:
                weights[word] = max(weight, weights.get(word, 0.0))
        if len(weights) > MAX_WORDS:
            raise ValueError(f"a dictionary of {len(weights)} words; {MAX_WORDS} are the most")
        total = max(sum(weights.values()), 1.0)
        edges: dict[tuple[int, int], int] = {}
        value = [_NONE]
        for word, weight in weights.items():
            node = 0
            for c in word:
                following = edges.get((node, ord(c)))
                if following is None:
                    following = edges[node, ord(c)] = len(value)
                    value.append(_NONE)
                node = following
            value[node] = float(np.log(weight / total))
        keys = np.array([(n << 21) | c for n, c in edges], np.uint64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.value, self.longest = np.array(value), max(map(len, weights), default=1)
        #: A character that is no word counts as one of weight 1.
        self.unknown = float(np.log(1 / total))

    def graph(self, codes: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each length (row, from 1) and place: the weight of the word there, -inf where there is none. A word
        stays in its run, whose end each place has in ``end``."""
        out = np.full((self.longest, len(codes)), _NONE)
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for length in range(self.longest):
            if not len(at) or not len(self.keys):
                break
            key = (node.astype(np.uint64) << _CHAR) | codes[at + length]
            found = np.searchsorted(self.keys, key)
            found[found == len(self.keys)] = 0
            ok = self.keys[found] == key
            at, node = at[ok], self.nodes[found[ok]]
            out[length, at] = self.value[node]
            inside = at + length + 1 < end[at]
            at, node = at[inside], node[inside]
        return out


def best_paths(graph: np.ndarray, starts: np.ndarray, unknown: float) -> np.ndarray:
    """For each place the length of the word that the best path from it takes. Of equal paths the one whose word is
    longer is taken. ``starts``: where runs begin.

    Places that no word crosses part a run, and the parts are worked through from their ends side by side, so
    the steps are as many as the longest part has characters."""
    longest, n = graph.shape
    open_ = np.zeros(n + 1, np.int64)
    for length in range(1, longest):
        i = np.flatnonzero(graph[length] > _NONE)
        np.add.at(open_, i + 1, 1)
        np.add.at(open_, i + length + 1, -1)
    cut = np.cumsum(open_[:n]) == 0
    cut[starts] = True
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n)
    size = last - first
    order = np.argsort(-size, kind="stable")
    ends, sizes = last[order], size[order]
    score, take = np.zeros(n), np.ones(n, np.int64)
    alone = np.where(graph[0] > _NONE, graph[0], unknown)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        own = ends[: np.searchsorted(-sizes, -t, side="left")]
        at = own - 1 - t
        best = np.full(len(at), _NONE)
        for length in range(1, min(longest, t + 1) + 1):
            w = alone[at] if length == 1 else graph[length - 1, at]
            rest = 0.0 if length == t + 1 else score[at + length]
            better = w + rest >= best
            better &= w > _NONE
            best, take[at] = np.where(better, w + rest, best), np.where(better, length, take[at])
        score[at] = best
    return take


def bigrams(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(len(run) - 1)] or [run]


def _known(trie: Trie, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bool], dict[int, set[int]]]:
    """What segments need of a text's graph: the word that the best path takes at each place, whether a place's
    character is a word, and where words of two and three begin."""
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    graph = trie.graph(codes, np.repeat(ends, sizes))
    known = lambda length: np.flatnonzero(graph[length - 1] > _NONE).tolist() if length <= trie.longest else ()
    return best_paths(graph, starts[sizes > 0], trie.unknown).tolist(), (graph[0] > _NONE).tolist(), {m: set(known(m)) for m in (2, 3)}


def blocks(trie: Trie, runs: list[str]) -> Iterator[list[str]]:
    """Runs in order, as many at once as a graph of CELLS cells has room for, but at least one."""
    some, n, most = [], 0, max(1, CELLS // trie.longest)
    for run in runs:
        if some and n + len(run) > most:
            yield some
            some, n = [], 0
        some.append(run)
        n += len(run)
    if some:
        yield some


def segment(trie: Trie, runs: list[str]) -> list[list[str]]:
    """The tokens of each run: words of the best path, each after those words of two and three characters in it that
    the dictionary has; characters in a row that are no words as bigrams, one alone as it is."""
    return [tokens for some in blocks(trie, runs) for tokens in _segment(trie, some)]


def _segment(trie: Trie, runs: list[str]) -> list[list[str]]:
    codes = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    take, alone, known = _known(trie, codes, np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs))))
    out, base = [], 0
    for run in runs:
        tokens, i, loose = [], 0, 0
        while i <= len(run):
            length = take[base + i] if i < len(run) else 0
            word = length > 1 or length == 1 and alone[base + i]
            if (word or not length) and loose < i:
                tokens += bigrams(run[loose:i])
            if not length:
                break
            if word:
                tokens += [run[j : j + m] for m in (2, 3) if length > m for j in range(i, i + length - m + 1) if base + j in known[m]]
                tokens.append(run[i : i + length])
                loose = i + length
            i += length
        out.append(tokens)
        base += len(run)
    return out


def pieces(text: Column) -> Column:
    """Words of the lower-case text, runs of Han characters apart from others, in order."""
    runs = F.filter(F.split(F.lower(text), GAP), lambda t: t != "")
    apart = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(HAN_OR_NOT), F.lit(0))))
    return F.when(text.rlike(r"\p{IsHan}"), apart).otherwise(runs)


def bigram_words(text: Column) -> Column:
    """Words of the lower-case text in order, with repeats; a run of Han characters as its bigrams. One pass of one
    pattern writes the bigrams out, so no function is called for each of them."""
    low = F.lower(text)
    apart = F.when(low.rlike(_HAN_LETTER), F.regexp_replace(low, _BIGRAM, " $1$2$3 ")).otherwise(low)
    return F.array_remove(F.split(apart, GAP), "")


def segmenter(words: Iterable[tuple[str, float]]) -> Callable[[Column], Column]:
    """As bigram_words(), with runs of Han characters segmented by a dictionary of (word, weight): a function from
    a text column to its words. The dictionary is a parameter and goes to the tasks."""
    trie = Trie(words)

    @F.arrow_udf("array<string>")
    def tokens(lists: pa.Array) -> pa.Array:
        # Row by row into a builder's worth of distinct pieces: each is segmented once, and a row lists its tokens.
        parts = []
        for first in range(0, len(lists), ROWS):
            rows = lists.slice(first, ROWS)
            coded = rows.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            # A piece is all Han or has none; the first character tells.
            han = [bool(_HAN.match(p)) for p in names]
            found = iter(segment(trie, [p for p, h in zip(names, han) if h]))
            each = pa.array([next(found) if h else [p] for p, h in zip(names, han)], pa.list_(pa.string()))
            taken = each.take(coded.indices)
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)))
            offsets = np.append(0, np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False)))[ends]
            mask = rows.is_null() if rows.null_count else None
            parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken.flatten(), mask=mask))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return lambda text: tokens(pieces(text))

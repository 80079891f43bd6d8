"""Whole texts to token ids with the tokenizers library, each distinct pre-token encoded once per worker.

A text's ids are its pre-tokens' ids in order. Texts of ASCII and Latin letters are cut into pre-tokens here, as the
vocabularies' patterns cut them; pre-tokens are looked up in a bounded table, and those not yet in it go to the library's
model. All other texts, and those that contain the start of a special token, are encoded by the library whole.
"""

from __future__ import annotations

import gc
import re
import zlib
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

#: Letters and white space of the texts that are cut here.
_LETTERS, _WHITE = "A-Za-zÀ-ÖØ-öø-ÿ", r" \t\n\r"
_PLAIN = re.compile(f"[ -~\\t\\n\\r{_LETTERS}]*")
#: Pre-tokens: contractions, letters, digits or neither, each after a space that it takes along; the last space before
#: a word goes with it. The word vocabulary drops white space and takes digits one by one (fixed patterns).
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_PART = re.compile(f"{_SHORT}| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_WHITE}0-9{_LETTERS}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_LOWER_PART = re.compile(f"{_SHORT}|[{_LETTERS}]+|[0-9]|[^{_WHITE}0-9{_LETTERS}]+")
#: Byte-level vocabularies write a byte as itself where it is printable, the others from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_CHAR = {b: b if b in _SHOWN else 256 + b - sum(x < b for x in _SHOWN) for b in range(256)}

_OPEN: dict[str, "WordEncoder"] = {}


class _Places(dict):
    """Numbers pre-tokens as they come; those that are new since the last look are in ``new``."""

    def __init__(self, names: list[str]):
        super().__init__(zip(names, range(len(names))))
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.new.append(part)
        return n


class WordEncoder:
    """``encode(texts)``: all ids in one array, and the number of ids of each text."""

    def __init__(self, path: str, max_words: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.lower = self.tokenizer.normalizer is not None  # the word vocabulary's; the other keeps spaces
        self.model = self.tokenizer.model
        self.max_words = max_words
        self.clear()

    def clear(self) -> None:
        self.place = _Places([])
        self.starts, self.sizes, self.ids = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(8192, np.int32)
        self.uses = np.zeros(1024, np.int64)
        self.words = self.used = 0

    def _forget(self) -> None:
        """Keeps the words used most, half the table at most; words used once go."""
        names, uses, starts, sizes, ids = list(self.place), self.uses[: self.words], self.starts, self.sizes, self.ids
        keep = np.argsort(-uses, kind="stable")[: self.max_words // 2]
        keep = keep[uses[keep] > 1]
        kept = [(names[i], ids[starts[i] : starts[i] + sizes[i]].tolist()) for i in keep.tolist()]
        self.clear()
        self.place = _Places([name for name, _ in kept])
        self._store([x for _, x in kept])

    def _learn(self, parts: list[str]) -> None:
        tokenize, got = self.model.tokenize, []
        for part in parts:
            shown = part.replace(" ", "Ġ") if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_BYTE_CHAR)
            got.append([t.id for t in tokenize(shown)])
        self._store(got)

    def _store(self, got: list[list[int]]) -> None:
        """The ids of the pre-tokens that were numbered last."""
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        total = int(sizes.sum())
        while self.words + len(got) > len(self.starts):
            self.starts, self.sizes, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.uses))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        at = slice(self.words, self.words + len(got))
        self.sizes[at] = sizes
        self.starts[at] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.int32, total)
        self.words += len(got)
        self.used += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        values, counts, at = [], np.zeros(len(texts), np.int64), 0
        gc.disable()  # the tables have no cycles, and each collection would walk them
        try:
            while at < len(texts):  # a few MB at a time
                end, chars = at, 0
                while end < len(texts) and chars < 2_000_000:
                    chars += len(texts[end])
                    end += 1
                got, counts[at:end] = self._encode_some(texts[at:end])
                values.append(got)
                at = end
        finally:
            gc.enable()
        return np.concatenate(values) if values else np.zeros(0, np.int32), counts

    def _parts(self, text: str) -> list[str] | None:
        """Pre-tokens; None where only the library's own patterns will do."""
        if "<|" in text or not _PLAIN.fullmatch(text):
            return None
        return _LOWER_PART.findall(text.lower()) if self.lower else _BYTE_PART.findall(text)

    def _encode_some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.words > self.max_words:
            self._forget()
        words = [self._parts(t) for t in texts]
        sizes = np.fromiter((len(w or ()) for w in words), np.int64, len(words))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(w or () for w in words)), np.int32, int(sizes.sum()))
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        self.uses[: self.words] += np.bincount(at, minlength=self.words)
        n = self.sizes[at]
        odd = [i for i, w in enumerate(words) if w is None]
        ends = np.cumsum(n, dtype=np.int32)  # a few million characters
        total = int(ends[-1]) if len(ends) else 0
        out = self.ids[np.repeat(self.starts[at] - (ends - n), n) + np.arange(total, dtype=np.int32)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        counts = np.diff(upto).astype(np.int64)
        for i in reversed(odd):
            ids = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
            p = int(counts[:i].sum())
            out = np.concatenate([out[:p], np.array(ids, np.int32), out[p:]])
            counts[i] = len(ids)
        return out, counts


def encoder(path: str) -> WordEncoder:
    """One per worker process and file."""
    if path not in _OPEN:
        _OPEN[path] = WordEncoder(path)
    return _OPEN[path]


def with_end(values: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each text's ids."""
    out = np.full(len(values) + len(counts), end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = values
    return out, counts + 1


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

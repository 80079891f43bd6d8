"""Bytes of unknown encoding as text: UTF-8 by a state machine over a batch, GB18030, replacement."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .checks import repaired

#: Leading bytes, how many bytes they lead, and the range of the second byte (fixed values of the encoding).
_LEADS = ((0x00, 0x7F, 1, 0, 0), (0xC2, 0xDF, 2, 0x80, 0xBF), (0xE0, 0xE0, 3, 0xA0, 0xBF), (0xE1, 0xEC, 3, 0x80, 0xBF), (0xED, 0xED, 3, 0x80, 0x9F), (0xEE, 0xEF, 3, 0x80, 0xBF), (0xF0, 0xF0, 4, 0x90, 0xBF), (0xF1, 0xF3, 4, 0x80, 0xBF), (0xF4, 0xF4, 4, 0x80, 0x8F))
_LENGTH, _LOW, _HIGH = (np.zeros(256, np.uint8) for _ in range(3))
for _a, _b, _n, _lo, _hi in _LEADS:
    _LENGTH[_a : _b + 1], _LOW[_a : _b + 1], _HIGH[_a : _b + 1] = _n, _lo, _hi
#: What stands for bytes that GB18030 has no character for; no decoder gives it.
_BAD = "\udfff"
#: Bytes that are looked at side by side, about 40 bytes of memory each, and of the texts that are decoded at once.
SIDE, ROWS_BYTES = 1 << 20, 4 << 20


def valid_utf8(raw: list[bytes]) -> np.ndarray:
    """Which of the byte strings are UTF-8. They are looked at side by side, SIDE bytes at once: every byte is what its
    leading byte, up to three before it, has it be."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    stops = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ok = np.ones(len(raw), bool)
    if not len(data) or data.max() < 0x80:
        return ok
    for a in range(0, len(data), SIDE):
        # Three bytes to either side are seen, as leads of what is here and as what is led.
        low, high = max(a - 3, 0), min(a + SIDE + 3, len(data))
        here = data[low:high]
        if here.max() < 0x80:
            continue
        at = low + np.flatnonzero(_wrong(here, stops, low))
        at = at[(at >= a) & (at < a + SIDE)]
        ok[np.searchsorted(stops, at, side="right")] = False
    return ok


def _wrong(data: np.ndarray, stops: np.ndarray, low: int) -> np.ndarray:
    """Which bytes of ``data`` are not what UTF-8 has there; strings end at ``stops``, counted from ``low`` bytes before
    it. Leads of the last three bytes and what is led in the first three are not looked at whole."""
    ends = stops[np.searchsorted(stops, np.arange(low, low + len(data)), side="right")] - low
    tail = (data & 0xC0) == 0x80
    length = _LENGTH[data]
    wrong = (length == 0) & ~tail
    led = np.zeros(len(data), np.int8)
    for k in (1, 2, 3):
        at = np.flatnonzero(length > k)
        wrong[at] |= at + k >= ends[at]
        at = at[at + k < np.minimum(ends[at], len(data))]
        led[at + k] += 1
        wrong[at] |= ~tail[at + k]
        if k == 1:
            wrong[at] |= (data[at + 1] < _LOW[data[at]]) | (data[at + 1] > _HIGH[data[at]])
    return wrong | tail & (led != 1)


def _mark(error: UnicodeError) -> tuple[str, int]:
    return _BAD, error.end


def texts(raw: list[bytes | None]) -> list[str | None]:
    """Each as UTF-8 if it is that, else as GB18030 if it is that, else as UTF-8 with what is not replaced."""
    codecs.register_error("tallyloom-mark", _mark)
    known = [b"" if r is None else bytes(r) for r in raw]
    out: list[str | None] = []
    for r, b, ok in zip(raw, known, valid_utf8(known).tolist()):
        text = None if r is None else b.decode("utf-8" if ok else "gb18030", "tallyloom-mark")
        out.append(b.decode("utf-8", "replace") if text and _BAD in text else text)
    return out


def by_bytes(column: pa.Array | pa.ChunkedArray, each) -> Iterator[list]:
    """``each`` of the column's values as a list, of texts of about ROWS_BYTES at once."""
    start = 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ROWS_BYTES, side="right")))
        yield each(column.slice(start, stop - start).to_pylist())
        start = stop


def mapped(column: pa.Array, each, kind: pa.DataType) -> pa.Array:
    """``each`` of a batch's values, some MB at once, without Python objects of the whole batch."""
    return pa.chunked_array([pa.array(x, kind) for x in by_bytes(column, each)], kind).combine_chunks()


@F.arrow_udf(StringType())
def _texts(raw: pa.Array) -> pa.Array:
    return mapped(raw, texts, pa.string())


def decoded(raw: Column) -> Column:
    """The text of a binary column: the first of UTF-8 and GB18030 that all its bytes are, else UTF-8 with U+FFFD for
    what is not; then mended where UTF-8 had been read as Latin-1. A byte order mark stays, as the first character."""
    return repaired(_texts(raw))

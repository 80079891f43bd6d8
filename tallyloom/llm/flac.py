"""Media columns as FLAC: mono, 8-bit streams with Rice-coded residuals of linear predictors.

The bit work runs on all frames of a few megabytes at once: one numpy step handles one sample of every
frame. Each stream has a seek table with an entry for each frame, so that frames are decoded on their own
and PCM blocks carry the sample they start at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import split_ranges, text_bytes, written

BLOCK = 1152
UNIT = 192
RATE = 8000
_SEEK, _INFO = 18, 42  # bytes of a seek point; of the marker, a block header and STREAMINFO
_LPC_ORDER, _PRECISION, _SHIFT = 4, 12, 10
#: Fixed predictors of order 0 to 4 (fixed values of the format).
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Bytes of payload per batch of streams, and frames that are worked on at once; both bound memory.
_GROUP_BYTES, _AT_ONCE = 4 << 20, 1000


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """For each ``bits``-bit value, what the CRC register holds after it."""
    c = np.arange(1 << bits, dtype=np.uint32) << max(0, width - bits)
    for _ in range(bits):
        c = ((c << 1) ^ np.where(c >> (width - 1) & 1, poly, 0)) & ((1 << width) - 1)
    return c.astype(np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8, 8), _crc_table(0x8005, 16, 16)


def _crc8(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of the first ``lengths`` bytes of each row."""
    crc = np.zeros(len(rows), np.uint16)
    for i in range(rows.shape[1]):
        crc = np.where(i < lengths, _CRC8[crc ^ rows[:, i]], crc)
    return crc


def _crc16(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of buf[start:end] for each pair. Two bytes a step; an odd length gets a zero byte in front, which
    leaves the register at zero."""
    steps = (ends - starts + 1) // 2
    order = np.argsort(-steps, kind="stable")
    first, left, crc = starts[order], steps[order], np.zeros(len(starts), np.uint16)
    odd = (ends - starts)[order] % 2 == 1
    at = first - odd
    for t in range(int(left[0]) if len(left) else 0, 0, -1):
        n = int(np.searchsorted(-left, -t, side="right"))
        p = at[:n]
        head = buf[np.maximum(p, 0)].astype(np.uint16)
        head[odd[:n] & (left[:n] == t)] = 0
        crc[:n] = _CRC16[crc[:n] ^ (head << 8 | buf[p + 1])]
        at[:n] = p + 2
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _bits(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values`` (under 58 bits) in ``sizes`` bits one after another, as bytes; the sum is whole bytes."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    sizes = np.minimum(sizes, 57)  # what is before is zeros, which the bits start from
    begin = ends - sizes
    word, end = begin >> 6, (begin & 63) + sizes
    v = values.astype(np.uint64)
    over = np.maximum(end - 64, 0).astype(np.uint64)
    main = np.where(end > 64, v >> over, v << np.minimum(64 - end, 63).clip(0).astype(np.uint64))
    main[sizes == 0] = 0
    out = np.zeros((total >> 6) + 2, np.uint64)
    if len(word):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out[word[cut]] = np.bitwise_or.reduceat(main, cut)
        late = np.flatnonzero(end > 64)
        out[word[late] + 1] |= v[late] << (128 - end[late]).astype(np.uint64)
    return out.astype(">u8").view(np.uint8)[: total >> 3]


def _residuals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For frames of one length: predictor (0-2: fixed order, 4: LPC), its coefficients, folded residuals
    (warm-up samples first, unfolded) and the Rice parameter. The one with the fewest bits is taken."""
    n, size = x.shape
    fits = [(0, np.zeros((n, _LPC_ORDER), np.int32), x, 8)]
    for order in (1, 2):
        r = np.concatenate([x[:, :order], np.diff(x, order, axis=1)], axis=1)
        fits.append((order, fits[0][1], r, 8 + 8 * order))
    y = x.astype(np.float64)
    # One solve for the autocorrelation equations of every frame.
    lag = [np.einsum("ij,ij->i", y[:, : size - d], y[:, d:]) for d in range(_LPC_ORDER + 1)]
    g = np.stack([np.stack([lag[abs(i - j)] for j in range(_LPC_ORDER)], -1) for i in range(_LPC_ORDER)], -2)
    g += np.eye(_LPC_ORDER) * (1e-3 * lag[0] + 1)[:, None, None]
    c = np.linalg.solve(g, np.stack(lag[1:], -1)[:, :, None])[:, :, 0]
    q = np.rint(c * (1 << _SHIFT)).clip(-(1 << _PRECISION - 1), (1 << _PRECISION - 1) - 1).astype(np.int32)
    guess = sum(q[:, j : j + 1] * x[:, _LPC_ORDER - 1 - j : size - 1 - j] for j in range(_LPC_ORDER)) >> _SHIFT
    fits.append((_LPC_ORDER, q, np.concatenate([x[:, :_LPC_ORDER], x[:, _LPC_ORDER:] - guess], axis=1), 8 + 8 * _LPC_ORDER + 9 + _PRECISION * _LPC_ORDER))
    best = np.full(n, np.iinfo(np.int64).max)
    kind, coef, rest, rice = np.zeros(n, np.int32), np.zeros((n, _LPC_ORDER), np.int32), np.empty_like(x), np.zeros(n, np.int32)
    for order, q, r, head in fits:
        f = np.where(r >= 0, 2 * r, -2 * r - 1)
        f[:, :order] = r[:, :order]
        for k in range(2, 9):
            bits = head + (f[:, order:] >> k).sum(1) + (k + 1) * (size - order)
            won = bits < best
            if won.any():
                best[won], kind[won], coef[won], rest[won], rice[won] = bits[won], order, q[won], f[won], k
    return kind, coef, rest, rice


def _encode_frames(x: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of samples ``x`` cut at ``sizes``, with their numbers in their stream: bytes and lengths."""
    n, starts = len(sizes), np.cumsum(sizes) - sizes
    # Frame header: sync, block size in 16 bits, 8000 Hz, mono, 8 bits, frame number, block size, CRC-8.
    more = (numbers >= 0x80).astype(int) + (numbers >= 0x800) + (numbers >= 0x10000)
    head = np.zeros((n, 11), np.uint8)
    head[:, :4] = (0xFF, 0xF8, 0x74, 0x02)
    for m in range(4):
        at = np.flatnonzero(more == m)
        v = numbers[at]
        # The lead byte says by its leading ones how many bytes the number has: 110, 1110, 11110.
        head[at, 4] = v if m == 0 else (0xF80 >> m & 0xFF) | v >> 6 * m
        for j in range(m):
            head[at, 5 + j] = 0x80 | v >> 6 * (m - 1 - j) & 0x3F
        head[at, 5 + m], head[at, 6 + m] = sizes[at] - 1 >> 8, sizes[at] - 1 & 255
    length = 7 + more
    head[np.arange(n), length] = _crc8(head, length)
    order_of, rice_of, folded = np.zeros(n, np.int64), np.zeros(n, np.int64), np.empty(len(x), np.int64)
    coefs = np.zeros((n, _LPC_ORDER), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        cells = starts[at][:, None] + np.arange(size)
        order_of[at], coefs[at], rest, rice_of[at] = _residuals(x[cells])
        folded[cells] = rest
    lpc = order_of == _LPC_ORDER
    # A frame's codes: header and type, warm-up samples, LPC fields, residual header, residuals, padding.
    run, inside = split_ranges(sizes)
    k, order = rice_of[run], order_of[run]
    warm = inside < order
    q = np.where(warm, 0, folded >> k)
    value = np.where(warm, folded & 0xFF, (1 << k) | (folded & ((1 << k) - 1)))
    width = np.where(warm, 8, q + 1 + k)
    fields = np.zeros((n, 12), np.int64), np.zeros((n, 12), np.int64)
    fields[0][:, :11], fields[1][:, :11] = head, np.where(np.arange(11)[None, :] <= length[:, None], 8, 0)
    fields[0][:, 11], fields[1][:, 11] = np.where(lpc, 32 + _LPC_ORDER - 1, 8 + order_of) << 1, 8
    middle = np.zeros((n, _LPC_ORDER + 2), np.int64), np.zeros((n, _LPC_ORDER + 2), np.int64)
    middle[0][:, 0], middle[1][:, 0] = (_PRECISION - 1) << 5 | _SHIFT, np.where(lpc, 9, 0)
    middle[0][:, 1:-1], middle[1][:, 1:-1] = coefs & (1 << _PRECISION) - 1, np.where(lpc, _PRECISION, 0)[:, None]
    middle[0][:, -1], middle[1][:, -1] = rice_of, 10  # method 0 and partition order 0 lead the parameter
    body = np.bincount(run, weights=width, minlength=n).astype(np.int64) + fields[1].sum(1) + middle[1].sum(1)
    pad = -body % 8
    # Where each code goes among all codes, in order: 12 fields, warm-up, middle, the rest, pad, CRC.
    fixed = 12 + middle[0].shape[1] + 2
    base = np.cumsum(sizes + fixed) - (sizes + fixed)
    total = int((sizes + fixed).sum())
    v, w = np.zeros(total, np.int64), np.zeros(total, np.int64)
    cell = base[:, None] + np.arange(12)
    v[cell], w[cell] = fields
    cell = base[run] + 12 + inside + np.where(warm, 0, middle[0].shape[1])
    v[cell], w[cell] = value, width
    cell = (base + 12 + order_of)[:, None] + np.arange(middle[0].shape[1])
    v[cell], w[cell] = middle
    tail = base + sizes + fixed
    w[tail - 2], w[tail - 1] = pad, 16
    out = _bits(v, w)
    lengths = (body + pad) // 8 + 2
    ends = np.cumsum(lengths)
    crc = _crc16(out, ends - lengths, ends - 2)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 255
    return out, lengths


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of bytes, at least 16; a byte b is the sample b - 128."""
    sizes = [[BLOCK] * (len(p) // BLOCK) + ([len(p) % BLOCK] if len(p) % BLOCK else []) for p in payloads]
    counts = np.array([len(s) for s in sizes])
    _, numbers = split_ranges(counts)
    flat = np.array([s for x in sizes for s in x], np.int64)
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    cuts = np.concatenate([[0], np.cumsum(flat)])
    parts = [_encode_frames(x[cuts[i] : cuts[min(i + _AT_ONCE, len(flat))]], flat[i : i + _AT_ONCE], numbers[i : i + _AT_ONCE]) for i in range(0, len(flat), _AT_ONCE)]
    lengths = np.concatenate([n for _, n in parts])
    out, raw, at, done = [], b"".join(b.tobytes() for b, _ in parts), 0, 0
    for p, s, n in zip(payloads, sizes, counts.tolist()):
        own = lengths[done : done + n]
        points = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        points["sample"], points["offset"], points["size"] = np.arange(n) * BLOCK, np.cumsum(own) - own, s
        low = min(s[:-1], default=s[0])
        info = low.to_bytes(2, "big") + max(s).to_bytes(2, "big") + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes(), usedforsecurity=False).digest()
        end = at + int(own.sum())
        out.append(b"fLaC" + (0 << 24 | 34).to_bytes(4, "big") + info + (0x83 << 24 | _SEEK * n).to_bytes(4, "big") + points.tobytes() + raw[at:end])
        at, done = end, done + n
    return out


class _Reader:
    """A bit position for each frame in one buffer."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        self.words = np.ndarray(len(buf) - 7, ">u8", buf.data, strides=(1,))
        self.at = at.astype(np.int64) * 8

    def peek(self, lanes=slice(None)) -> np.ndarray:
        at = self.at[lanes]
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, bits: int) -> np.ndarray:
        got = (self.peek() >> np.uint64(64 - bits)).astype(np.int64)
        self.at += bits
        return got

    def signed(self, bits: int) -> np.ndarray:
        v = self.take(bits)
        return v - ((v >> (bits - 1)) << bits)

    def rice(self, k: np.ndarray) -> np.ndarray:
        q = np.zeros(len(self.at), np.int64)
        open_ = np.arange(len(q))
        while True:
            top = self.peek(open_) >> np.uint64(32)
            zeros = 32 - np.frexp(top.astype(np.float64))[1]
            q[open_] += zeros
            self.at[open_] += zeros
            open_ = open_[zeros == 32]
            if not len(open_):
                break
        self.at += 1
        rest = np.where(k > 0, self.peek() >> (64 - np.maximum(k, 1)).astype(np.uint64), 0).astype(np.int64)
        self.at += k
        f = q << k | rest
        return f >> 1 ^ -(f & 1)


def _decode_frames(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Samples of the frames buf[start:end], one after another; 16 bytes or more follow the last. Raises
    ValueError on a bad checksum."""
    rows = buf[starts[:, None] + np.arange(16)]
    if (rows[:, :2] != (0xFF, 0xF8)).any() or (rows[:, 3] & 0xFE != 0x02).any():
        raise ValueError("not a mono 8-bit FLAC frame with fixed block size")
    lead = rows[:, 4]
    code = rows[:, 2] >> 4
    length = 5 + (lead >= 0xC0).astype(int) + (lead >= 0xE0) + (lead >= 0xF0) + (lead >= 0xF8) + (code == 6) + 2 * (code == 7)
    if (_crc8(rows, length) != rows[np.arange(len(rows)), length]).any():
        raise ValueError("FLAC frame header checksum differs")
    if (_crc16(buf, starts, ends - 2) != (buf[ends - 2].astype(np.uint16) << 8 | buf[ends - 1])).any():
        raise ValueError("FLAC frame checksum differs")
    body = starts + length + 1
    kind = buf[body] >> 1
    out, first = np.empty(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
    for size, t in sorted(set(zip(sizes.tolist(), kind.tolist()))):
        at = np.flatnonzero((sizes == size) & (kind == t))
        if (buf[body[at]] & 1).any():
            raise ValueError("wasted bits are not supported")
        r, x = _Reader(buf, body[at] + 1), np.zeros((size, len(at)), np.int64)
        if t == 0:
            x[:] = r.signed(8)
        elif t == 1:
            for i in range(size):
                x[i] = r.signed(8)
        elif 8 <= t <= 12 or t >= 32:
            order = t - 8 if t < 32 else t - 31
            for i in range(order):
                x[i] = r.signed(8)
            if t < 32:
                coef, shift = [np.full(len(at), c) for c in _FIXED[order]], 0
            else:
                bits, shift = r.take(4) + 1, r.signed(5)
                coef = []
                for _ in range(order):  # precision may differ from frame to frame
                    v = (r.peek() >> (64 - bits).astype(np.uint64)).astype(np.int64)
                    r.at += bits
                    coef.append(v - ((v >> (bits - 1)) << bits))
            method, parts = r.take(2), r.take(4)
            if (method > 1).any() or len(set(method.tolist())) > 1 or len(set(parts.tolist())) > 1:
                raise ValueError("frames of one shape with different partitions are not supported")
            wide, step = 4 + int(method[0]), size >> int(parts[0])
            for i in range(order, size):
                if i == order or i % step == 0:
                    k = r.take(wide)
                    if (k == (1 << wide) - 1).any():
                        raise ValueError("escaped partitions are not supported")
                v = r.rice(k)
                if order:
                    guess = coef[0] * x[i - 1]
                    for j in range(1, order):
                        guess += coef[j] * x[i - 1 - j]
                    v += guess >> shift
                x[i] = v
        else:
            raise ValueError(f"reserved subframe type {t}")
        out[first[at][:, None] + np.arange(size)] = x.T
    return out


def stream_frames(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a stream with a whole seek table: each frame's start and end in it, sample offset and size."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, total = 4, 0, None, None
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            total = int.from_bytes(stream[at + 14 : at + 22], "big") & (1 << 36) - 1
        elif kind == 3:
            points = np.frombuffer(stream, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")], size // _SEEK, at + 4)
        at += 4 + size
    if points is None or int(points["size"].sum()) != total:
        raise ValueError("the seek table does not list every frame")
    starts = at + points["offset"].astype(np.int64)
    return starts, np.append(starts[1:], len(stream)), points["sample"].astype(np.int64), points["size"].astype(np.int64)


def decode_streams(streams: list[bytes]) -> tuple[list[np.ndarray], list[tuple]]:
    """For each stream its samples, and its frames as stream_frames() gives them."""
    frames = [stream_frames(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])[:-1]
    starts = np.concatenate([f[0] + b for f, b in zip(frames, base)])
    ends = np.concatenate([f[1] + b for f, b in zip(frames, base)])
    sizes = np.concatenate([f[3] for f in frames])
    buf, n = np.frombuffer(b"".join([*streams, bytes(16)]), np.uint8), 4 * _AT_ONCE
    x = np.concatenate([_decode_frames(buf, starts[i : i + n], ends[i : i + n], sizes[i : i + n]) for i in range(0, len(starts), n)])
    return np.split(x, np.cumsum([f[3].sum() for f in frames])[:-1]), frames


def _groups(sizes: list[int]) -> Iterator[slice]:
    at, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= _GROUP_BYTES:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(sizes):
        yield slice(at, len(sizes))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = text_bytes(batch)
        for g in _groups([len(x) for x in raw]):
            part = [x + b" " * ((-len(x)) % UNIT or (0 if x else UNIT)) for x in raw[g]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[g], pa.array([len(x) for x in raw[g]], pa.int64()), pa.array(encode_streams(part), pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each row's UTF-8 bytes, with spaces up to a positive multiple of 192, as a
    FLAC stream. Null and empty texts are 192 spaces; null ids and repeated rows stay; an empty table gives
    an empty result."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _decoded(media: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """For each stream its place in ``media`` and its PCM blocks: (sample offset, byte offset, PCM), one a frame,
    checksums verified. Streams of a few megabytes are decoded at once."""
    for g in _groups([len(x) for x in media]):
        for i, x, (starts, _, samples, sizes) in zip(range(g.start, g.stop), *decode_streams(media[g])):
            pcm = (x + 128).astype(np.uint8)
            yield i, [(a, b, pcm[a : a + n].tobytes()) for a, b, n in zip(samples.tolist(), starts.tolist(), sizes.tolist())]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, blocks in _decoded(batch.column("media").to_pylist()):
            samples, seek, pcm = zip(*blocks)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([i] * len(pcm), pa.int64())), pa.array(samples, pa.int64()), pa.array(seek, pa.int64()), pa.array(pcm, pa.binary())], names=["doc_id", "sample_offset", "byte_offset", "pcm"])


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, sample_offset, byte_offset, pcm: one row a frame, checksums verified, with where the frame
    starts in samples and in the stream, so that a reader can seek to it. ``media`` holds streams as
    encode_media() makes them: no stream is null or empty, null ids and repeated rows stay, and an empty
    table gives an empty result."""
    return media.select("doc_id", "media").mapInArrow(_blocks, "doc_id long, sample_offset long, byte_offset long, pcm binary")


def write_pcm_blocks(media: DataFrame, path: str) -> DataFrame:
    """pcm_blocks() as a Parquet table in order of id and sample within each file, so that row-group
    statistics lead a reader to the blocks of a document and offset. The table as read back."""
    pcm_blocks(media).sortWithinPartitions("doc_id", "sample_offset").write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media, rows = batch.column("media").to_pylist(), []
        for i, blocks in _decoded(media):
            p = b"".join(pcm for _, _, pcm in blocks)
            x = np.frombuffer(p, np.uint8).astype(np.int32) - 128
            turns, size = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1]))), np.abs(x)
            feature = f"peak={int(size.max())} level={int(size.sum()) // len(x)} energy={int(np.square(x).sum()) // len(x)} turns={turns}"
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), feature))
        cols = list(zip(*rows)) or [[]] * 6
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_bytes", *_COLUMNS])


_COLUMNS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_digest(media: DataFrame) -> DataFrame:
    """What the decoded PCM blocks of each row hold, joined in order: digests, and peak, mean level, energy and
    sign changes. Null ids and repeated rows stay; an empty table gives an empty result."""
    return media.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Encodes, stores the media column as a table, reads it back, decodes its PCM blocks and digests them. A null
    or empty text is 192 spaces, a text of any length is one stream, equal texts get equal values; rows with
    null or repeated ids stay, columns beside id and text are left out, whatever their names, an empty table gives
    an empty result. Nothing is ordered, so there are no ties."""
    return media_digest(written(encode_media(docs), "flac", compression="zstd"))

"""Document quality by Bradley-Terry ranking.

Each pair of a good and a poor labelled document says that the first beats the second with probability
sigmoid(w . (x1 - x2)); w is fitted by logistic loss on the differences of features. A document's strength
is w . x. The threshold is the quantile of the training documents' strengths at the share of poor labels.

Features are shares of kinds of characters, lengths and repetition of words and lines, and the shares of words
in buckets of a hash, which let the model learn words of any language.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_slices, text_bytes

#: A score of this or more is a pass; strengths at the quantile get exactly this score.
PASS = 0.7
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), b" ", b"\n", range(128, 256), b".", b",", b"!", b"?", b"*#%&$@^~", b"|", b"'\"", b"()[]{}<>", b"-_=+/\\:;"]
_BYTES = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _BYTES[list(_c), _i] = 1


#: Buckets of words, and words whose bucket a worker remembers.
WORD_BUCKETS, _KNOWN_WORDS = 64, 20_000


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        b = self[word] = xxhash.xxh3_64_intdigest(word.lower().strip(b".,!?;:")) % WORD_BUCKETS
        return b


_buckets = _Buckets()


def features(texts: list[bytes]) -> np.ndarray:
    """A row of shares and means for each text: characters by kind, repeated and adjacent equal words, word
    and line lengths, capitals, words by bucket; of whole texts."""
    out, lexical = [], np.zeros((len(texts), WORD_BUCKETS))
    if len(_buckets) > _KNOWN_WORDS:
        _buckets.clear()
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        chars = (np.bincount(raw, minlength=256) if len(raw) else np.zeros(256)) @ _BYTES / max(len(raw), 1)
        words, lines = text.split(), text.split(b"\n")
        n, distinct = max(len(words), 1), len(set(words))
        if words:
            lexical[i] = np.bincount(np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words)), minlength=WORD_BUCKETS) / n
        step = max(1, len(words) // 2)
        half = len(set(words[:step])) / step if words else 0.0
        same = sum(map(eq, words, words[1:])) / n
        caps, title = sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n
        ended = sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
        out.append([*chars, distinct / n**0.8, half, same, caps, title, min(len(text) / n, 40) / 10, np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, np.log1p(len(words) / len(lines)) / 5, ended, len(set(lines)) / len(lines)])
    x = np.array(out, np.float64).reshape(len(texts), -1)
    # Square roots tell small shares apart; squares let the middle of a range win.
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x, np.sqrt(lexical)], axis=1)


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, scales, weights and the threshold. With one class or none, weights are zero and all pass."""
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    w = np.zeros(x.shape[1])
    if not len(good) or not len(poor):
        return mean, scale, w, 0.0
    z = ((x - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(seed)
    one, other = rng.choice(good, pairs), rng.choice(poor, pairs)
    for _ in range(rounds):  # Newton steps on the mean logistic loss, over a few thousand pairs at once
        grad, curve = ridge * w, ridge * np.eye(len(w))
        for at in range(0, pairs, 4000):
            d = z[one[at : at + 4000]] - z[other[at : at + 4000]]
            p = 1 / (1 + np.exp(np.minimum(d @ w, 500)))
            grad = grad - d.T @ p / pairs
            curve += d.T @ (d * (p * (1 - p))[:, None]) / pairs
        step = np.linalg.solve(curve, grad)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w, float(np.quantile(z @ w, np.mean(y == 0)))


def scores(x: np.ndarray, model: tuple) -> np.ndarray:
    """In 0 to 1; PASS or more exactly where the strength is at the threshold or above."""
    mean, scale, w, threshold = model
    over = ((x - mean) / scale).clip(-8, 8) @ w - threshold
    s = 1 / (1 + np.exp(-(over + np.log(PASS / (1 - PASS))).clip(-500, 500)))
    return np.where(over >= 0, np.maximum(s, PASS), np.minimum(s, np.nextafter(PASS, 0)))


def _collectable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        x = features(text_bytes(batch))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])
    _buckets.clear()  # workers live on, and later stages need the room


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, label_col: str = "quality") -> tuple:
    """A model of labels 0 and 1, from ``max_rows`` labels at most, those first by a hash of the id; other
    labels and null ids are passed over, and a label repeated for an id counts once. What documents of
    repeated ids bring beyond ``max_rows`` rows is cut again, by a hash of the features. The bound keeps
    what is sent and fitted the same at every size of ``docs``."""
    sample = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    # Broadcast: max_rows rows of two numbers at most.
    met = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("label", "text")
    got = met.mapInArrow(_collectable, "label int, x array<double>").orderBy(F.xxhash64("x"), "label").limit(max_rows).toArrow()
    size = features([b""]).shape[1]
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return fit_bradley_terry(x, got.column("label").to_numpy())


def _score(model: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            s = scores(features(text_bytes(batch)), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= PASS).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])
        _buckets.clear()  # workers live on, and later stages need the room

    return run


def classify(docs: DataFrame, model: tuple) -> DataFrame:
    """The columns of ``docs`` (but any score or predicted) and score and predicted of each row's whole text,
    which alone decides them. Null and empty texts are scored as empty; nothing is dropped."""
    docs = docs.drop("score", "predicted")
    schema = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return docs.mapInArrow(_score(model), schema)


def held_out(id_col: str = "doc_id"):
    """Rows that give no labels: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple:
    return fit(docs, labels.filter(~held_out()))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, from its whole text alone, of any length: null
    and empty texts are scored as empty, rows with null or repeated ids stay, equal texts get equal scores, other
    columns are left out whatever their names. An empty table gives an empty result; without labels of both kinds all documents pass."""
    model = train(docs, labels)
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

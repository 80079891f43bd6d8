"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_slices, spread_join, text_bytes, written

#: Stripped at both ends of a line: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_LINE = "h1 long, h2 long, doc_id long, text_hash long, pos int, first boolean"


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            keys, pos, first, runs = [], [], [], []
            for text in text_bytes(batch):
                n, seen = 0, set()
                for i, line in enumerate(text.lower().split(b"\n")):  # bytes.lower() maps A-Z only
                    key = line.strip(BLANKS)
                    # Code points are counted only where bytes don't decide.
                    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
                        continue
                    h = xxhash.xxh3_128_digest(key)
                    keys.append(h)
                    pos.append(i)
                    first.append(h not in seen)
                    seen.add(h)
                    n += 1
                runs.append(n)
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            at = np.repeat(np.arange(len(runs)), runs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("doc_id").take(pa.array(at)), batch.column("text_hash").take(pa.array(at)), pa.array(np.array(pos, "i4")), pa.array(first, pa.bool_())],
                names=["h1", "h2", "doc_id", "text_hash", "pos", "first"],
            )

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        n_lines, n_dropped, kept = [], [], []
        for text, drop in zip(text_bytes(batch), batch.column("drop").to_pylist()):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            n_dropped.append(len(drop or ()))
            if drop:
                gone = set(drop)
                text = b"\n".join([x for i, x in enumerate(lines) if i not in gone])
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] not in ("text", "drop")), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            names=[*(x for x in batch.schema.names if x not in ("text", "drop")), "kept_text", "n_lines", "n_dropped"],
        )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs``: its id as doc_id, lang, source and n_chars if it has them, kept_text, n_lines and
    n_dropped. Other columns are left out, whatever their names.

    A line's key is the line without blanks at both ends, A-Z in lower case. Keys of ``min_chars`` code
    points or more that ``min_docs`` documents or more have lose all their lines, in every row. Rows of one
    id are one document, however often it is repeated, and null ids are one id. A null or empty text is
    one empty line, whose key is too short to go. An empty table gives an empty result.

    Keys are compared by 128-bit hashes. Ids of a key are made distinct before they are counted, both
    combined before their shuffle, so a line that a third of all documents have is no hot key there; in the
    join that carries the decision back such a key is salted. Texts are shuffled once, to meet their
    dropped positions.
    """
    kept_cols = [c for c in ("lang", "source", "n_chars") if c in docs.columns]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"), *kept_cols)
    lines = base.select("doc_id", "text", "text_hash").mapInArrow(_hash_lines(max(1, min_chars)), _LINE)
    counts = lines.filter("first").select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    common = written(counts.filter(F.col("n") >= min_docs), "common-lines")
    # Rows with the same id and text lose the same lines, so together the two are a row's key.
    met = spread_join(lines.select("h1", "h2", "doc_id", "text_hash", "pos"), common, ["h1", "h2"], "doc_id")
    gone = met.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "drop")
    met = base.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select("doc_id", "text", *kept_cols, "drop")
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return met.mapInArrow(_assemble, ", ".join(["doc_id long", *(f"{c} {types[c]}" for c in kept_cols), "kept_text string", "n_lines long", "n_dropped long"]))


def line_digest(deduped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text, for every row of dedup_lines()."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))

"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on the document id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch_path
from .tokens import encoder, ids_crc32, with_end


_FILE = "doc_id long, part int, place long, n_tokens long, ids array<int>"


def _encode(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(tokenizer_path), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # so that ids of few rows are held at once
                part = batch.slice(at, 1000)
                ids, counts = with_end(*enc.encode([x or "" for x in part.column("text").to_pylist()]), end_id)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                place = np.arange(before, before + part.num_rows)
                before += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(place), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "part", "place", "n_tokens", "ids"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, stripe_bytes: int = 16 << 20) -> None:
    """Writes doc_id, part, place, n_tokens and ids as ORC, in ascending doc_id order over the files and in them.

    Documents are dealt by ranges of doc_id and sorted in each before they are encoded, so what is
    shuffled is text. ``part`` numbers the ranges in order, ``place`` a range's rows. Integer columns are run-length encoded, each
    1,000 rows have an index entry, and doc_id has a Bloom filter, so a reader skips stripes and row groups
    by id. A null text counts as empty and gets the end id alone; null ids come first; rows of the same id
    are ordered by text. A text of any length is encoded whole, beside at most 999 others. Other columns are
    left out, whatever their names.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    rows = ordered.mapInArrow(_encode(tokenizer_path, end_id), _FILE)
    (
        rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(stripe_bytes)).option("orc.compress", "ZSTD").orc(path)
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column("ids")
        ids, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
        crc = [ids_crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("place"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "place", "n_read", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, place, n_tokens, ids. Filters on doc_id reach the files' indexes and Bloom filters."""
    return spark.read.schema(_FILE).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32. A document's start is the ids of all ranges
    before its own (one number for each range) and those before it in its range, in the order of the file."""
    rows = read_token_files(spark, path).mapInArrow(_digest, "doc_id long, part int, place long, n_read long, ids_crc32 long")
    totals = read_token_files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inner", F.coalesce(F.sum("n_read").over(inside), F.lit(0).cast("long"))).join(before, F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes the files and gives doc_id, start, n_tokens and ids_crc32 of each row, in the order that the files hold:
    null ids first, rows of one id by text. Null texts are empty, other columns are left out whatever their names;
    an empty table gives an empty result."""
    path = path or scratch_path(docs.sparkSession, "token-orc")
    write_token_files(docs, path, tokenizer_path, end_id)
    return token_index(docs.sparkSession, path)

"""What the operators share: the scratch folder that all executors see, written tables, Arrow helpers."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset: a temporary folder on a local
    master, removed at exit; on a cluster an error, since executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors, and
    gives the planner true sizes."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a group that a task holds at once.
_GROUP_BYTES = 16 << 20


def group_count(spark: SparkSession, size: float) -> int:
    """Groups to deal ``size`` bytes into, so that one is held by a task whatever the size: as many as shuffle
    partitions, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / _GROUP_BYTES))


def grouped(rows: DataFrame, key: str, tasks: int):
    """``rows`` grouped by ``key`` in that many tasks. Keys may be more; a task holds one group at a time."""
    return rows.repartition(tasks, key).groupBy(key)


#: Bundles of small groups a task works through one after another, so that two large ones seldom share one.
BUNDLES = 16


#: A key's rows are dealt over as many tasks as it has 2,000ths of all of them.
_SHARES = 2000


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], item: str, how: str = "inner") -> DataFrame:
    """``rows`` joined on the columns ``on`` with ``table``, which has a row for each key and in ``n`` how many
    of ``rows`` have it. The columns of ``table`` beside n are added.

    A key of more than a 2,000th of the sum of n is hot. There are fewer than 2,000 such keys, whatever the
    size, so they are broadcast, and a hot key's rows are salted by a hash of ``item``: none of its parts is
    above a 2,000th. ``table`` is read three times and should be a written one.
    """
    whole = table.agg(F.sum("n").alias("s")).first()["s"] or 0
    parts = F.greatest(F.ceil(F.col("n") * _SHARES / max(whole, 1)), F.lit(1)).cast("int")
    keys = [F.col(c).alias(f"_{c}") for c in on]
    hot = table.filter(parts > 1).select(*keys, parts.alias("_parts"))
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    salted = rows.join(F.broadcast(hot), same, "left").withColumn("_salt", F.pmod(F.xxhash64(item), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts", *[f"_{c}" for c in on])
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of their texts is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def binary_list(column: pa.Array) -> list[bytes]:
    """A string column's UTF-8 values; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return binary_list(batch.column(batch.schema.get_field_index(name)))


def signed(x: int) -> int:
    """An unsigned 64-bit integer as the signed one of the same bits."""
    return x - (1 << 64) if x >= 1 << 63 else x


def split_ranges(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``lengths``: each element's run and its place in the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - starts[run]

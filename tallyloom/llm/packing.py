"""Best-fit packing of token sequences, certified by dual-feasible lower bounds.

Pieces are dealt into partitions, each packed by best-fit decreasing. Dual-feasible functions give each
partition a number of sequences that no packing of it can stay under. Where a partition is above, or its last
sequences are part empty, those sequences' pieces are exchanged with other partitions' and packed again,
in fewer partitions each round; a packing of before is kept where the new one is no better.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import split_ranges, written
from .tokens import encoder, ids_crc32, with_end

CAPACITY = 4096
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = PIECE + ", sequence_id long, offset long, free long, part_sequences long, part_bound long"


def _cut(tokenizer_path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, counts = with_end(*enc.encode([x or "" for x in part.column("text").to_pylist()]), end_id)
                row, piece = split_ranges(-(-counts // capacity))
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                first = (np.cumsum(counts) - counts)[row] + start
                crc = [ids_crc32(ids[a : a + n]) for a, n in zip(first.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.clear()  # workers live on, and later stages need the room more than the next task needs the words

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each row's ids and the end id, cut only where longer than
    ``capacity``. A null text is empty: the end id alone."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(tokenizer_path, end_id, capacity), PIECE)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of ``counts[n]`` pieces of length n needs fewer sequences: the most that dual-feasible
    functions prove. Those used are x over capacity; the same with pieces under e dropped and those over
    capacity - e taken as whole, for each e; and rounding down to a k-th with (k + 1) x, for k to 32."""
    n = np.zeros(capacity + 1, np.int64)
    n[: len(counts)] = counts
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // capacity)
    mass, many = np.concatenate([[0], np.cumsum(n * x)]), np.concatenate([[0], np.cumsum(n)])
    e = np.arange(1, capacity // 2 + 1)
    whole = many[-1] - many[capacity - e + 1]
    best = max(best, int((-(-(capacity * whole + mass[capacity - e + 1] - mass[e]) // capacity)).max(initial=0)))
    for k in range(1, 33):
        f = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((n * f).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's sequence and offset by best-fit decreasing. The free spaces in use are bits of one
    number, so the least that suffices is its lowest bit from the length up."""
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_free: dict[int, list[int]] = {}
    free_bits, used = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        above = free_bits >> n
        if above:
            free = n + (above & -above).bit_length() - 1
            bins = by_free[free]
            b = bins.pop()
            if not bins:
                free_bits &= ~(1 << free)
        else:
            free, b, used = capacity, used, used + 1
        seq[i], offset[i] = b, capacity - free
        left = free - n
        if left:
            by_free.setdefault(left, []).append(b)
            free_bits |= 1 << left
    return seq, offset


def _placed(table: pa.Table, seq: np.ndarray, offset: np.ndarray, base: int, capacity: int) -> pa.Table:
    length = table.column("length").to_numpy()
    used = np.bincount(seq, weights=length).astype(np.int64)
    proof = lower_bound(np.bincount(length), capacity)
    cols = {c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
    return pa.table(cols | {"sequence_id": pa.array(seq + base), "offset": pa.array(offset), "free": pa.array(capacity - used[seq]), "part_sequences": pa.array(np.full(len(seq), len(used))), "part_bound": pa.array(np.full(len(seq), proof))})


def _pack_partition(round_: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            seq, offset = best_fit(table.column("length").to_numpy(), capacity)
            yield from _placed(table, seq, offset, round_ << 56 | TaskContext.get().partitionId() << 28, capacity).to_batches()

    return run


def _repack(round_: int, capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        old, before = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
        base = round_ << 56 | key[0].as_py() << 28
        if len(old) > lower_bound(np.bincount(length), capacity):
            seq, offset = best_fit(length, capacity)
            if seq.max() + 1 < len(old):
                return _placed(table, seq, offset, base, capacity)
        return _placed(table, before, table.column("offset").to_numpy(), base, capacity)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_part: int = 20_000, spare: int = 16, rounds: int = 6) -> tuple[DataFrame, int, int]:
    """``pieces`` with sequence_id, offset, and the certificate of the partition that the sequence was last
    packed in: part_sequences and part_bound, which no packing of its pieces stays under; beside it the
    number of sequences and the lower bound for all.

    Pieces of full length are sequences as they are. The rest go round robin into partitions of about
    ``rows_per_part``. After each round sequences with ``spare`` free tokens or fewer stand; the others
    are exchanged, whole sequences to one partition, until the number meets the bound, one partition holds
    all of them and is packed, or ``rounds`` are over. What each round leaves is written out.
    """
    pieces = written(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    bound, rest = lower_bound(counts, capacity), int(counts.sum() - counts[capacity])
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": (F.lit(127 << 56) + F.monotonically_increasing_id()), "offset": F.lit(0).cast("long"), "free": F.lit(0).cast("long"), "part_sequences": F.lit(1).cast("long"), "part_bound": F.lit(1).cast("long")})
    done, total = [full], int(counts[capacity])
    parts = max(1, -(-rest // rows_per_part))
    left = written(pieces.filter(F.col("length") < capacity).repartition(parts).mapInArrow(_pack_partition(1, capacity), _PLACED), "packed")
    for round_ in range(2, rounds + 2):
        held = left.agg(F.count_distinct("sequence_id"), F.count_distinct(F.when(F.col("free") > spare, F.col("sequence_id"))), F.count_if(F.col("free") > spare)).first()
        if parts == 1 or total + held[0] <= bound or round_ == rounds + 1:
            break
        done.append(left.filter(F.col("free") <= spare))
        total += held[0] - held[1]
        parts = max(1, min(parts // 2, -(-held[2] // rows_per_part)))
        again = left.filter(F.col("free") > spare).withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(parts)))
        left = written(again.groupBy("part").applyInArrow(_repack(round_, capacity), _PLACED), "packed")
    out = left
    for d in done:
        out = out.unionByName(d)
    return out.drop("free"), total + held[0], bound


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset; then the certificates: part_sequences and part_bound of its partition, n_sequences and lower_bound
    of the whole. Null texts are their end alone, null ids and repeated rows are packed like others, pieces of one
    length go in a fixed order by a hash, and a text of any length is cut into pieces of its own; an empty table gives
    an empty result; other columns are left out, whatever their names."""
    out, total, bound = pack(token_pieces(docs, tokenizer_path, end_id, capacity), capacity)
    return out.withColumns({"n_sequences": F.lit(total).cast("long"), "lower_bound": F.lit(bound).cast("long")})

"""Mixing sources to target weights by hash-threshold histograms, DataFrame functions only.

Each document gets a 60-bit hash. Tokens are summed by source and leading hash bits; the running sum
over those buckets shows which bucket a source's budget ends in. Only that bucket's documents are summed
again by the next bits, until the bits are used up. What remains per source is one hash threshold, and
the mix is a filter on it: no document is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

HASH_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def _hash(id_: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), text))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words; null text: 0) and h, a hash of id and text that is the same in
    every run."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        _hash(F.col(id_col), text).alias("h"),
    )


def source_targets(sizes: DataFrame, weights=(1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """source, source_size, target. Sources in code-point order, null last, get the weights in turn and
    share the sum of all sizes; a share stops at ``max_repeats`` times its source, and the excess goes to
    the others by weight until none is above.

    Sources in ascending order of cap per weight are capped first; one is capped when what is left per
    remaining weight, before it, exceeds its own cap per weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("w", F.element_at(turn, (place % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    capped = ranked.withColumn("capped", F.col("cap") / F.col("w") < left / left_w)
    spare = F.sum("source_size").over(whole).cast("double") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole)
    spare_w = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(whole)
    return capped.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * spare / spare_w)).alias("target"))


def hash_thresholds(sizes: DataFrame, budgets: DataFrame, bits: int = 12) -> DataFrame:
    """For each row of ``budgets`` (source, rem): ``upto``, so that the documents of that source with
    h <= upto sum as near to rem as whole documents can. -1: none."""
    rows = sizes.join(budgets.filter("rem > 0").select(F.col("source").alias("s"), "rem"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "h", "rem")
    found = None
    for shift in range(HASH_BITS - bits, -1, -bits):
        w = Window.partitionBy("source").orderBy("b")
        # Documents without words weigh nothing and would make empty buckets.
        hist = rows.filter("size > 0").groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"), F.max("rem").alias("rem"))
        summed = hist.withColumn("upper", F.sum("n").over(w)).withColumn("lower", F.col("upper") - F.col("n"))
        edge = written(summed.filter("upper > rem and lower <= rem").select(F.col("source").alias("s"), F.col("b").alias("edge_b"), "lower", "upper", F.col("rem").alias("edge_rem")), "mix-edge")
        if shift == 0:
            found = edge
            break
        inside = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.col("edge_b")))
        rows = written(inside.select("source", "size", "h", (F.col("edge_rem") - F.col("lower")).alias("rem")), "mix-rows")
    nearer = F.col("upper") - F.col("edge_rem") < F.col("edge_rem") - F.col("lower")
    return found.select(F.col("s").alias("source"), F.when(nearer, F.col("edge_b")).otherwise(F.col("edge_b") - 1).alias("upto"))


def mix_plan(sizes: DataFrame, weights=(1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """s (source), source_size, target, whole, upto: a source's documents are taken ``whole`` times, and once
    more where h <= upto."""
    targets = source_targets(sizes, weights, max_repeats)
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats)).cast("long")
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0).cast("long")))
    plan = written(plan.withColumn("rem", F.when(F.col("whole") < max_repeats, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)), "mix-plan")
    upto = hash_thresholds(sizes, plan)
    joined = plan.join(upto.withColumnRenamed("source", "u"), F.col("source").eqNullSafe(F.col("u")), "left")
    return joined.select(F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("upto", F.lit(-1).cast("long")).alias("upto"))


def _repeats():
    return F.col("whole") + F.when(F.col("h") <= F.col("upto"), 1).otherwise(0)


def mix_sources(docs: DataFrame, weights=(1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats for every row of ``docs``.

    A source is taken floor(target / source_size) times whole and once more for the documents under its
    hash threshold, so a repeat's documents are among those of the repeat before, and a larger target
    only adds documents. A source misses its target by less than half of one document.

    Null texts and texts of white space have size 0 and nothing taken. Null sources are one source. Null
    ids take part; rows with the same id and text have the same hash and are taken together. A text of any
    length is one document, taken whole. An empty table gives an empty result. Other columns are left out, whatever
    their names.
    """
    sizes = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = mix_plan(sizes, weights, max_repeats)
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * _repeats()).alias("taken"), _repeats().alias("repeats"))


def mixed_documents(docs: DataFrame, weights=(1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and any others, whatever their names) as often as the mix takes
    them: as mix_sources() has it."""
    sizes = sized(docs)
    plan = mix_plan(written(sizes, "mix-sizes"), weights, max_repeats)
    text = F.coalesce(F.col("text"), F.lit(""))
    # Names of its own, so that a column of docs may have any other.
    own = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns])
    keyed = docs.withColumn("_mix_h", _hash(F.col("doc_id"), text))
    times = F.col("_mix_whole") + F.when(F.col("_mix_h") <= F.col("_mix_upto"), 1).otherwise(0)
    taken = keyed.join(own, F.col("source").eqNullSafe(F.col("_mix_s"))).withColumn("_mix_times", times).filter("_mix_times > 0")
    return taken.withColumn("_mix_time", F.explode(F.sequence(F.lit(1), F.col("_mix_times").cast("int")))).select(*docs.columns)

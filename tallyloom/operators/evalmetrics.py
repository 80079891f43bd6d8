"""Retrieval-quality metrics from rankings and gold evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10, 20, 40)
#: Upper ends of the rank bands (fixed values); what is beyond or missing has bands of its own.
BANDS = (1, 3, 5, 10, 20, 30)


def best_ranks(gold: DataFrame, ranking: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """keys, group_id, best_rank: the least rank of any alternative of an evidence group, null if none is
    ranked. ``gold``: keys, group_id, id; ``ranking``: keys, id, rank, of which the first of an id counts."""
    first = ranking.groupBy(*keys, "id").agg(F.min("rank").alias("rank"))
    return gold.join(first, [*keys, "id"], "left").groupBy(*keys, "group_id").agg(F.min("rank").alias("best_rank"))


def recall_at(best: DataFrame, cutoffs=CUTOFFS, key: str = "case_id") -> DataFrame:
    """k, cases, any_hit, group_recall, strict_recall, mrr for each cutoff, in one aggregation by case and one
    over cases."""
    hit = lambda k: F.coalesce(F.col("best_rank") <= k, F.lit(False))
    per = best.groupBy(key).agg(F.count(F.lit(1)).alias("groups"), F.min("best_rank").alias("first"), *[F.count_if(hit(k)).alias(f"h{k}") for k in cutoffs])
    total = [F.count(F.lit(1)).alias("cases"), F.sum("groups").alias("groups")]
    for k in cutoffs:
        total += [F.count_if(F.col(f"h{k}") > 0).alias(f"any{k}"), F.sum(f"h{k}").alias(f"hit{k}"), F.count_if(F.col(f"h{k}") == F.col("groups")).alias(f"all{k}"), F.sum(F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(0.0)).alias(f"rr{k}")]
    row = per.agg(*total)
    share = lambda c, n: F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(n).cast("double")), F.lit(0.0)), 6)
    rows = [F.struct(F.lit(k).cast("long").alias("k"), F.col("cases"), share(f"any{k}", "cases").alias("any_hit"), share(f"hit{k}", "groups").alias("group_recall"), share(f"all{k}", "cases").alias("strict_recall"), share(f"rr{k}", "cases").alias("mrr")) for k in cutoffs]
    return row.select(F.inline(F.array(*rows)))


def rank_band(rank: Column) -> Column:
    out, low = None, 1
    for top in BANDS:
        name = f"{low}-{top}" if low != top else str(top)
        out = F.when(rank <= top, name) if out is None else out.when(rank <= top, name)
        low = top + 1
    return out.when(rank > BANDS[-1], f">{BANDS[-1]}").otherwise("missing")


def paired(a: DataFrame, b: DataFrame, cutoffs, key: str = "case_id") -> DataFrame:
    """k, wins, losses, both_hit, both_miss, net, mean_delta of b over a from first ranks (key, rank)."""
    both = a.select(key, F.col("rank").alias("ra")).join(b.select(key, F.col("rank").alias("rb")), key, "full")
    aggs = []
    for k in cutoffs:
        x, y = F.coalesce(F.col("ra") <= k, F.lit(False)), F.coalesce(F.col("rb") <= k, F.lit(False))
        aggs += [F.count_if(~x & y).alias(f"w{k}"), F.count_if(x & ~y).alias(f"l{k}"), F.count_if(x & y).alias(f"h{k}"), F.count_if(~x & ~y).alias(f"m{k}")]
    row = both.agg(*aggs, F.round(F.avg(F.col("ra") - F.col("rb")), 6).alias("d"))
    rows = [F.struct(F.lit(k).cast("long").alias("k"), F.col(f"w{k}").alias("wins"), F.col(f"l{k}").alias("losses"), F.col(f"h{k}").alias("both_hit"), F.col(f"m{k}").alias("both_miss"), (F.col(f"w{k}") - F.col(f"l{k}")).alias("net"), F.col("d").alias("mean_delta")) for k in cutoffs]
    return row.select(F.inline(F.array(*rows)))


def confusion(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """expected, actual, n, share of all."""
    counts = rows.groupBy(F.col(expected).alias("expected"), F.col(actual).alias("actual")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def duplicate_slots(ranking: DataFrame, cutoffs, key: str, content: str) -> DataFrame:
    """k, queries, mean_slots, mean_duplicates, with_duplicates among the first k of each query."""
    aggs = [c for k in cutoffs for c in (F.count_if(F.col("rank") <= k).alias(f"n{k}"), F.count_distinct(F.when(F.col("rank") <= k, F.col(content))).alias(f"d{k}"))]
    per = ranking.groupBy(key).agg(*aggs)
    row = per.agg(F.count(F.lit(1)).alias("queries"), *[c for k in cutoffs for c in (F.round(F.avg(f"n{k}"), 6).alias(f"s{k}"), F.round(F.avg(F.col(f"n{k}") - F.col(f"d{k}")), 6).alias(f"u{k}"), F.count_if(F.col(f"n{k}") > F.col(f"d{k}")).alias(f"w{k}"))])
    rows = [F.struct(F.lit(k).cast("long").alias("k"), F.col("queries"), F.col(f"s{k}").alias("mean_slots"), F.col(f"u{k}").alias("mean_duplicates"), F.col(f"w{k}").alias("with_duplicates")) for k in cutoffs]
    return row.select(F.inline(F.array(*rows)))


def macro_recall(best: DataFrame, k: int, gold: str) -> DataFrame:
    """gold_items, macro_recall, coverage: the mean over gold items of their queries' recall."""
    per = best.groupBy(gold).agg(F.avg(F.coalesce(F.col("best_rank") <= k, F.lit(False)).cast("double")).alias("r"))
    return per.agg(F.count(F.lit(1)).alias("gold_items"), F.round(F.avg("r"), 6).alias("macro_recall"), F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("coverage"))


def sliced(best: DataFrame, k: int, slices: list[str]) -> DataFrame:
    """level, key, groups, hits, recall: over all and by each slice, in one pass of grouping sets."""
    hit = F.count_if(F.coalesce(F.col("best_rank") <= k, F.lit(False)))
    g = best.groupingSets([[], *[[F.col(s)] for s in slices]], *slices).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("groups"), hit.alias("hits"))
    full = (1 << len(slices)) - 1
    level = F.when(F.col("gid") == full, "all")
    key = F.when(F.col("gid") == full, "all")
    for i, s in enumerate(slices):
        own = F.col("gid") == full - (1 << (len(slices) - 1 - i))
        level, key = level.when(own, s), key.when(own, F.col(s).cast("string"))
    return g.select(level.alias("level"), key.alias("key"), "groups", "hits", F.round(F.col("hits") / F.col("groups"), 6).alias("recall"))

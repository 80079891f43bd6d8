"""Usage ledger: measures, completeness, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = ("input_tokens", "output_tokens", "total_tokens")


def measures() -> list[Column]:
    """Requests, failures, known token sums, events that lack a number, and cost."""
    return [
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS],
        F.count_if(F.col("total_tokens").isNull()).alias("unknown_usage"),
        F.count_if(F.col("cost_microunits").isNull()).alias("unpriced"),
        F.coalesce(F.sum("cost_microunits"), F.lit(0)).cast("long").alias("known_cost"),
    ]


def finished(df: DataFrame) -> DataFrame:
    """Cost is null while any event lacks one; flags say what is complete."""
    whole = F.col("unpriced") == 0
    return df.withColumn("cost", F.when(whole, F.col("known_cost"))).withColumn("cost_complete", whole).withColumn("usage_complete", F.col("unknown_usage") == 0)


def summary(events: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """The measures by each set of columns in one pass of grouping sets. ``level`` tells a null key from a
    total; rows whose own key is null or empty are left out."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = events.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("gid"), *measures())
    # Bit i of the id, from the left, is set where column i is summed over.
    gid = lambda s: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
    level = F.coalesce(*[F.when(F.col("gid") == gid(s), F.lit("+".join(s) or "all")) for s in sets])
    named = grouped.withColumn("level", level)
    for s in sets:
        for c in s:
            named = named.filter((F.col("level") != "+".join(s)) | (F.col(c).isNotNull() & (F.col(c).cast("string") != "")))
    return finished(named).drop("gid")


def with_zero_fill(ids: DataFrame, rollup: DataFrame, key: str) -> DataFrame:
    """Every id of ``ids``, with zeros where the roll-up has no row."""
    joined = ids.join(rollup, key, "left")
    zero = {c: t for c, t in rollup.dtypes if c != key and t in ("bigint", "int", "double")}
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in zero.items()})


def exclusive_buckets(df: DataFrame) -> DataFrame:
    """billed_input, billed_cache_read, billed_cache_write, billed_output: no token counts twice. Providers
    count cached tokens within the input, the SDK beside it."""
    sdk = F.col("usage_source") == "sdk"
    read, write = F.coalesce("cache_read_tokens", F.lit(0)), F.coalesce("cache_write_tokens", F.lit(0))
    within = F.greatest(F.col("input_tokens") - F.least(read, "input_tokens") - F.least(write, F.greatest(F.col("input_tokens") - read, F.lit(0))), F.lit(0))
    return df.withColumns({"billed_input": F.when(sdk, F.col("input_tokens")).otherwise(within), "billed_cache_read": read, "billed_cache_write": write, "billed_output": F.col("output_tokens")})


def cost_microunits(df: DataFrame) -> Column:
    """Tokens by rate per million, in decimals, rounded half up. Null where usage or the price is unknown."""
    d = lambda c: F.col(c).cast("decimal(20,0)") * F.col(c.replace("billed", "rate")).cast("decimal(18,6)")
    parts = ["billed_input", "billed_cache_read", "billed_cache_write", "billed_output"]
    total = sum((d(p) for p in parts[1:]), d(parts[0]))
    return F.when(F.col("total_tokens").isNotNull(), F.round(total, 0).cast("long"))


def with_price(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Rates by the first variant of provider and model that has a price: both as they are, both in lower
    case, the model alone. ``prices``: key and rates."""
    variants = F.array(F.concat_ws("/", "provider", "model"), F.lower(F.concat_ws("/", "provider", "model")), F.lower("model"))
    tried = events.select("request_id", F.posexplode(variants).alias("turn", "key"))
    rates = [c for c in prices.columns if c != "key"]
    found = tried.join(prices, "key").groupBy("request_id").agg(F.min_by(F.struct(*rates), "turn").alias("r"))
    return events.join(found, "request_id", "left").select(*events.columns, *[F.col(f"r.{c}").alias(c) for c in rates], F.col("r").isNull().alias("pricing_missing"))


def first_writes(events: DataFrame, key: str, order: str) -> DataFrame:
    """An append that keeps the first event of each key."""
    kept = events.groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), order).alias("r"))
    return kept.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in events.columns])

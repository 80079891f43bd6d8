"""Operations: distributions, concurrency, batches, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of duration buckets in seconds (fixed values).
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)


def percentile(value: str, q: float) -> Column:
    """Nearest rank: the element at ceil(q * n) in order."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").cast("double")


def distribution(rows: DataFrame, keys: list[str], value: str, digits: int = 3) -> DataFrame:
    """count, min, p50, p95, p99, max, mean by keys."""
    r = lambda c, n: F.round(c, digits).alias(n)
    return rows.groupBy(*keys).agg(
        F.count(value).alias("count"), r(F.min(value), "min"), r(percentile(value, 0.5), "p50"), r(percentile(value, 0.95), "p95"), r(percentile(value, 0.99), "p99"), r(F.max(value), "max"), r(F.avg(value), "mean")
    )


def histogram(rows: DataFrame, value: str, bounds=BOUNDS) -> DataFrame:
    """bound, cumulative: how many values are at most each bound, in one aggregation. Values that are not
    numbers, infinite or negative are rejected."""
    ok = rows.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0) & (F.col(value) < float("inf")))
    counts = ok.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)])
    return counts.select(F.inline(pairs))


def peak_overlap(intervals: DataFrame, keys: list[str], bucket: str = "day") -> DataFrame:
    """keys, peak: the most intervals (start, end) open at once; an end counts before a start at its time.

    Changes are summed by time, running sums are taken within buckets of time, and the buckets' own sums are
    small enough to run over, so no key has to be sorted as a whole."""
    ends = intervals.select(*keys, F.col("end").alias("t"), F.lit(-1).alias("d"))
    changes = intervals.select(*keys, F.col("start").alias("t"), F.lit(1).alias("d")).unionAll(ends).filter(F.col("t").isNotNull())
    summed = changes.groupBy(*keys, F.date_trunc(bucket, "t").alias("bucket"), "t", "d").agg(F.sum("d").alias("n"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    tops = summed.withColumn("level", F.sum("n").over(inside)).groupBy(*keys, "bucket").agg(F.max("level").alias("top"), F.sum("n").alias("net"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return tops.withColumn("base", F.coalesce(F.sum("net").over(before), F.lit(0))).groupBy(*keys).agg(F.greatest(F.max(F.col("base") + F.col("top")), F.lit(0)).alias("peak"))


def batch_status(jobs: DataFrame, key: str) -> DataFrame:
    """Counts by status of each batch, the batch's own status, and progress in percent."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    c = jobs.groupBy(key).agg(F.count(F.lit(1)).alias("total"), count("queued").alias("queued"), count("running").alias("running"), count("succeeded").alias("succeeded"), count("failed").alias("failed"))
    done = F.col("succeeded") + F.col("failed")
    status = (
        F.when(F.col("running") > 0, "running").when((F.col("queued") > 0) & (done > 0), "running").when(F.col("queued") > 0, "queued")
        .when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "partial").otherwise("succeeded")
    )
    return c.withColumn("batch_status", status).withColumn("progress", F.when(F.col("total") > 0, F.round(100.0 * done / F.col("total"), 2)).otherwise(0.0))


def retry_delay(attempts: Column) -> Column:
    return F.least(F.lit(300.0), 5 * F.pow(F.lit(2.0), attempts - 1)).cast("long")


def is_due(at: Column, now: Column) -> Column:
    """No time means now."""
    return at.isNull() | (at <= now)


def seconds_between(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(start)) / 1e6)


def load_summary(rows: DataFrame, wall_seconds: float) -> DataFrame:
    """requests, error_rate, throughput."""
    n = F.count(F.lit(1))
    return rows.agg(n.alias("requests"), F.round(F.count_if(~F.col("ok")) / n, 6).alias("error_rate"), F.round(n / F.lit(wall_seconds), 3).alias("throughput"))


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """Null where nothing is counted."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)

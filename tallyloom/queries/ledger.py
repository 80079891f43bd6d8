"""The usage ledger over ``events``: stage is event_type, job is user_id, tokens and costs come from value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger
from ..sources import merges
from .registry import query, table

_EVENTS = """u AS (SELECT event_id AS request_id, user_id AS job_id, event_type AS stage, 'p' || (user_id % 3) AS provider, 'm' || (event_id % 4) AS model,
CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 3)::BIGINT END AS attempt, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status,
CASE WHEN event_id % 13 = 0 THEN NULL ELSE floor(value)::BIGINT END AS input_tokens, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 50)::BIGINT END AS output_tokens,
CASE WHEN event_id % 13 = 0 THEN NULL ELSE floor(value)::BIGINT + (event_id % 50)::BIGINT END AS total_tokens,
CASE WHEN event_id % 17 = 0 THEN NULL ELSE floor(value * 10)::BIGINT END AS cost_microunits FROM events)"""
_MEASURES = """count(*) AS requests, count(*) FILTER (status = 'failed') AS failed, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens,
coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens, count(*) FILTER (total_tokens IS NULL) AS unknown_usage, count(*) FILTER (cost_microunits IS NULL) AS unpriced, coalesce(sum(cost_microunits), 0)::BIGINT AS known_cost"""
_FINISH = "CASE WHEN unpriced = 0 THEN known_cost END AS cost, unpriced = 0 AS cost_complete, unknown_usage = 0 AS usage_complete"


def usage(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    unless = lambda n, c: F.when(i % n != 0, c)
    value, output = F.floor("value").cast("long"), (i % 50).cast("long")
    return e.select(
        i.alias("request_id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.concat(F.lit("m"), (i % 4).cast("string")).alias("model"),
        unless(7, (i % 3).cast("long")).alias("attempt"), F.when(i % 11 == 0, "failed").otherwise("ok").alias("status"),
        unless(13, value).alias("input_tokens"), unless(13, output).alias("output_tokens"), unless(13, value + output).alias("total_tokens"),
        unless(17, F.floor(F.col("value") * 10).cast("long")).alias("cost_microunits"),
    )


@query(f"WITH {_EVENTS}, g AS (SELECT stage, provider, model, attempt, grouping_id(stage, provider, model, attempt) AS gid, {_MEASURES} FROM u GROUP BY GROUPING SETS ((), (stage), (provider, model), (attempt))), l AS (SELECT *, CASE gid WHEN 15 THEN 'all' WHEN 7 THEN 'stage' WHEN 9 THEN 'provider+model' ELSE 'attempt' END AS level FROM g) SELECT * EXCLUDE (gid), {_FINISH} FROM l WHERE level <> 'attempt' OR attempt IS NOT NULL")
def usage_summary(spark, sf_dir) -> DataFrame:
    """Totals and three groupings in one pass."""
    return ledger.summary(usage(spark, sf_dir), [(), ("stage",), ("provider", "model"), ("attempt",)])


@query(f"WITH {_EVENTS}, g AS (SELECT job_id, {_MEASURES} FROM u GROUP BY job_id) SELECT *, {_FINISH} FROM g")
def usage_completeness(spark, sf_dir) -> DataFrame:
    """Cost is unknown where any event's is."""
    return ledger.finished(usage(spark, sf_dir).groupBy("job_id").agg(*ledger.measures()))


@query(f"WITH {_EVENTS}, g AS (SELECT job_id, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens FROM u WHERE status = 'failed' GROUP BY job_id) SELECT c_custkey AS job_id, coalesce(requests, 0)::BIGINT AS requests, coalesce(tokens, 0)::BIGINT AS tokens FROM customer LEFT JOIN g ON c_custkey = job_id")
def batch_zero_fill(spark, sf_dir) -> DataFrame:
    """Every id, with zeros where nothing was used."""
    roll = usage(spark, sf_dir).filter("status = 'failed'").groupBy("job_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("total_tokens").alias("tokens"))
    return ledger.with_zero_fill(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")), roll, "job_id")


_BILL = f"""WITH {_EVENTS}, b AS (SELECT *, CASE WHEN request_id % 2 = 0 THEN 'sdk' ELSE 'provider' END AS usage_source, CASE WHEN request_id % 5 = 0 THEN NULL ELSE (request_id % 40)::BIGINT END AS cr, (request_id % 9)::BIGINT AS cw FROM u),
x AS (SELECT *, coalesce(cr, 0) AS r, cw AS w FROM b),
y AS (SELECT *, CASE WHEN usage_source = 'sdk' THEN input_tokens ELSE greatest(input_tokens - least(r, input_tokens) - least(w, greatest(input_tokens - r, 0)), 0) END AS billed_input FROM x) """


def _billed(spark, sf_dir) -> DataFrame:
    i = F.col("request_id")
    u = usage(spark, sf_dir).withColumns({"usage_source": F.when(i % 2 == 0, "sdk").otherwise("provider"), "cache_read_tokens": F.when(i % 5 != 0, (i % 40).cast("long")), "cache_write_tokens": (i % 9).cast("long")})
    return ledger.exclusive_buckets(u)


@query(_BILL + "SELECT request_id, billed_input::BIGINT AS billed_input, r AS billed_cache_read, w AS billed_cache_write, output_tokens AS billed_output FROM y WHERE input_tokens IS NOT NULL")
def exclusive_buckets(spark, sf_dir) -> DataFrame:
    """No token is billed twice."""
    return _billed(spark, sf_dir).filter("input_tokens IS NOT NULL").select("request_id", F.col("billed_input").cast("long").alias("billed_input"), "billed_cache_read", "billed_cache_write", "billed_output")


@query(_BILL + ", p(key, ri, rr, rw, ro) AS (VALUES ('p0/m1', 0.35::DECIMAL(18,6), 0.1::DECIMAL(18,6), 0.5::DECIMAL(18,6), 1.25::DECIMAL(18,6)), ('m2', 0.25, 0.05, 0.3, 0.75), ('p1/m3', 2.5, 0.5, 3.0, 8.125)) SELECT request_id, key IS NULL AS pricing_missing, CASE WHEN total_tokens IS NOT NULL THEN round(billed_input * ri + r * rr + w * rw + output_tokens * ro, 0)::BIGINT END AS cost FROM (SELECT *, provider || '/' || model AS k1 FROM y) LEFT JOIN p ON key = k1 OR key = model".replace(", p(", "SELECT * FROM (WITH p(", 1) + ")")
def token_cost(spark, sf_dir) -> DataFrame:
    """Decimal cost by the first price variant that is known."""
    rows = [("p0/m1", "0.35", "0.1", "0.5", "1.25"), ("m2", "0.25", "0.05", "0.3", "0.75"), ("p1/m3", "2.5", "0.5", "3.0", "8.125")]
    prices = spark.createDataFrame(rows, ["key", "rate_input", "rate_cache_read", "rate_cache_write", "rate_output"])
    prices = prices.select("key", *[F.col(c).cast("decimal(18,6)") for c in prices.columns[1:]])
    priced = ledger.with_price(_billed(spark, sf_dir), prices)
    return priced.select("request_id", "pricing_missing", ledger.cost_microunits(priced).alias("cost"))


@query("SELECT user_id, min_by(event_id, struct_pack(ts := ts, event_id := event_id)) AS event_id, arg_min(event_type, struct_pack(ts := ts, event_id := event_id)) AS event_type FROM events GROUP BY user_id")
def idempotent_append(spark, sf_dir) -> DataFrame:
    """The first write of a key stands."""
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return ledger.first_writes(e, "user_id", "at").select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, c_name, round(CASE WHEN n IS NOT NULL THEN n ELSE c_acctbal END, 6) AS c_acctbal FROM customer LEFT JOIN (SELECT user_id, max(event_id) AS l, arg_max(value, event_id) AS n FROM events GROUP BY user_id) ON c_custkey = user_id")
def upsert_latest(spark, sf_dir) -> DataFrame:
    """Rows by key, the latest of all changes wins."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(-1).cast("long").alias("version"))
    names = base.select("c_custkey", "c_name")
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"), F.col("event_id").alias("version")).join(names, "c_custkey")
    return merges.upsert(base, changes.select(*base.columns), ["c_custkey"], "version").select("c_custkey", "c_name", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("SELECT conv_id, turn, 100 + row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS sequence FROM conversations")
def event_append(spark, sf_dir) -> DataFrame:
    """Appended rows are numbered on from each conversation's last."""
    c = table(spark, sf_dir, "conversations")
    return merges.append_numbered(c, "conv_id", ["turn", "role", "text"], c.select("conv_id").distinct().withColumn("last", F.lit(100))).select("conv_id", "turn", "sequence")


@query("SELECT name, 'counter' AS kind, name || '{type=\"' || t || '\"} ' || n AS line FROM (SELECT 'events_total' AS name, event_type AS t, count(*) AS n FROM events GROUP BY event_type)")
def metrics_text(spark, sf_dir) -> DataFrame:
    """Counters as exposition text."""
    n = table(spark, sf_dir, "events").groupBy("event_type").count()
    line = F.format_string('events_total{type="%s"} %d', "event_type", "count")
    return n.select(F.lit("events_total").alias("name"), F.lit("counter").alias("kind"), line.alias("line"))

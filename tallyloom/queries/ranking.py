"""Windows, sequences, distributions and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, ops, sequences
from .registry import query, table


@query("SELECT event_type, count(value) AS count, round(min(value), 3) AS min, round(quantile_disc(value, 0.5), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95, round(quantile_disc(value, 0.99), 3) AS p99, round(max(value), 3) AS max, round(avg(value), 3) AS mean FROM events GROUP BY event_type")
def percentile_distribution(spark, sf_dir) -> DataFrame:
    """A41, A42, A44."""
    return ops.distribution(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT bound::DOUBLE AS bound, count(*) FILTER (value <= bound) AS cumulative FROM events, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120]) AS bound) WHERE value >= 0 GROUP BY bound")
def histogram_buckets(spark, sf_dir) -> DataFrame:
    """A47."""
    return ops.histogram(table(spark, sf_dir, "events"), "value")


@query("WITH c AS (SELECT o_orderpriority, o_orderdate AS t, 1 AS d FROM orders UNION ALL SELECT o_orderpriority, o_orderdate + to_days((o_orderkey % 30)::INT), -1 FROM orders) SELECT o_orderpriority, greatest(max(n), 0)::BIGINT AS peak FROM (SELECT o_orderpriority, sum(d) OVER (PARTITION BY o_orderpriority ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM c) GROUP BY 1")
def peak_concurrency(spark, sf_dir) -> DataFrame:
    """Open orders of each priority at most."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("make_dt_interval(o_orderkey % 30)")).alias("end"))
    return ops.peak_overlap(o, ["o_orderpriority"], "month")


_STATUS = "CASE event_id % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' WHEN 2 THEN 'running' ELSE 'succeeded' END"


@query(f"WITH j AS (SELECT event_id // 4 AS batch, {_STATUS} AS status FROM events), c AS (SELECT batch, count(*) AS total, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed FROM j GROUP BY batch) SELECT *, CASE WHEN running > 0 OR queued > 0 AND succeeded + failed > 0 THEN 'running' WHEN queued > 0 THEN 'queued' WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'succeeded' END AS batch_status, round(100.0 * (succeeded + failed) / total, 2)::DOUBLE AS progress FROM c")
def derived_batch_status(spark, sf_dir) -> DataFrame:
    """A50-A52, T15."""
    jobs = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("batch"), F.expr(_STATUS).alias("status"))
    return ops.batch_status(jobs, "batch")


@query("SELECT event_id, least(300, 5 * pow(2, event_id % 9))::BIGINT AS delay, ts IS NULL OR ts <= TIMESTAMP '2024-01-15' AS due, greatest(0, epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts)) / 1e6 AS waited FROM events")
def retry_and_due(spark, sf_dir) -> DataFrame:
    """M07, M09, M10."""
    now = F.lit("2024-01-15").cast("timestamp")
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", ops.retry_delay(F.col("event_id") % 9 + 1).alias("delay"), ops.is_due(at, now).alias("due"), ops.seconds_between(at, now).alias("waited"))


@query("SELECT count(*) AS requests, round(count(*) FILTER (event_id % 8 = 0) / count(*), 6) AS error_rate, round(count(*) / 60.0::DOUBLE, 3) AS throughput FROM events")
def load_summary(spark, sf_dir) -> DataFrame:
    """A43."""
    return ops.load_summary(table(spark, sf_dir, "events").withColumn("ok", F.col("event_id") % 8 != 0), 60.0)


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS large, round(count(*) FILTER (value > 100)::DOUBLE / count(*), 4) AS share FROM events GROUP BY event_type")
def conditional_rates(spark, sf_dir) -> DataFrame:
    """Rates that are null where nothing is counted."""
    large = F.count_if(F.col("value") > 100)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), large.alias("large"), ops.rate(large, F.count(F.lit(1))).alias("share"))


@query("SELECT doc_id, source, first AS duplicate_of FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY lang, text) AS m, CASE WHEN doc_id <> m THEN m END AS first FROM documents)")
def duplicate_marking(spark, sf_dir) -> DataFrame:
    """Later rows of the same text, by hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return sequences.duplicate_marks(d, ["lang", "sha"], "doc_id").select("doc_id", "source", "duplicate_of")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) ORDER BY r, source LIMIT 90")
def round_robin_sample(spark, sf_dir) -> DataFrame:
    """One document of each source a round."""
    return fusion.round_robin(table(spark, sf_dir, "documents"), "source", "doc_id", 90).select("doc_id", "source")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def event_tail(spark, sf_dir) -> DataFrame:
    """The last turns of each conversation."""
    return sequences.tail(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM (SELECT *, max((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM conversations) WHERE seen = 1")
def after_first_user(spark, sf_dir) -> DataFrame:
    """Turns from the first user turn on."""
    return sequences.from_first(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "role")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def retention_trim(spark, sf_dir) -> DataFrame:
    """The newest twenty events of each user."""
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return sequences.tail(e, "user_id", "at", 20).select("user_id", "event_id")


_CONT = "event_id % 3 = 0"


@query(f"SELECT user_id, event_id, CASE WHEN {_CONT} THEN coalesce(last_value(CASE WHEN NOT ({_CONT}) THEN 'T' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'T' || event_id) ELSE 'T' || event_id END AS title FROM events")
def title_carry_forward(spark, sf_dir) -> DataFrame:
    """Continued rows take the last title before them."""
    e = table(spark, sf_dir, "events").withColumn("own", F.concat(F.lit("T"), F.col("event_id").cast("string")))
    return e.select("user_id", "event_id", sequences.carried_titles(e, ["user_id"], "event_id", "own", F.expr(_CONT)).alias("title"))


@query("SELECT user_id, event_id, coalesce(event_id // 50 = lag(event_id // 50) OVER w + 1 AND event_type IS NOT DISTINCT FROM lag(event_type) OVER w, false) AS continues FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def continuation_lag(spark, sf_dir) -> DataFrame:
    """The row before is alike and on the page before."""
    e = table(spark, sf_dir, "events").withColumn("page", F.floor(F.col("event_id") / 50))
    return e.select("user_id", "event_id", sequences.continues_previous(["user_id"], "event_id", "page", ["event_type"]).alias("continues"))


@query("SELECT o_custkey, arg_min(o_orderkey, struct_pack(a := CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, b := o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def preferred_phase(spark, sf_dir) -> DataFrame:
    """The row of the first phase, then the first."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return sequences.preferred(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", rank, "o_orderkey").select("o_custkey", "o_orderkey")


@query("WITH d AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day, event_type AS item FROM events), s AS (SELECT user_id, day, count(*) AS items, count(*) FILTER (day = first) AS fresh FROM (SELECT *, min(day) OVER (PARTITION BY user_id, item) AS first FROM d) GROUP BY user_id, day), i AS (SELECT *, sum((fresh > 0)::INT) OVER (PARTITION BY user_id ORDER BY day) AS island FROM s) SELECT user_id, day, items, fresh, sum((fresh = 0)::INT) OVER (PARTITION BY user_id, island ORDER BY day)::BIGINT AS zeros FROM i")
def novelty_runs(spark, sf_dir) -> DataFrame:
    """What is new in each step, and runs of steps without anything new."""
    e = table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("item"))
    return sequences.novelty(e, "user_id", "day", "item")


_OVER = "p.held + r.chars > 600 OR p.n >= 3"


@query(f"WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), p AS (SELECT conv_id, turn, chars, i, 0 AS part, chars AS held, 1 AS n FROM r WHERE i = 1 UNION ALL SELECT r.conv_id, r.turn, r.chars, r.i, CASE WHEN {_OVER} THEN p.part + 1 ELSE p.part END, CASE WHEN {_OVER} THEN r.chars ELSE p.held + r.chars END, CASE WHEN {_OVER} THEN 1 ELSE p.n + 1 END FROM p JOIN r ON r.conv_id = p.conv_id AND r.i = p.i + 1) SELECT conv_id, turn, chars, part::BIGINT AS part FROM p")
def char_budget_packing(spark, sf_dir) -> DataFrame:
    """Turns of a conversation in parts of at most 600 characters and three turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return sequences.packed(c, "conv_id", "turn", "chars", 600, 3)


@query("SELECT conv_id, turn, chars, CASE WHEN left_ > 200 THEN least(chars, left_) ELSE 0 END::BIGINT AS taken FROM (SELECT conv_id, turn, length(text) AS chars, 900 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM conversations)")
def budget_prefix(spark, sf_dir) -> DataFrame:
    """What each turn gets of 900 characters."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return sequences.budget_prefix(c, "conv_id", "turn", "chars", 900, 200)


@query("WITH r AS (SELECT conv_id, turn, (length(text) % 3)::BIGINT AS level FROM conversations) SELECT a.conv_id, a.turn, a.level, coalesce(min(b.turn) - 1, max(m))::BIGINT AS \"end\" FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM r) a LEFT JOIN r b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.level <= a.level GROUP BY a.conv_id, a.turn, a.level")
def section_subtrees(spark, sf_dir) -> DataFrame:
    """Where each heading's part of the tree ends; turns as headings."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 3).cast("long").alias("level"))
    return sequences.subtree_ends(c, "conv_id", "turn", "level")


@query("WITH c AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 END::DOUBLE AS level, role || turn::VARCHAR AS title FROM conversations), h AS (SELECT c.conv_id, c.turn, h.turn AS at, h.title FROM c JOIN c h ON h.conv_id = c.conv_id AND h.turn <= c.turn AND h.level IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM c g WHERE g.conv_id = h.conv_id AND g.turn > h.turn AND g.turn <= c.turn AND g.level <= h.level)) SELECT c.conv_id, c.turn, c.level, c.title, coalesce(string_agg(h.title, ' / ' ORDER BY h.at), '') AS path FROM c LEFT JOIN h ON h.conv_id = c.conv_id AND h.turn = c.turn GROUP BY ALL")
def section_paths(spark, sf_dir) -> DataFrame:
    """The headings that enclose each turn; user turns head, assistant turns are text."""
    c = table(spark, sf_dir, "conversations")
    level = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).cast("double")
    return sequences.section_paths(c.select("conv_id", "turn", level.alias("level"), F.concat(F.col("role"), F.col("turn").cast("string")).alias("title")), "conv_id", "turn", "level", "title")

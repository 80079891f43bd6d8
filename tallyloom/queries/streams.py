"""Stateful operators over ``events`` and ``conversations``, as batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import state
from .registry import query, table


_LIMITED = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, event_id, ts::TIMESTAMP AS ts FROM events),
w AS (SELECT key, min(ts) AS start FROM e GROUP BY key UNION ALL SELECT w.key, min(e.ts) FROM w JOIN e ON e.key = w.key AND e.ts >= w.start + INTERVAL 6 HOUR GROUP BY w.key)
SELECT key, event_id, n <= 5 AS allowed, n AS used FROM (SELECT e.key, event_id, row_number() OVER (PARTITION BY e.key, w.start ORDER BY e.ts, event_id) AS n FROM e ASOF JOIN w ON e.key = w.key AND e.ts >= w.start)"""


@query(_LIMITED)
def rate_limiter(spark, sf_dir) -> DataFrame:
    """Five events a user in windows that open at the user's first event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return state.rate_limited(e, 5, 6 * 3600)


@query(_LIMITED.replace("SELECT key, event_id, n <= 5 AS allowed, n AS used", "SELECT key, event_id").replace("6 HOUR", "24 HOUR") + " WHERE n = 1")
def idempotency_keys(spark, sf_dir) -> DataFrame:
    """Events that reserve their user for a day."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return state.reserved(e, 24 * 3600)


@query("SELECT event_id, status, CASE WHEN o AND attempts >= 3 THEN 'dead' WHEN o THEN 'queued' ELSE status END AS next_status, CASE WHEN o AND attempts < 3 THEN least(300, 5 * pow(2, attempts - 1))::BIGINT END AS delay FROM (SELECT *, status = 'running' AND ts < TIMESTAMP '2024-01-15' AS o FROM (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' ELSE 'done' END AS status, event_id % 4 + 1 AS attempts FROM events))")
def lease_expiry(spark, sf_dir) -> DataFrame:
    """What becomes of leases that are over."""
    i = F.col("event_id")
    jobs = table(spark, sf_dir, "events").select(i, F.when(i % 3 == 0, "running").when(i % 3 == 1, "queued").otherwise("done").alias("status"), (i % 4 + 1).alias("attempts"), F.col("ts").cast("timestamp").alias("lease_until"))
    return state.expired_leases(jobs, "2024-01-15").select("event_id", "status", "next_status", "delay")


@query("SELECT job_id, batch FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY priority DESC, created, job_id) AS r FROM (SELECT event_id AS job_id, user_id AS batch, event_id % 4 AS priority, ts AS created FROM events WHERE event_type = 'click')) WHERE r <= 3 ORDER BY priority DESC, created, job_id LIMIT 100")
def claim_admission(spark, sf_dir) -> DataFrame:
    """Queued jobs that may start, three a batch and a hundred in all."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    queue = e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("batch"), (F.col("event_id") % 4).alias("priority"), F.col("ts").alias("created"))
    return state.admitted(queue, 3, 100).select("job_id", "batch")


@query("SELECT seq, event_type FROM (SELECT event_id AS seq, event_type FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 1000) WHERE seq > 3000 ORDER BY seq LIMIT 25")
def replay_since(spark, sf_dir) -> DataFrame:
    """A stream's events after a cursor."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("stream"), "event_type")
    return state.read_since(log, "7", 3000, 25).select("seq", "event_type")


@query("SELECT conv_id, max(turn) - 2 AS upto FROM conversations GROUP BY conv_id HAVING count(*) >= 4")
def compaction_ranges(spark, sf_dir) -> DataFrame:
    """How far conversations of four turns or more are summarised."""
    return state.compaction_ranges(table(spark, sf_dir, "conversations"), "conv_id", "turn", 4, 2)


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'reply' ELSE 'note' END AS kind, content FROM (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g') ELSE text END AS content FROM conversations) WHERE content <> ''")
def event_messages(spark, sf_dir) -> DataFrame:
    """Events as messages by kind, with their whole content; a user's is stripped, and left out if blank."""
    c = table(spark, sf_dir, "conversations")
    stripped = F.regexp_replace("text", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "reply").otherwise("note")
    return c.select("conv_id", "turn", kind.alias("kind"), F.when(F.col("role") == "user", stripped).otherwise(F.col("text")).alias("content")).filter("content <> ''")

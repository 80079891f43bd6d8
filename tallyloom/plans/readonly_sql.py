"""Questions answered by read-only SQL over a few listed tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 200
#: Words that no statement may hold, not even in a literal (fixed values).
FORBIDDEN = "insert update delete drop alter create replace truncate attach detach pragma vacuum grant revoke copy merge".split()
_FORBIDDEN = re.compile(rf"\b({'|'.join(FORBIDDEN)})\b", re.IGNORECASE)
#: Questions that are known: words that must occur, and the statement.
TEMPLATES = {
    ("customers", "segment"): "SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY c_mktsegment ORDER BY customers DESC, segment",
    ("orders", "status"): "SELECT o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY o_orderstatus ORDER BY orders DESC, status",
    ("orders", "priority"): "SELECT o_orderpriority AS priority, count(*) AS orders FROM orders GROUP BY o_orderpriority ORDER BY orders DESC, priority",
}


def validate(sql: str) -> str:
    """The statement, if it reads only. Raises ValueError otherwise."""
    text = sql.strip()
    if not re.match(r"(?i)(select|with)\b", text):
        raise ValueError("only SELECT or WITH is allowed")
    if ";" in text or "--" in text or "/*" in text:
        raise ValueError("several statements or comments are not allowed")
    if found := _FORBIDDEN.search(text):
        raise ValueError(f"{found[0]} is not allowed")
    return text


def plan(question: str, planner=None) -> str:
    """The statement of the first template whose words are in the question, else what ``planner`` says."""
    words = question.lower()
    for needed, sql in TEMPLATES.items():
        if all(w in words for w in needed):
            return sql
    if planner is None:
        raise ValueError("no template answers this question")
    return planner(question)


def run(sql: str, tables: dict[str, DataFrame], rows: int = ROWS) -> DataFrame:
    """At most ``rows`` rows of the statement, in a session of its own: only ``tables`` are visible."""
    statement = validate(sql)
    session = next(iter(tables.values())).sparkSession.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in tables.items():
        shared = f"{name}_{uuid.uuid4().hex}"  # a name that no question can guess
        df.createOrReplaceGlobalTempView(shared)
        session.table(f"global_temp.{shared}").createOrReplaceTempView(name)
    return session.sql(statement).limit(rows)


def is_truncated(sql: str, tables: dict[str, DataFrame], rows: int = ROWS) -> bool:
    """Whether there are more rows than are returned."""
    return run(sql, tables, rows + 1).count() > rows


def answer(question: str, tables: dict[str, DataFrame], planner=None) -> DataFrame:
    return run(plan(question, planner), tables)


def schema(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    return {name: df.columns for name, df in tables.items()}


def chart_points(df: DataFrame, kind: str = "bar") -> DataFrame:
    """type, label, value and denominator: a metric for a single value, else a point for each of the first rows, of
    their first two columns, with the sum of the values."""
    rows = df.limit(ROWS)
    label, value = (F.col(df.columns[0]).cast("string"), F.col(df.columns[1])) if len(df.columns) > 1 else (F.lit(None).cast("string"), F.col(df.columns[0]))
    points = rows.select(label.alias("label"), value.cast("double").alias("value"))
    total = points.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("denominator"), F.count(F.lit(1)).alias("_n"))
    single = (F.col("_n") == 1) & F.lit(len(df.columns) == 1)
    out = points.join(F.broadcast(total))  # one row
    return out.select(F.when(single, "metric").otherwise(kind).alias("type"), "label", "value", F.when(~single, F.col("denominator")).alias("denominator"))


def chart(df: DataFrame, kind: str = "bar") -> dict:
    """The points as a drawing takes them: ROWS rows at most reach the driver."""
    rows = chart_points(df, kind).collect()
    if rows and rows[0]["type"] == "metric":
        return {"type": "metric", "value": rows[0]["value"]}
    return {"type": kind, "points": [{"label": r["label"], "value": r["value"]} for r in rows], "denominator": rows[0]["denominator"] if rows else 0}

"""Claims against tables: which column a property is, which row a sample is, and what the cell says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statements, text


#: Parts into which rows of equal values are dealt, so that a value that very many rows have is no one task.
PARTS = 64


def once(rows: DataFrame, on: list[str], made: Column) -> DataFrame:
    """``rows`` with ``made``, a value that the columns ``on`` settle, as the column ``made``. It is computed for the first row of
    each part of the rows of equal ``on`` and carried on to those that follow, in one sort; nothing is read twice or
    joined back by a value that is frequent."""
    rest = [c for c in rows.columns if c not in on]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rest), F.lit(PARTS)))
    same = Window.partitionBy(*on, "_part").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = dealt.withColumn("_n", F.row_number().over(same)).withColumn("made", F.when(F.col("_n") == 1, made))
    return first.withColumn("made", F.first("made", ignorenulls=True).over(same)).drop("_n", "_part")


def _chosen(met: DataFrame) -> DataFrame:
    """``met`` (property, title, headers and others) with ``made``, the column that the property names: state, header and
    score; null without a property or headers. A property meets a title and a list of headers once a part."""
    alike = F.transform("headers", lambda h: F.struct(statements.header_similarity(F.col("property"), h).alias("score"), h.alias("header")))
    pick = lambda c: F.struct(F.lit("unique").alias("state"), c["header"].alias("header"), c["score"].alias("score"))
    none = lambda s: F.struct(F.lit(s).alias("state"), F.lit(None).cast("string").alias("header"), F.lit(None).cast("double").alias("score"))

    def of(x: Column) -> Column:
        r, t = x["r"], x["t"]
        best, qualified = F.element_at(r, 1), F.filter(r, lambda h: h["score"] >= 1)
        clear = (F.size(r) == 1) | (best["score"] - F.try_element_at(r, F.lit(2))["score"] >= 0.1)
        by_title = (t >= 0.5) & ((F.size(qualified) == 1) | (F.size(r) == 1))
        return F.when(best["score"] >= 0.35, F.when(clear, pick(best)).otherwise(none("ambiguous"))).when(by_title, pick(best)).otherwise(none("unbound"))

    ranked = F.struct(F.sort_array(alike, asc=False).alias("r"), text.concept_similarity(F.col("property"), F.col("title")).alias("t"))
    return once(met, ["property", "title", "headers"], F.when(F.col("property").isNotNull() & F.col("headers").isNotNull(), text.let(ranked, of)))


def _listed(headers: DataFrame) -> DataFrame:
    return headers.groupBy("table_id").agg(F.sort_array(F.collect_set("header")).alias("headers"))


def bound_columns(asked: DataFrame, headers: DataFrame) -> DataFrame:
    """claim_id, table_id, state, header, score: the column of a table that a property names. ``asked``: claim_id,
    table_id, property, title; ``headers``: table_id, header, those that state conditions left out.

    A header that is alike enough (0.35) and by a margin (0.1) is 'unique', one without the margin 'ambiguous'.
    Where only the table's title is alike, the one qualified or only header does. A table's headers are
    few, so they are ranked as an array."""
    met = asked.select("claim_id", "table_id", "property", F.coalesce("title", F.lit("")).alias("title")).join(_listed(headers), "table_id")
    return _chosen(met).filter("made IS NOT NULL").select("claim_id", "table_id", "made.*")


def sample_rows(cells: DataFrame, profile: DataFrame) -> DataFrame:
    """table_id, row, match, parameters: rows with cells that agree with a sample's parameters. ``cells``:
    table_id, row, col, header, value, without the property's column; ``profile``: table_id, place,
    parameter, target. From the left each cell gives a parameter that no cell before it gave. Rows that state
    a target exactly are preferred to those whose bounds hold it."""
    met = cells.join(profile, "table_id").select("table_id", "row", "col", "place", "parameter", "value", "target")
    hits = once(met, ["value", "target"], statements.cell_match(F.col("value"), F.col("target"))).withColumnRenamed("made", "kind").filter("kind IS NOT NULL")
    found = hits.groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "place", "parameter", "kind"))).alias("h"))
    start = F.struct(F.lit(None).cast("long").alias("col"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("kinds"))

    def step(a: Column, x: Column) -> Column:
        taken = F.struct(x["col"].cast("long").alias("col"), F.array_append(a["names"], x["parameter"]).alias("names"), F.array_append(a["kinds"], x["kind"]).alias("kinds"))
        return F.when(x["col"].cast("long").eqNullSafe(a["col"]) | F.array_contains(a["names"], x["parameter"]), a).otherwise(taken)

    rows = found.select("table_id", "row", F.aggregate("h", start, step).alias("a"))
    rows = rows.select("table_id", "row", F.when(F.array_contains("a.kinds", "exact"), "exact").otherwise("range").alias("match"), F.col("a.names").alias("parameters"))
    best = F.min("match").over(Window.partitionBy("table_id"))  # a table's rows are few
    return rows.withColumn("best", best).filter(F.col("match") == F.col("best")).drop("best")


def table_claims(requirements: DataFrame, cells: DataFrame, profile: DataFrame, conditions: list[str]) -> DataFrame:
    """claim_id, mode, status, reason: requirements decided by their table where one cell answers them.
    ``requirements``: claim_id, table_id, title, text, unit, project. The property picks the column, the
    sample's parameters the row, and the claim is compared with the cell under its header. Where a step has
    no one answer the mode is 'fallback' and the reason names the step."""
    asked = requirements.select("claim_id", "table_id", "title", "text", "unit", "project")
    parsed = once(asked, ["text", "unit", "project"], statements.requirement(F.col("text"), F.col("unit"), F.col("project")))
    said = ["text", "unit", "project"]  # what a claim is made of, and is told by
    r = parsed.select("claim_id", "table_id", *said, F.coalesce("title", F.lit("")).alias("title"), F.col("made.claim").alias("claim"), F.col("made.ready").alias("ready")).withColumn("property", F.when(F.col("ready"), F.col("claim.property")))
    headers = cells.filter(~F.col("header").isin(conditions)).select("table_id", "header").distinct()
    rows = sample_rows(cells.filter(F.col("header").isin(conditions)), profile).groupBy("table_id").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("bound_row"))
    met = _chosen(r.join(_listed(headers), "table_id", "left").join(rows, "table_id", "left"))
    met = met.select("claim_id", "table_id", *said, "claim", "ready", "rows", "bound_row", F.col("made.state").alias("state"), F.col("made.header").alias("target_header"))
    target = cells.select(F.col("table_id").alias("t"), F.col("row").alias("cell_row"), F.col("header").alias("h"), F.col("value").alias("cell"))
    met = met.join(target, (F.col("table_id") == F.col("t")) & (F.col("bound_row") == F.col("cell_row")) & (F.col("target_header") == F.col("h")) & (F.col("rows") == 1), "left")
    result = F.when(F.col("cell").isNotNull(), statements.compared(F.col("claim"), statements.claim(F.concat("h", F.lit(": "), "cell"))))
    met = once(met.select("claim_id", *said, "claim", "h", "cell", "ready", "state", "rows"), [*said, "h", "cell"], result).withColumnRenamed("made", "result")
    status = F.when(F.col("result.relation").isin("supports", "equal"), "supported").when(F.col("result.relation").isin("conflicts", "different"), "mismatch")
    reason = (
        F.when(~F.col("ready"), "requirement_not_program_ready").when(F.coalesce("state", F.lit("unbound")) != "unique", "property_not_bound")
        .when(F.coalesce("rows", F.lit(0)) == 0, "row_not_bound").when(F.col("rows") > 1, "row_ambiguous").otherwise(F.coalesce("result.reason", "result.tightness"))
    )
    return met.select("claim_id", F.when(status.isNotNull(), "programmatic_table").otherwise("fallback").alias("mode"), status.alias("status"), reason.alias("reason"))

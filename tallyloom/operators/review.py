"""Relations between judgments, requirements, jobs and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys whose cards are counted, to deal out those of very many.
OFTEN = 1000


def above_threshold(candidates: DataFrame, key: str, threshold: float, k: int) -> DataFrame:
    """The ``k`` best by rrf of a key's candidates (id, rrf, route_scores: map) with a route score of
    ``threshold`` or more; ties to smaller ids."""
    best = F.coalesce(F.array_max(F.map_values("route_scores")), F.lit(-1.0))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("rrf").desc(), "id"))
    return candidates.filter(best >= threshold).withColumn("place", place).filter(F.col("place") <= k)


def valid_requirements(items: DataFrame, phases: list[str]) -> DataFrame:
    """``items`` (report_id, item, phase, project, requirements: array of text and result) with blank
    requirements left out, and ``issue``: why an item is refused. Items with none left are dropped."""
    kept = F.filter("requirements", lambda r: F.trim(F.coalesce(r["text"], F.lit(""))) != "")
    out = items.withColumn("requirements", kept).filter(F.size("requirements") > 0)
    leaked = F.exists("requirements", lambda r: r["result"].isNotNull())
    issue = F.when(F.trim(F.coalesce("project", F.lit(""))) == "", "no_project").when(~F.coalesce("phase", F.lit("")).isin(*phases), "invalid_phase").when(leaked, "result_field")
    return out.withColumn("issue", issue)


def active_job(jobs: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """report, job_id: the first queued or running job whose JSON result names the report."""
    live = jobs.filter(F.col("status").isin("queued", "running")).select("job_id", F.get_json_object("result", path).alias("report"))
    return live.join(wanted, "report").groupBy("report").agg(F.min("job_id").alias("job_id"))


Rules = list[tuple[tuple[str, ...], tuple[str, ...]]]


def peer_terms(whole: Column, rules: Rules) -> Column:
    """The related terms of all rules (triggers, related) of which a trigger is in the text, in order, each once."""
    of = [F.when(F.exists(F.array(*map(F.lit, triggers)), lambda t: F.contains(whole, t)), F.array(*map(F.lit, related))).otherwise(F.array().cast("array<string>")) for triggers, related in rules]
    return F.filter(F.array_distinct(F.concat(*of)), lambda t: t != "")


def peers(requirements: DataFrame, asked: DataFrame, rules: Rules, k: int = 12) -> DataFrame:
    """asked_id, id, score, place: requirements beside an asked one of the same report: three for each of the asked's
    terms that they hold, two for the same item, one for the same phase; zeros and the asked itself are left out, and
    so are all of its item, phase and text. Terms come from ``rules``, by what the asked one says. Both sides have
    report, item, phase, project and text; ``asked`` has asked_id, ``requirements`` id.

    What decides a score are report, item, phase and the terms held, so requirements of equal ones are a class. Of a
    text a class needs no more than k rows, and then 2 k rows in all, for whichever text is left out: a report of very
    many requirements is as many rows for an asked one as it has classes."""
    whole = lambda: F.concat_ws(" ", "project", "text")
    bare = lambda: F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(""))
    terms = sorted({t for _, related in rules for t in related if t})
    held = F.filter(F.array(*[F.when(F.contains(whole(), F.lit(t)), F.lit(t)) for t in terms]), lambda t: t.isNotNull())
    cls = ["report", "item", "phase", "held"]
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    few = requirements.select("id", "report", "item", "phase", held.alias("held"), bare().alias("bare"))
    few = few.withColumn("_n", first(*cls, "bare")).filter(F.col("_n") <= k).withColumn("_n", first(*cls)).filter(F.col("_n") <= 2 * k)
    a = asked.select("asked_id", F.col("report").alias("r"), F.col("item").alias("i"), F.col("phase").alias("p"), bare().alias("t"), peer_terms(whole(), rules).alias("terms")).filter(F.size("terms") > 0)
    same_item, same_phase = F.coalesce("item", F.lit("")) == F.coalesce("i", F.lit("")), F.coalesce("phase", F.lit("")) == F.coalesce("p", F.lit(""))
    score = 3 * F.size(F.array_intersect("terms", "held")) + F.when(same_item, 2).otherwise(0) + F.when(same_phase, 1).otherwise(0)
    scored = few.join(a, F.col("report") == F.col("r")).filter(~(same_item & same_phase & (F.col("bare") == F.col("t")))).withColumn("score", score).filter("score > 0")
    place = F.row_number().over(Window.partitionBy("asked_id").orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).select("asked_id", "id", "score", "place")


def shadow_labels(rows: DataFrame, cases: DataFrame, shadow: DataFrame) -> DataFrame:
    """``rows`` (project, requirement, actual, expected) with case_id, shadow and whether it is right: the
    shadow run's status of the row's case, or the actual one where there is no case or no shadow."""
    met = rows.join(cases.select("project", "requirement", "case_id"), ["project", "requirement"], "left").join(shadow.select("case_id", "status"), "case_id", "left")
    status = F.coalesce("status", "actual")
    return met.select(*rows.columns, "case_id", status.alias("shadow"), status.eqNullSafe(F.col("expected")).alias("shadow_correct"))


def defect_contracts(edits: DataFrame, records: DataFrame, contracts: DataFrame) -> DataFrame:
    """edit_id, state, verdict_agrees, kind_agrees, flags_agree: what each edit of a manifest was to change
    (contracts: edit_kind, verdict, kinds, flags) against the record of its case."""
    met = edits.join(records.withColumnsRenamed({"verdict": "got_verdict", "kind": "got_kind", "flags": "got_flags"}), F.col("edit_id") == F.col("case_id"), "left").join(contracts, "edit_kind", "left")
    missing = F.col("case_id").isNull()
    some = F.size(F.coalesce("kinds", F.array().cast("array<string>"))) > 0
    within = F.size(F.array_except(F.coalesce("flags", F.array().cast("array<string>")), "got_flags")) == 0
    when = lambda c: F.when(~missing, c)
    return met.select("edit_id", F.when(missing, "missing_from_gold").otherwise("found").alias("state"), when(F.col("got_verdict").eqNullSafe(F.col("verdict"))).alias("verdict_agrees"), when(F.when(some, F.array_contains("kinds", F.col("got_kind")))).alias("kind_agrees"), when(within).alias("flags_agree"))


def first_written(items: DataFrame, fields: list[str], order: str) -> DataFrame:
    """key, and for each of ``fields`` the first value written for it, else an empty text. ``items``: key, field,
    value."""
    first = lambda f: F.coalesce(F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col(order))), F.lit("")).alias(f)
    return items.groupBy("key").agg(*map(first, fields))


def sufficiency(hits: DataFrame, key: str, wants: dict[str, Column], threshold: float = 0.2) -> DataFrame:
    """key, gap: why the evidence of a query is not enough, by the first that holds, '' if it is: no hits, all
    scores under the threshold, no table, number or clause where the query wants one. ``hits``: key, query,
    type, text, score, with a row of nulls for a query without hits."""
    g = hits.groupBy(key, "query").agg(
        F.count("text").alias("n"), F.max("score").alias("best"), F.coalesce(F.bool_or(F.col("type") == "table"), F.lit(False)).alias("table"),
        F.coalesce(F.bool_or(F.col("text").rlike("[0-9]")), F.lit(False)).alias("numeric"), F.coalesce(F.bool_or(F.col("text").rlike("第\\s*[0-9一二三四五六七八九十]+\\s*条|条款|规定|标准")), F.lit(False)).alias("clause"),
    )
    gap = F.when(F.col("n") == 0, "no_evidence").when(F.col("best") < threshold, "low_confidence")
    for kind, name in (("table", "missing_structured_evidence"), ("numeric", "missing_numeric_evidence"), ("clause", "missing_clause_evidence")):
        gap = gap.when(wants[kind] & ~F.col(kind), name)
    return g.select(key, gap.otherwise("").alias("gap"))


def selected(array: str, keys: Column) -> Column:
    """Of an array of structs with ``key`` those whose key is among ``keys``."""
    return F.filter(array, lambda x: F.array_contains(keys, x["key"]))


def checked_cards(cards: DataFrame, sources: DataFrame, most_chars: int = 600, part: int = 100_000) -> DataFrame:
    """``cards`` (case_id, position, key, role, quote, value) with ``issue``, the first reason to refuse one, or
    null: a source (key, source, roles) that is not known, a role it has not, a quote that is empty, too long
    or not in it, a number of the value that is not in the quote, a quote given before.

    A key that more than ``part`` cards name, known or not, is dealt into parts of about so many, for the OFTEN most
    frequent keys; its source goes to each part. Cards without a key are dealt like that too."""
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    often = cards.agg(F.expr(f"approx_top_k(key, {OFTEN}, {OFTEN * 10})").alias("t")).select(F.explode("t").alias("t")).filter(F.col("t.count") > part)
    often = F.broadcast(often.select(F.col("t.item").alias("key"), F.ceil(F.col("t.count") / part).cast("int").alias("_parts")))  # OFTEN rows at most
    parts = F.coalesce("_parts", F.when(F.col("key").isNull(), OFTEN).otherwise(1))
    dealt = cards.join(often, "key", "left").withColumn("_part", F.pmod(F.xxhash64(*cards.columns), parts).cast("int")).drop("_parts")
    known = sources.join(often, "key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    met = dealt.join(known, ["key", "_part"], "left").drop("_part")
    issue = (
        F.when(F.col("source").isNull(), "unknown_key").when(~F.array_contains("roles", F.col("role")), "role").when((F.col("quote") == "") | (F.length("quote") > most_chars), "quote_length")
        .when(~F.contains("source", F.col("quote")), "not_in_source").when(F.size(F.array_except(digits(F.col("value")), digits(F.col("quote")))) > 0, "number")
    )
    met = met.withColumn("issue", issue)
    place = F.row_number().over(Window.partitionBy("case_id", "key", "quote", "issue").orderBy("position", "value"))
    return met.withColumn("place", place).withColumn("issue", F.when(F.col("issue").isNull() & (F.col("place") > 1), "repeated").otherwise(F.col("issue"))).drop("place", "source", "roles")

"""Reports as nested JSON documents: the sink, and their headers with what can't be read as a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A report's fields that the header has (fixed names).
HEADER = "version int, scope string, audit_mode string, report string, report_file_id string, report_file_name string, assistant_id string, assistant_name string, knowledge_base_id string, knowledge_base_name string, job_id string, retrieval_policy string, started_at string, finished_at string"
_BODY = HEADER + ", run_id string, summary struct<cases:long,judgments:map<string,long>,authority:map<string,long>>, cases array<struct<case_id:string>>, _wrong string"
#: Beginnings of report names and the kinds they tell (fixed values); a name with 'retrieval' is of that kind.
KINDS = (("hbjc_end_to_end_audit", "end_to_end_audit"), ("end_to_end_audit", "end_to_end_audit"), ("hbjc_retrieval_group_eval", "retrieval_group_eval"))


def report_kind(name: Column) -> Column:
    out = F.when(F.contains(name, F.lit("retrieval")), "retrieval").otherwise("report")
    for start, kind in reversed(KINDS):
        out = F.when(name.startswith(start), kind).otherwise(out)
    return out


def write_reports(runs: DataFrame, path: str, by: str = "scope") -> None:
    """A nested JSON document a line for each row, in folders by ``by``, which stays in the documents. Nulls are
    written, so a document has all fields. Rows of one folder stay in the tasks that have them."""
    runs.withColumn(f"by_{by}", F.col(by)).write.mode("append").partitionBy(f"by_{by}").option("ignoreNullFields", False).json(path)


def final_reports(cases: DataFrame, header: DataFrame, key: str = "run_id") -> DataFrame:
    """A row a run, nested: its header, ``summary`` (cases, judgments by status) and ``cases`` in order of case_id.
    ``cases``: run_id, case_id, status. Runs without cases have an empty list. Statuses are counted before the lists
    are built, and a run's cases are one document."""
    counts = cases.groupBy(key, "status").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("judgments"))
    lists = cases.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("case_id", "status"))).alias("cases"))
    met = header.join(counts, key, "left").join(lists, key, "left")
    empty = F.from_json(F.lit("[]"), "array<struct<case_id:string,status:string>>")
    summary = F.struct(F.coalesce("total", F.lit(0)).alias("cases"), F.coalesce("judgments", F.create_map().cast("map<string,bigint>")).alias("judgments"))
    return met.select(*header.columns, summary.alias("summary"), F.coalesce("cases", empty).alias("cases"))


def report_headers(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """A row for each report, a file or (by default) a line of a file: its file's name, kind, size and time, the header
    fields, case_count, judgments, authority and parse_error. A report that can't be parsed has parse_error and no
    other field of its own; parts of another type than expected are null alone. Without started_at the file's time
    counts, without report_file_name the stem of the report's path."""
    text = spark.read.option("wholetext", whole_files).option("recursiveFileLookup", True).text(path)
    parsed = F.from_json("value", _BODY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_wrong"})
    name, meta = F.col("_metadata.file_name"), lambda c: F.col(f"_metadata.{c}")
    rows = text.filter(F.trim("value") != "").select(name.alias("name"), report_kind(name).alias("kind"), meta("file_size").alias("size_bytes"), meta("file_modification_time").alias("modified_at"), parsed.alias("r"))
    broken = F.col("r._wrong").isNotNull() | F.col("r").isNull()
    own = lambda c: F.when(~broken, c)
    fields = [f.split()[0] for f in HEADER.split(", ")]
    stem = F.regexp_extract(F.col("r.report"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    out = {f: own(F.col(f"r.{f}")) for f in fields}
    out["started_at"] = own(F.coalesce("r.started_at", F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss")))
    out["report_file_name"] = own(F.coalesce("r.report_file_name", F.when(stem != "", stem)))
    return rows.select(
        "name", "kind", "size_bytes", "modified_at", own(F.col("r.run_id")).alias("run_id"), *[c.alias(f) for f, c in out.items()], own(F.size("r.cases")).alias("case_count"),
        own(F.col("r.summary.judgments")).alias("judgments"), own(F.col("r.summary.authority")).alias("authority"), F.when(broken, F.concat(F.lit("not a JSON document: "), F.substring(F.coalesce("r._wrong", F.lit("")), 1, 80))).alias("parse_error"),
    )

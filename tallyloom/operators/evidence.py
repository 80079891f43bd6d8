"""Evidence units: continued tables, references to tables, chunk quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags that call for review, and those that keep a chunk out of the index (fixed values).
MAJOR = ("missing_standard_no", "missing_content_type", "missing_source_trace", "missing_source_block", "missing_bbox", "old_metadata_keys", "latex_residue", "table_missing_no", "table_missing_title", "image_missing_caption")
BLOCKING = ("missing_standard_no", "missing_content_type", "missing_source_trace", "missing_source_block", "missing_bbox", "old_metadata_keys", "latex_residue", "not_approved")


def grouped_tables(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, members (ids in page order) and text, the members' texts in that order with empty lines between.
    ``keys`` name one table of one file, whose parts are few; a row holds them together."""
    parts = F.array_sort(F.collect_list(F.struct("page", "id", "text")))
    g = chunks.groupBy(*keys).agg(parts.alias("m"))
    return g.select(*keys, F.transform("m", lambda x: x["id"]).alias("members"), F.array_join(F.transform("m", lambda x: x["text"]), "\n\n").alias("text"))


def referenced_tables(candidates: DataFrame, tables: DataFrame, most: int = 5) -> DataFrame:
    """query_id, id, place: tables that a query's candidates (query_id, id, rank, file, refs) refer to, that
    are not candidates themselves, the first ``most`` in candidate order. ``tables``: id, file, table_no."""
    asked = candidates.select("query_id", "rank", "file", F.posexplode("refs").alias("pos", "table_no"))
    met = asked.join(tables.select("file", "table_no", "id"), ["file", "table_no"]).join(candidates.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = met.groupBy("query_id", "id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id")).cast("long")
    return first.withColumn("place", place).filter(F.col("place") <= most).drop("at")


def quality_tags(rules: dict[str, Column]) -> Column:
    """Tags of the rules that hold, in their order."""
    return F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in rules.items()]), lambda t: t.isNotNull())


def needs_review(tags: Column) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, MAJOR)))


def indexable(tags: Column) -> Column:
    return ~F.arrays_overlap(tags, F.array(*map(F.lit, BLOCKING)))


def quality_rollup(audits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, indexable, needs_review and issues, how many tags there are."""
    return audits.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(indexable(F.col("tags"))).alias("indexable"), F.count_if(needs_review(F.col("tags"))).alias("needs_review"), F.sum(F.size("tags")).alias("issues"))


def issue_counts(audits: DataFrame) -> DataFrame:
    return audits.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))

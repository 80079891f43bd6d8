"""The corpus pipeline over ``documents``: quality, repeated lines, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return
the columns of ``documents``; the last returns the packed pieces. Between stages the documents are written as
Parquet and read again. Columns beside those of ``documents`` are left out, whatever their names, and an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import jaccard, line_dedup, mixing, packing, quality
from tallyloom.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry classifier passes; it learns from the labelled ones among them. Null
    and empty texts are scored as empty, rows with null or repeated ids stay rows of their own."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have; one with no line left stays, empty."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more in shingles of five words: the one of
    the smallest id. Null ids come last; empty texts stay; rows of one id and text are one document."""
    return jaccard.one_of_each(docs.select(*COLUMNS), width=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none to three times. Texts without words are never
    taken; null sources are one source; repeated rows are taken together."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and place; a null text is the end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mix_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenizers, a fitted model and set joins are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

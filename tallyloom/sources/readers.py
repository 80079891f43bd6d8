"""Readers and writers of reports, diagnostics and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Each Parquet table as a view of its name."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def reports(spark: SparkSession, path: str, schema: str = "scope string, audit_mode string, report_file_name string, assistant_id string, knowledge_base_id string, started_at string, finished_at string, cases array<struct<case_id:string,status:string>>") -> DataFrame:
    """JSON reports, one a file; those that can't be read or have no list of cases are left out, and so are
    checkpoints. ``file`` is a report's file name."""
    raw = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(path)
    named = raw.withColumn("file", F.col("_metadata.file_name"))
    return named.filter(F.col("_corrupt").isNull() & F.col("cases").isNotNull() & ~F.col("file").endswith(".checkpoint.json")).drop("_corrupt")


def newest_first(df: DataFrame) -> DataFrame:
    """By start, else end, newest first; then by file."""
    return df.orderBy(F.coalesce("started_at", "finished_at").desc_nulls_last(), "file")


def first_found(key: str, base: DataFrame, lookups: list[tuple[DataFrame, str]], value: str) -> DataFrame:
    """``base`` with ``value`` from the first of the lookups (table, column of base) that has it."""
    found = []
    for i, (table, column) in enumerate(lookups):
        found.append(f"_v{i}")
        base = base.join(table.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(column) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return base.withColumn(value, F.coalesce(*found)).drop(*found)


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """case_id, group_id, route, rank: the least rank by route of a CSV whose source_ranks column is a JSON
    map."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    ranks = F.from_json("source_ranks", "map<string,int>")
    return rows.select("case_id", "group_id", F.explode(ranks).alias("route", "rank")).groupBy("case_id", "group_id", "route").agg(F.min("rank").alias("rank"))


def write_diagnostics(df: DataFrame, path: str) -> None:
    """CSV with a header; the rows of a report fit one file only if they are few, so the parts stay parts."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def prices(spark: SparkSession, json_text: str) -> DataFrame:
    """key and decimal rates from a registry, a JSON list of objects with aliases."""
    one = spark.createDataFrame([(json_text,)], ["j"])
    item = F.explode(F.from_json("j", "array<struct<provider:string,model:string,aliases:array<string>,input:string,output:string,cache_read:string,cache_write:string>>")).alias("p")
    named = one.select(item).select("p.*").withColumn("key", F.explode(F.array_distinct(F.concat(F.array(F.concat_ws("/", "provider", "model")), F.coalesce("aliases", F.array().cast("array<string>"))))))
    rate = lambda c: F.col(c).cast("decimal(18,6)").alias(f"rate_{c}")
    return named.select(F.lower("key").alias("key"), *map(rate, ("input", "cache_read", "cache_write", "output")))


def floats(blob: Column) -> Column:
    """Little-endian float32 values of a binary column."""
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(blob) / 4) - 1, F.lit(0))), lambda i: F.reverse(F.substring(F.hex(blob), (i * 8 + 1).cast("int"), F.lit(8))))
    order = lambda h: F.concat(*[F.reverse(F.substring(h, p, 2)) for p in (1, 3, 5, 7)])

    def value(h: Column) -> Column:
        bits = F.conv(order(h), 16, 10).cast("long")
        sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
        exponent, mantissa = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND(0x7FFFFF)
        return F.when(exponent == 0, sign * mantissa * 2.0**-149).otherwise(sign * (1 + mantissa / 2.0**23) * F.pow(F.lit(2.0), exponent - 127))

    return F.when(F.length(blob) >= 4, F.transform(words, value)).otherwise(F.array().cast("array<double>"))

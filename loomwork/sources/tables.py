"""Reading tables, and the merges of keyed tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table below a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Schemas of the monitoring tables.
PAGES = (
    "page_id string, url string, title string, content string, version_hash string, last_modified string, last_checked string,"
    " last_ingested string, doc_embedding array<float>, status string, duplicate_of string"
)
CHUNKS = (
    "chunk_id string, page_id string, chunk_text string, chunk_embedding array<float>, chunk_index int, section_heading string"
)
EDGES = "source_page_id string, target_page_id string, edge_type string, weight double"
REGISTRY = (
    "source_id string, url string, title string, source_type string, importance string, check_frequency string, notes string, force_selenium string"
)
FEEDBACK = (
    "run_id string, page_id string, source_id string, category string, comment string, email_subject string, email_date string, ingested_at string"
)
REPORT = (
    "run_id string, ipfr_page_id string, verdict string, confidence double, reasoning string, suggested_changes array<string>, model string,"
    " prompt_tokens int, completion_tokens int, total_tokens int, processing_time_seconds double, retries int, schema_valid boolean, generated_at string"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The CSV of watched sources; an unreadable importance is 0.5."""
    rows = spark.read.schema(REGISTRY).csv(path, header=True)
    return rows.withColumn("importance", F.coalesce(F.expr("try_cast(importance as double)"), F.lit(0.5))).withColumn(
        "force_selenium", F.lower(F.trim("force_selenium")).isin("true", "1", "yes")
    )


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of feedback; malformed lines are skipped."""
    return spark.read.schema(FEEDBACK).json(path, mode="DROPMALFORMED")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON reports, one to a file, with the file's name."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with their names."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def vectors(blob: Column) -> Column:
    """A little-endian float32 blob as an array; empty or null means no vector."""
    @F.pandas_udf("array<float>")
    def decode(values: pd.Series) -> pd.Series:
        import numpy as np

        return values.map(lambda v: None if not v else np.frombuffer(v, "<f4"))

    return decode(blob)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key is not in it."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``old``, and one row of ``new`` for each key that it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys))


def upsert_edges(*edges: DataFrame) -> DataFrame:
    """The largest weight of each (source, target, type)."""
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    return every.groupBy("source", "target", "edge_type").agg(F.max("weight").alias("weight"))


def backfill(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` with keys that ``old`` lacks, the first of each key in ``order``."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    return fresh.withColumn("rn", first).where("rn = 1").drop("rn")


def pending(queue: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Deferred rows that are still to do: not processed, and not older than ``days`` (unreadable dates stay)."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.expr("try_cast(created as timestamp)"))) / 86400
    return queue.where(~F.col("processed") & F.coalesce(age <= days, F.lit(True)))


def left_changes(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """What became of each key: new, updated (a later stamp), deleted or same."""
    a, b = old.select(key, F.col(stamp).alias("was")), new.select(key, F.col(stamp).alias("now"))
    kind = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") > F.col("was"), "updated")
    ).otherwise("same")
    return a.join(b, key, "full").withColumn("change", kind)

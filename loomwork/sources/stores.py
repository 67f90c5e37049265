"""Keyed replacement and appends of stored tables, laid out so that a job rewrites only what it changes.

A table is a folder of Parquet files partitioned by a column of its own: ``part``,
a hash of its key, for tables that are replaced by key; the run for logs. Jobs
overwrite whole partitions (dynamic partition overwrite, so a job that fails
leaves the old ones), and a job that runs again writes the same partitions again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def part_of(key: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def overwrite(rows: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that ``rows`` has and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def create(rows: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """A new table laid out by its key."""
    overwrite(rows.withColumn("part", part_of(F.col(key), parts)), path, "part")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def replace(spark: SparkSession, path: str, pages: DataFrame, rows: DataFrame, key: str, unique: list[str] | None = None, parts: int = PARTS) -> None:
    """Puts ``rows`` in the place of all rows whose key is in ``pages``; a key without new rows is left without any.

    Only partitions of those keys are read and written. With ``unique``, one row of
    each (insert or ignore) is kept. Doing it again changes nothing.
    """
    keys = pages.select(key).distinct()
    touched = sorted(r.part for r in keys.select(part_of(F.col(key), parts).alias("part")).distinct().collect())  # at most ``parts`` numbers
    if not touched:
        return
    fresh = rows.join(keys, key, "left_semi")
    fresh = fresh.dropDuplicates(unique) if unique else fresh
    fresh = fresh.withColumn("part", part_of(F.col(key), parts))
    old = spark.read.parquet(path).where(F.col("part").isin(touched)).join(keys, key, "left_anti") if exists(spark, path) else fresh.where("false")
    out = old.unionByName(fresh).checkpoint()  # read before its files are replaced
    left = {r.part for r in out.select("part").distinct().collect()}
    if left:
        overwrite(out, path, "part")
    for p in set(touched) - left:
        drop(spark, f"{path}/part={p}")


def append_run(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """Adds the rows of a run to a log; a run that is repeated after a failure takes the place of its own rows."""
    overwrite(rows, path, run)


def clear_edges(spark: SparkSession, path: str, edge_type: str | None = None) -> None:
    """Removes the edges of a type, or all, from a table that is partitioned by edge_type."""
    drop(spark, path if edge_type is None else f"{path}/edge_type={edge_type}")


def set_status(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Pages with new status and duplicate_of where ``changes`` (page_id, status, duplicate_of) has them; the others stay."""
    new = changes.select("page_id", F.col("status").alias("_s"), F.col("duplicate_of").alias("_d"), F.lit(True).alias("_new"))
    take = lambda own, other: F.when(F.col("_new"), F.col(other)).otherwise(F.col(own)).alias(own)
    rows = pages.join(new, "page_id", "left")
    return rows.select(*[take(c, {"status": "_s", "duplicate_of": "_d"}[c]) if c in ("status", "duplicate_of") else F.col(c) for c in pages.columns])


def reset_duplicates(pages: DataFrame) -> DataFrame:
    """Duplicates are active pages again, so that they can be judged anew."""
    was = F.col("status") == "duplicate"
    again = {"status": F.when(was, "active").otherwise(F.col("status")), "duplicate_of": F.when(was, F.lit(None).cast("string")).otherwise(F.col("duplicate_of"))}
    return pages.select(*[again[c].alias(c) if c in again else F.col(c) for c in pages.columns])

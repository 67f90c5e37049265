"""Tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key that is on more than 1 of so many rows is joined by broadcast: fewer than so many keys can be.
SPREAD = 20_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where none is set and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if path is None:
        known = context._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if path is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "loomwork-shared")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def join_spread(rows: DataFrame, totals: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``totals``, one row for each key with the number of its rows in ``count``.

    Keys that a large part of the rows share would each be one task. Fewer than
    ``SPREAD`` keys can be on more than 1 of ``SPREAD`` rows, so those are
    broadcast; the others are small and shuffled.
    """
    least = (totals.agg(F.sum(count).alias("n")).first().n or 0) / SPREAD
    often, seldom = totals.where(F.col(count) > least), totals.where(F.col(count) <= least)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti")
    return rows.join(F.broadcast(often), key).unionByName(rest.join(seldom, key))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with their place from 0 on in an order over all of them; no task has more than its range.

    Ranges are sorted and checkpointed, where a row keeps its part and its place in
    it; what is put before each part is a sum over one row a part.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    own = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return own.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))

"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: blank and \x09-\x0D.
WHITE = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table below a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null texts as empty ones, whatever else ``docs`` has."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts of (doc_id, text)."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, white: str = WHITE) -> Column:
    """The words between white space, in order; none for an empty text."""
    return F.filter(F.split(text, white), lambda w: w != "")


def windows(tokens: Column, size: int, make) -> Column:
    """``make(slice, start)`` for each run of ``size`` tokens; starts count from 0."""
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(0), F.size(tokens) - size)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: make(F.slice(tokens, i + 1, size), i))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where none is set and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if path is None:
        path = context._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if path is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "loomwork-checkpoints")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that one of our jobs wrote, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def worker_cache(key, make):
    """What ``make`` gives, kept for later tasks of the same Python worker."""
    cache = sys.__dict__.setdefault("_loomwork_cache", {})
    if key not in cache:
        cache[key] = make()
    return cache[key]


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, with what its task has freed given back to the system at the end: workers are kept for later tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped

"""Operator 11, importance resampling towards a target: documents are drawn by how much they look like it.

Features are all runs of 1 to ``LONGEST`` words, hashed into ``BUCKETS`` buckets.
A bucket's gain is the logarithm of its share among the target's features over
its share among all documents'. The weight of a document is the sum of the gains
of its features, and Gumbel noise from its id turns the highest scores into a
sample without replacement.

Higher-order functions make each document's array of buckets, which is written
once to the shared folder (2 bytes a feature), since both passes need it. To count,
each task adds up its arrays, so it sends at most ``BUCKETS`` rows, whatever the
documents hold. To score, the gains, one literal array of ``BUCKETS`` numbers, are
looked up with ``element_at`` while the array is folded; nothing is exploded and no
text or array is shuffled. Scores are written once as small rows. Who is drawn needs an order over all documents: rows that surely are
not among the highest (by a quantile with a bound on its error) keep no rank, the
others are dealt to ranges of the order and counted by range.

Defined results: null or blank text has no features, weight 0, and is not drawn
where ``least_words`` is above 0. Null ids are hashed as an empty id and come last
in ties. Every input row gives one output row, repeated rows included; other
columns are ignored. An empty table gives an empty result, an empty target gains
that only follow the documents' counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint_dir, cut, releasing, remove, texts

BUCKETS, LONGEST = 10_000, 3
#: What separates words: all of ASCII that is no digit and no lower-case letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Parts of 100 that are drawn, from documents of so many words at least; seed of the noise.
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Relative error of the quantile below which nothing is drawn.
SLACK = 0.005


def bucket(text: Column) -> Column:
    return (F.crc32(text.cast("binary")) % BUCKETS).cast("int")


def bucketed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, buckets) of (doc_id, text): the bucket of each feature, repeats kept."""
    text = F.col("text")
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))  # the quick way for ASCII
    rows = docs.select("doc_id", F.array_remove(F.split(lower, BETWEEN), "").alias("w")).select("doc_id", "w", F.size("w").alias("n_words"))

    def runs(size: int) -> Column:
        if size == 1:
            return F.transform("w", bucket)
        first = F.slice("w", 1, F.greatest(F.col("n_words") - (size - 1), F.lit(0)))
        return F.transform(first, lambda x, i: bucket(F.concat(x, *[p for k in range(1, size) for p in (F.lit(" "), F.get("w", i + k))])))

    return rows.select("doc_id", "n_words", F.concat(*[runs(k) for k in range(1, LONGEST + 1)]).alias("buckets"))


def counted(rows: DataFrame, name: str) -> DataFrame:
    """(b, count) of the buckets of all rows; each task adds up its own before anything is shuffled."""

    @releasing
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["b", "n"])

    return rows.select("buckets").mapInArrow(add, "b int, n long").groupBy("b").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame) -> list[int]:
    """The gain of each bucket in thousandths, from all features of two frames of ``bucketed``; a row a bucket comes to the driver."""
    counts = counted(docs, "s").join(counted(target, "t"), "b", "full")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0, ["s", "t"])
    total = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c, more: (F.col(c) + more).cast("double")
    share = d("t", 1) * d("all_s", BUCKETS) / (d("s", 1) * d("all_t", BUCKETS))
    found = every.crossJoin(F.broadcast(total)).select("b", F.floor(1000 * F.log(share)).alias("gain"))  # one row of totals
    return [r.gain for r in sorted(found.collect())]


def scored(rows: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of the rows of ``bucketed``."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(literal, b + 1))
    rows = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, unneeded: str | None = None) -> DataFrame:
    """Adds rank to the rows of ``scored``: 1 for the highest score, null for those that are not drawn.

    The rows are checkpointed first; the folder ``unneeded`` goes then.
    """
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    if unneeded:
        remove(rows.sparkSession, unneeded)
    able = F.col("n_words") >= least_words
    chosen = rows.where(able)
    n = chosen.count()
    k = percent * n // 100
    none = F.lit(None).cast("long")
    if not k:
        return rows.withColumn("rank", none).drop("row")
    # At least k rows have this score or more: the quantile's place is off by SLACK of the rows at most.
    low = chosen.approxQuantile("score", [max(0.0, 1 - k / n - 2 * SLACK)], SLACK)[0]
    if chosen.where(F.col("score") >= low).count() < k:
        low = float("-inf")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    high = cut(chosen.where(F.col("score") >= low).repartitionByRange(*order).sortWithinPartitions(*order))
    # In a checkpoint a row keeps its partition and place, which this id is made of.
    placed = high.withColumn("at", F.monotonically_increasing_id())
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).count()  # a row for each partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    numbered = placed.withColumn("part", part).withColumn("place", place).join(F.broadcast(before), "part")
    rank = F.col("before") + F.col("place") + 1
    drawn = numbered.withColumn("rank", F.when(rank <= k, rank)).select(*rows.columns, "rank")
    rest = rows.where(~able | (F.col("score") < low)).withColumn("rank", none)
    return drawn.unionByName(rest).drop("row")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The documents drawn towards the texts of ``target``, whole rows of ``docs`` with their rank, best first by rank."""
    picked = _drawn(docs, target, percent, least_words, seed).where("rank is not null")
    return docs.join(picked.select("doc_id", "rank"), "doc_id")


def _drawn(docs: DataFrame, target: DataFrame, percent: int, least_words: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/buckets-{uuid.uuid4().hex}"
    bucketed(texts(docs)).withColumn("buckets", F.col("buckets").cast("array<smallint>")).write.parquet(path)
    own = spark.read.parquet(path)
    other = bucketed(texts(target.select("text", F.lit(0).cast("long").alias("doc_id"))))
    scores = scored(own, gains(own, other), seed)
    return ranked(scores, percent, least_words, path)


def query(docs: DataFrame, target: DataFrame) -> DataFrame:
    return _drawn(docs, target, PERCENT, LEAST_WORDS, SEED).select("doc_id", "n_features", "weight", "score", "rank")

"""Upkeep of a corpus: boilerplate, exact duplicates, frequent phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import join_spread

#: Frequent lines that are written into a plan.
FEW = 10_000


def cutoff(df: DataFrame, share: float) -> int:
    """At least 2, else the truncated share of the rows."""
    return max(2, int(share * df.count()))


def lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def frequent_lines(docs: DataFrame, id_col: str, text_col: str, share: float, shortest: int = 3) -> DataFrame:
    """(line, n): lines that stand in many documents; a line counts once for each."""
    least = cutoff(docs, share)
    rows = docs.select(id_col, F.explode(F.array_distinct(lines(F.coalesce(F.col(text_col), F.lit(""))))).alias("line"))
    return rows.where(F.length("line") >= shortest).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def strip_lines(docs: DataFrame, frequent: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, removed): texts without the frequent lines, and how many characters went.

    Lines that stand on a share of all documents are few: no more than the lines of
    an average document over that share. Up to ``FEW`` of them are a list in the
    plan and no row travels; a longer list is joined.
    """
    bad = [r.line for r in frequent.select("line").limit(FEW + 1).collect()]
    if len(bad) <= FEW:
        raw = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
        is_bad = lambda x: F.trim(x).isin(bad) if bad else F.lit(False)
        gone = F.aggregate(F.filter(raw, is_bad), F.lit(0).cast("long"), lambda n, x: n + F.length(x))
        return docs.select(id_col, F.array_join(F.filter(raw, lambda x: ~is_bad(x)), "\n").alias("text"), gone.alias("removed"))
    rows = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("i", "raw"))
    marked = rows.withColumn("line", F.trim("raw")).join(frequent.select("line", F.lit(True).alias("bad")), "line", "left")
    kept = F.sort_array(F.collect_list(F.when(F.col("bad").isNull(), F.struct("i", "raw"))))
    out = marked.groupBy(id_col).agg(kept.alias("k"), F.sum(F.when(F.col("bad"), F.length("raw")).otherwise(0)).alias("removed"))
    return out.select(id_col, F.array_join(F.transform("k", lambda x: x["raw"]), "\n").alias("text"), "removed")


def exact_duplicates(docs: DataFrame, id_col: str, text_col: str, age: Column) -> DataFrame:
    """(id, duplicate_of): the earliest of each text is the original; missing ages come last, then the smaller id.

    A text that many documents share is one row of the originals, sent to all tasks.
    """
    key = F.struct(F.coalesce(F.nullif(age, F.lit("")), F.lit("9999-99-99")).alias("age"), F.col(id_col).alias("id"))
    hashed = docs.select(F.col(id_col), F.sha2(F.col(text_col), 256).alias("hash"), key.alias("key")).where("hash is not null")
    first = hashed.groupBy("hash").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = join_spread(hashed, first, "hash", "n")
    return found.where(F.col(id_col) != F.col("first.id")).select(id_col, F.col("first.id").alias("duplicate_of"))


def sweep_frequent(phrases: DataFrame, page: str, phrase: str, share: float, least_pages: int = 5) -> DataFrame:
    """The rows whose phrase does not stand on too many pages; all rows if there are few pages."""
    pages = phrases.select(page).distinct()
    n = pages.count()
    if n < least_pages:
        return phrases
    common = phrases.groupBy(phrase).agg(F.count_distinct(page).alias("df")).where(F.col("df") >= max(2, int(share * n)))
    return phrases.join(common.select(phrase), phrase, "left_anti").select(*phrases.columns)


def best_matches(new: DataFrame, old: DataFrame, least: float = 0.5) -> DataFrame:
    """(new_id, old_id, score): for each new set the most similar old one. Inputs: (id, items array)."""
    a = new.select(F.col("id").alias("new_id"), F.size("items").alias("na"), F.explode("items").alias("x"))
    b = old.select(F.col("id").alias("old_id"), F.size("items").alias("nb"), F.explode("items").alias("x"))
    both = a.join(b, "x").groupBy("new_id", "old_id", "na", "nb").agg(F.count("*").alias("c"))
    scored = both.withColumn("score", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("score"), "old_id"))
    return scored.withColumn("rn", rank).where("rn = 1").select("new_id", "old_id", "score")

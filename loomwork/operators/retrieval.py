"""Ranking documents for a text: BM25, rank fusion and the choice of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import group_scores

K1, B, EPSILON = 1.5, 0.75, 0.25


def words_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t): the words of each document; one without words has the one word ``__empty__``."""
    t = tokens(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(id_col, F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("__empty__"))).alias("t"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score) for every query and document, 0 without a common term.

    ``queries`` is (query_id, term, n), as query_terms gives it. Okapi weights;
    terms of negative weight get a share of the mean weight. The text is read
    twice: once for the statistics of all terms, which combine in the map tasks,
    and once for the terms asked for, the only ones that are grouped by document.
    Only scores above 0 are shuffled; a document carries them as a map, and the
    query ids are laid beside the documents last.
    """
    texts = words_of(docs, id_col, text_col)
    n = docs.count()
    if not n:
        return docs.sparkSession.createDataFrame([], f"query_id long, {id_col} long, score double")
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # A null term carries the lengths through the same grouping.
    once = F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("term"), F.lit(0).alias("dl")))
    length = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("t").alias("dl")))
    terms = texts.select(F.inline(F.concat(once, length))).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl"))
    mean, total = terms.agg(F.avg(F.when(F.col("term").isNotNull(), raw)), F.sum("dl")).first()
    wanted = queries.select("term").distinct()
    asked = texts.select(id_col, F.size("t").alias("dl"), F.explode_outer("t").alias("term")).join(wanted, "term")
    index = asked.groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.when(raw < 0, EPSILON * mean).otherwise(raw)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (total / n)))
    weights = queries.join(df, "term").select("query_id", "term", "n", idf.alias("idf"))
    found = index.join(weights, "term").groupBy(id_col, "query_id").agg(F.sum(part * F.col("n")).alias("score"))
    by_doc = found.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("scores"))
    ids = queries.select("query_id").distinct()
    scored = docs.select(id_col).join(by_doc, id_col, "left").crossJoin(ids)
    return scored.select("query_id", id_col, F.coalesce(F.try_element_at("scores", F.col("query_id")), F.lit(0.0)).alias("score"))


def query_terms(texts: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, n: how often it is asked for); a text without words has one null term."""
    words = texts.select(F.col(id_col).cast("long").alias("query_id"), F.explode_outer(tokens(F.col(text_col))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("n"))


def competition_rank(scored: DataFrame, score: str, out: str, by: str | None = None) -> DataFrame:
    """Adds ``out``: 1, 1, 3 ... with the largest score first, within ``by`` if given.

    Equal scores are counted before they are ordered, so the window holds one row for each different score.
    """
    key = [by] if by else []
    counts = scored.groupBy(*key, score).agg(F.count("*").alias("_n"))
    larger = F.sum("_n").over(Window.partitionBy(*key).orderBy(F.desc(score)))
    ranks = counts.select(*[F.col(c).alias(f"_{c}") for c in (*key, score)], (larger - F.col("_n") + 1).cast("int").alias(out))
    same = [scored[c].eqNullSafe(ranks[f"_{c}"]) for c in (*key, score)]
    return scored.join(ranks, same).drop(*[f"_{c}" for c in (*key, score)])


def fused(scored: DataFrame, first: str, second: str, k: int = 60, weights=(1.0, 2.0), by: str | None = None) -> DataFrame:
    """Adds ``rrf``: both scores' ranks (within ``by``) fused by weighted reciprocals."""
    ranked = competition_rank(competition_rank(scored, first, "r1", by), second, "r2", by)
    return ranked.withColumn("rrf", weights[0] / (k + F.col("r1")) + weights[1] / (k + F.col("r2")))


def with_importance(score: Column, importance: Column, floor: float = 0.5) -> Column:
    return score * (floor + (1 - floor) * importance)


def candidates(
    scored: DataFrame, score: str, id_col: str, top_n: int, threshold: float, fast_pass: bool = False, by: str | None = None
) -> DataFrame:
    """The best ``top_n`` rows (within ``by``) and all at or above the threshold; all rows on a fast pass."""
    if fast_pass:
        return scored
    high = F.coalesce(F.col(score) >= threshold, F.lit(False))
    return scored.where(high).unionByName(best(scored, score, id_col, top_n, by).where(~high))


def best(scored: DataFrame, score: str, id_col: str, top_n: int, by: str | None = None) -> DataFrame:
    """The ``top_n`` rows of the largest scores (within ``by``); the smaller id wins a tie."""
    if by is None:
        return scored.orderBy(F.desc(score), F.col(id_col)).limit(top_n)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), id_col))
    return scored.withColumn("_place", place).where(F.col("_place") <= top_n).drop("_place")


def min_max(df: DataFrame, value: str, out: str, by: str | None = None) -> DataFrame:
    """Adds ``out``: the value from 0 to 1 (within ``by``), 0 if all values are equal."""
    key = [by] if by else []
    ends = df.groupBy(*key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    both = df.join(ends, by) if by else df.crossJoin(ends)
    scale = F.when(F.col("_low") == F.col("_high"), 0.0).otherwise((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return both.withColumn(out, scale).drop("_low", "_high")


def reranked(scored: DataFrame, logit: str, first: str, by: str | None = None, weights=(0.80, 0.20)) -> DataFrame:
    """Adds ``rerank``: the second model's sigmoid (0.5 without an answer) blended with the first score from 0 to 1."""
    pair = F.coalesce(1 / (1 + F.exp(-F.col(logit))), F.lit(0.5))
    scaled = min_max(scored, first, "_scaled", by)
    return scaled.withColumn("rerank", weights[0] * pair + weights[1] * F.coalesce("_scaled", F.lit(0.0))).drop("_scaled")


# A page is confirmed by one chunk this close, or by so many chunks that are fairly close.
HIGH, LOW, CHUNKS = 0.75, 0.45, 3


def page_decisions(changes: DataFrame, chunks: DataFrame, high: float = HIGH, low: float = LOW, least: int = CHUNKS, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, group, best, above, top, decision) of each change and page: ``single_chunk_high``, ``multi_chunk_medium`` or null.

    changes: query_id, q (a vector for each chunk of the change); chunks: id, group
    (the page), v. With ``candidates`` (group) only their chunks are compared.
    """
    own = chunks if candidates is None else chunks.join(candidates.select("group").distinct(), "group", "left_semi")
    rows = group_scores(changes, own, low)
    decision = F.when(F.col("best") >= high, "single_chunk_high").when(F.col("above") >= least, "multi_chunk_medium")
    return rows.withColumn("decision", decision)

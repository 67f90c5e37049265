"""Similarity graphs: edges, propagation along them, and greedy near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import most_similar
from ..sources.shared import cut


def embedding_edges(df: DataFrame, id_col: str, vector: str, top_k: int = 5, least: float = 0.40, weight: float = 1.0) -> DataFrame:
    """Directed edges from each row to its most similar rows; ties go to the smaller id."""
    best = most_similar(df, id_col, vector, top_k, least)
    return best.select("source", "target", (F.col("sim") * weight).alias("weight"))


def jaccard_edges(members: DataFrame, id_col: str, item: str, least: float = 0.30, weight: float = 0.8) -> DataFrame:
    """Edges in both directions between ids whose sets of items are similar, by equi-join on the items."""
    sets = members.select(F.col(id_col).alias("id"), F.col(item).alias("item")).distinct()
    sizes = sets.groupBy("id").agg(F.count("*").alias("n"))
    both = (
        sets.select(F.col("id").alias("source"), "item")
        .join(sets.select(F.col("id").alias("target"), "item"), "item")
        .where("source != target")
        .groupBy("source", "target")
        .agg(F.count("*").alias("common"))
    )
    n = lambda side, name: sizes.select(F.col("id").alias(side), F.col("n").alias(name))
    scored = both.join(n("source", "ns"), "source").join(n("target", "nt"), "target")
    score = F.col("common") / (F.col("ns") + F.col("nt") - F.col("common"))
    return scored.withColumn("j", score).where(F.col("j") >= least).select("source", "target", (F.col("j") * weight).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, hops: int = 3, decay: float = 0.45, floor: float = 0.05) -> DataFrame:
    """(id, boost): scores passed along edges, split over out-degree; weak paths are dropped, paths may return."""
    degree = edges.groupBy("source").agg(F.count("*").alias("outdeg"))
    step = edges.join(degree, "source").select("source", "target", (F.col("weight") * decay / F.col("outdeg")).alias("f"))
    front = seeds.select("id", "score")
    out = None
    for _ in range(hops):
        front = (
            front.join(step, front["id"] == step["source"])
            .select(F.col("target").alias("id"), (F.col("score") * F.col("f")).alias("score"))
            .where(F.col("score") >= floor)
        )
        out = front if out is None else out.unionByName(front)
    return out.groupBy("id").agg(F.sum("score").alias("boost"))


def boosted(scored: DataFrame, boosts: DataFrame, least: float) -> DataFrame:
    """Scores with boosts added; ids that only have a boost stay if it is large enough."""
    both = scored.join(boosts, "id", "left").select("id", (F.col("score") + F.greatest(F.lit(0.0), F.coalesce("boost", F.lit(0.0)))).alias("final"))
    only = boosts.join(scored, "id", "left_anti").where(F.col("boost") >= least).select("id", F.col("boost").alias("final"))
    return both.unionByName(only)


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each end of which an id stands; a loop counts once."""
    e = edges.withColumn("eid", F.concat_ws("|", "source", "target"))
    ends = e.select(F.col("source").alias("id"), "eid").unionByName(e.select(F.col("target").alias("id"), "eid"))
    return ends.distinct().groupBy("id").agg(F.count("*").alias("degree"))


def groups(pairs: DataFrame) -> DataFrame:
    """(id, root): connected groups of the pairs (a, b), by the smallest id that can be reached."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "id").checkpoint()
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("root").alias("m"))
        new = cut(label.join(near, label["id"] == near["a"]).select("id", F.col("root").alias("old"), F.least("root", "m").alias("root")))
        if new.where("root < old").isEmpty():
            return new.select("id", "root")
        label = new.select("id", "root")


def greedy_duplicates(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(id, duplicate_of) by an ordered scan of the pairs: the longer text wins, a tie keeps the larger id.

    An item that is a duplicate when its turn comes is passed over with all its pairs.

    The scan as joins, so that no group is in one task. An item is passed over if a smaller id with a longer text that
    is not passed over itself is similar to it: decided in rounds, each for the items whose stronger neighbours are
    decided. Such an item is a duplicate of the first of these neighbours. Another item loses to the last of the larger
    ids that are at least as long and not taken by then. Chains then end by doubling; the winner always has the greater
    (length, id), so there are no rings.
    """
    size = lambda side, name: lengths.select(F.col("id").alias(side), F.col("length").alias(name))
    known = cut(pairs.select("a", "b").where("a < b").distinct().join(size("a", "la"), "a").join(size("b", "lb"), "b").select("a", "b", (F.col("la") > F.col("lb")).alias("down")))
    strong = known.where("down").select("a", "b")  # a may take b
    ids = known.select(F.col("a").alias("id")).union(known.select("b")).distinct()
    below = strong.select(F.col("b").alias("id")).distinct()
    passed, kept = None, cut(ids.join(below, "id", "left_anti"))
    left, fresh, edges = cut(below), kept, strong
    while not left.isEmpty():
        # Items next to one that was kept are passed over; an item whose stronger neighbours all are is kept.
        hit = cut(edges.join(fresh.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        passed = hit if passed is None else passed.unionByName(hit)
        left = cut(left.join(hit, "id", "left_anti"))
        # Edges into items that are decided, and from items that are passed over, say no more.
        edges = cut(edges.join(left.select(F.col("id").alias("b")), "b", "left_semi").join(hit.select(F.col("id").alias("a")), "a", "left_anti").select("a", "b"))
        fresh = cut(left.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
        left = cut(left.join(fresh, "id", "left_anti"))
        kept = kept.unionByName(fresh)
    kept = cut(kept)
    scanned = cut(known.join(kept.select(F.col("id").alias("a")), "a", "left_semi"))
    taken = cut(scanned.where("down").groupBy("b").agg(F.min("a").alias("into")))
    lost = scanned.where("not down").join(taken, "b", "left").where("into is null or into > a").groupBy(F.col("a").alias("id")).agg(F.max("b").alias("into"))
    chain = cut(taken.select(F.col("b").alias("id"), "into").unionByName(lost))
    while True:
        onward = chain.select(F.col("id").alias("into"), F.col("into").alias("next"))
        longer = cut(chain.join(onward, "into", "left").select("id", F.coalesce("next", "into").alias("into"), F.col("next").isNotNull().alias("moved")))
        chain = longer.select("id", "into")
        if longer.where("moved").isEmpty():
            return chain.withColumnRenamed("into", "duplicate_of")

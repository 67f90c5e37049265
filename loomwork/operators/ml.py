"""Projection and clustering with fixed seeds, so that results repeat."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import numbered


def projected(df: DataFrame, id_col: str, vector: str, dims: int = 2) -> DataFrame:
    """(id, point): principal components, each axis scaled to -1..1; fewer than three rows are at zero.

    A component's sign is arbitrary; the axis is turned so that its mean is not below zero.
    """
    rows = df.where(F.size(vector) > 0).select(F.col(id_col), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    if rows.limit(3).count() < 3:
        return rows.select(id_col, F.array(*[F.lit(0.0)] * dims).alias("point"))
    out = PCA(k=dims, inputCol="v", outputCol="p").fit(rows).transform(rows).select(id_col, vector_to_array("p").alias("p"))
    stats = out.agg(*[f(F.get("p", F.lit(i))).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max), ("mid", F.avg))]).first()
    axes = []
    for i in range(dims):
        lo, hi = stats[f"lo{i}"], stats[f"hi{i}"]
        sign = -1.0 if stats[f"mid{i}"] < (lo + hi) / 2 else 1.0
        axes.append(((F.get("p", F.lit(i)) - lo) / ((hi - lo) or 1.0) * 2 - 1) * sign)
    return out.select(id_col, F.array(*axes).alias("point"))


def clusters(points: DataFrame, id_col: str, point: str, k: int, rounds: int = 100) -> DataFrame:
    """(id, cluster): Lloyd's k-means from evenly spaced rows by id; ties go to the first centre, empty centres stay.

    Centres are k short arrays; only they leave the executors.
    """
    n = points.count()
    k = min(k, n)
    if not k:
        return points.select(id_col, F.lit(0).alias("cluster"))
    wanted = [i * n // k for i in range(k)]
    seeds = numbered(points, "_place", F.col(id_col)).where(F.col("_place").isin(wanted)).select("_place", point).collect()
    found = {r["_place"]: list(map(float, r[point])) for r in seeds}
    centres = [found[w] for w in wanted]
    for _ in range(rounds):
        labelled = assigned(points, point, centres)
        dims = len(centres[0])
        means = labelled.groupBy("cluster").agg(*[F.avg(F.get(point, F.lit(i))).alias(f"m{i}") for i in range(dims)]).collect()
        new = list(centres)
        for r in means:
            new[r.cluster] = [r[f"m{i}"] for i in range(dims)]
        if new == centres:
            break
        centres = new
    return assigned(points, point, centres).select(id_col, "cluster")


def assigned(points: DataFrame, point: str, centres: list[list[float]]) -> DataFrame:
    distance = lambda c: sum(((F.get(point, F.lit(i)) - x) * (F.get(point, F.lit(i)) - x) for i, x in enumerate(c)), F.lit(0.0))
    best = F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    return points.withColumn("cluster", best["i"])


def cluster_summary(labelled: DataFrame, point: str, dims: int) -> DataFrame:
    """Size and centre of each cluster."""
    return labelled.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(F.get(point, F.lit(i))).alias(f"c{i}") for i in range(dims)])

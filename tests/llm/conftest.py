import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"wort{i % 997} und{i % 31}" for i in range(30_000))
BASE = "The and attion to thanedble the anea eriner of thanea with in and on from this that are was not by"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, very long, tied and repeated texts, with columns whose names the operators use themselves."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, BASE), (6, BASE), (7, BASE + "."), (8, "a"),
        (9, "é ß ñ 漢字 😀 " * 5), (10, "x\x00y\x0bz"), (11, "12345 !!! ###"), (None, BASE), (12, "w" * 9000),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["z", "places", "copies", "bucket", "hash", "key", "id", "digest", "score", "h", "w", "base", "n", "root", "bands"]
    return frame.select(
        "*",
        F.when(F.col("doc_id") % 2 == 0, "en").alias("lang"),
        F.lit(None).cast("string").alias("source"),
        F.lit(1).cast("long").alias("n_chars"),
        *[F.lit("clash").alias(c) for c in clash],
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def sample(spark, sf_dir):
    """The documents of the smallest scale, as a frame and as Python values."""
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return frame, {r.doc_id: r.text or "" for r in frame.select("doc_id", "text").collect()}


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}

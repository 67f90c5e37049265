"""Health of runs and score statistics from the JSON that runs leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the health conditions.
MOST_ERRORS, STREAK, MALFORMED, TRUNCATED = 0.30, 3, 2, 3
# Names of the scores, where each comes from.
SCORES = ["stage4_final_score", "biencoder_max_chunk_score", "crossencoder_final_score"]
DETAILS = "struct<stages:struct<relevance:struct<top_candidates:array<struct<final_score:double>>>,llm_assessment:struct<failed:int>,crossencoder:struct<truncation_warnings:array<string>>>>"
TRIGGERED = "array<struct<biencoder_max_chunk_score:double,crossencoder_final_score:double>>"
STATE = "struct<previous_text:string,last_error:string,consecutive_failures:int>"


def details(col: str = "details") -> Column:
    """The typed parts of a row's details; what is no JSON has none."""
    return F.from_json(F.col(col), DETAILS)


def long_scores(runs: DataFrame) -> DataFrame:
    """(label, score): every score in details and triggered_pages, a row each; missing ones and bad JSON are left out."""
    candidates = F.transform(details()["stages"]["relevance"]["top_candidates"], lambda x: F.struct(F.lit(SCORES[0]).alias("label"), x["final_score"].alias("score")))
    pages = F.from_json("triggered_pages", TRIGGERED)
    own = lambda name: F.transform(pages, lambda x: F.struct(F.lit(name).alias("label"), x[name].alias("score")))
    none = F.array().cast("array<struct<label:string,score:double>>")
    every = F.concat(*[F.coalesce(a, none) for a in (candidates, own(SCORES[1]), own(SCORES[2]))])
    return runs.select(F.inline(every)).where("score is not null")


def score_buckets(runs: DataFrame) -> DataFrame:
    """(label, n, low, p25, median, p75, high) of each score, labels without one included; exact, with linear interpolation.

    Scores count to six places, so what a label gathers is a count for each of a
    bounded number of values and not all rows.
    """
    rounded = long_scores(runs).groupBy("label", F.round("score", 6).alias("score")).agg(F.count("*").alias("n"))
    five = F.percentile("score", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]), F.col("n"))
    found = rounded.groupBy("label").agg(F.sum("n").alias("n"), five.alias("p"))
    labels = runs.sparkSession.createDataFrame([(x,) for x in SCORES], "label string")
    names = ["low", "p25", "median", "p75", "high"]
    rows = labels.join(found, "label", "left")
    return rows.select("label", F.coalesce("n", F.lit(0)).alias("n"), *[F.get("p", F.lit(k)).alias(name) for k, name in enumerate(names)])


def streaks(runs: DataFrame) -> DataFrame:
    """(run_id, source_id, streak): errors of a source in a row, up to and with each run; 0 where the run was none."""
    by = Window.partitionBy("source_id").orderBy("ts", "event_id")
    failed = (F.col("outcome") == "error").cast("int")
    since = F.sum(1 - failed).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = runs.withColumn("failed", failed).withColumn("since", since)
    count = F.sum("failed").over(Window.partitionBy("source_id", "since").orderBy("ts", "event_id"))
    return rows.withColumn("streak", count).groupBy("run_id", "source_id").agg(F.max("streak").alias("streak"), F.max("failed").alias("failed"))


def without_baseline(states: DataFrame) -> DataFrame:
    """source_id of sources that were tried and failed and never had a text: ``states`` has source_id and the state as JSON."""
    state = F.from_json("state", STATE)
    rows = states.select("source_id", state.alias("s")).where("s is not null")
    none = F.coalesce(F.length("s.previous_text"), F.lit(0)) == 0
    tried = (F.coalesce(F.length("s.last_error"), F.lit(0)) > 0) | (F.coalesce("s.consecutive_failures", F.lit(0)) != 0)
    return rows.where(none & tried).select("source_id").distinct()


def conditions(runs: DataFrame, states: DataFrame) -> DataFrame:
    """Five conditions for each run: many errors, a source failing again and again, malformed replies, cut texts, sources without a baseline.

    runs: run_id, source_id, event_id, ts, outcome, details (JSON). What stands in
    details of several rows of a run is added up; bad JSON counts as nothing.
    """
    d = details()["stages"]
    own = runs.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.sum(F.coalesce(d["llm_assessment"]["failed"], F.lit(0))).alias("malformed"),
        F.sum(F.coalesce(F.when(d["crossencoder"]["truncation_warnings"].isNotNull(), F.size(d["crossencoder"]["truncation_warnings"])), F.lit(0))).alias("truncated"),
    )
    again = streaks(runs).where((F.col("failed") > 0) & (F.col("streak") >= STREAK)).groupBy("run_id").agg(F.count("*").alias("failing"))
    blind = runs.select("run_id", "source_id").distinct().join(without_baseline(states), "source_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("blind"))
    rows = own.join(again, "run_id", "left").join(blind, "run_id", "left").na.fill(0, ["failing", "blind"])
    return rows.select(
        "run_id",
        (F.col("errors") / F.col("total") > MOST_ERRORS).alias("error_rate"),
        (F.col("failing") > 0).alias("consecutive_failures"),
        (F.col("malformed") >= MALFORMED).alias("llm_malformed"),
        (F.col("truncated") >= TRUNCATED).alias("crossencoder_truncation"),
        (F.col("blind") > 0).alias("no_baseline"),
    )

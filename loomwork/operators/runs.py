"""Analytics over a log of monitoring runs.

A run log has one row for each source and run: run_id, source_id, ts,
stage_reached, outcome, duration, confidence, verdict, triggered (an array of
page ids). Every function takes and returns DataFrames; column names are the
log's own. Times are compared as they are; cutoffs are arguments, so results do
not depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Number of each named stage; anything else is 0.
STAGE_NUMBER = {
    "stage1": 1,
    "scrape": 1,
    "stage2": 2,
    "stage3": 3,
    "stage4": 4,
    "stage5": 5,
    "stage6": 6,
    "stage6_complete": 6,
}
# Days between checks, by frequency; an unknown frequency is weekly.
CHECK_DAYS = {"daily": 1, "weekly": 7, "fortnightly": 14, "monthly": 30, "quarterly": 91}


def stage_number(stage: Column) -> Column:
    pairs = [F.lit(x) for item in STAGE_NUMBER.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), stage), F.lit(0))


def errors(outcome: str = "outcome") -> Column:
    return F.count_if(F.col(outcome) == "error")


def error_rate(failed: Column, total: Column) -> Column:
    """Share of failures, 0 for no rows."""
    return F.coalesce(failed, F.lit(0)).cast("double") / F.greatest(total, F.lit(1))


def run_rollup(runs: DataFrame) -> DataFrame:
    """One row for each run: start, duration, sources, outcomes and a status."""
    out = runs.groupBy("run_id").agg(
        F.min("ts").alias("started"),
        F.sum("duration").alias("duration"),
        F.count("*").alias("sources"),
        F.count_if(F.col("outcome") == "completed").alias("completed"),
        F.count_if(F.col("outcome") == "no_change").alias("no_change"),
        errors().alias("errored"),
        F.count_if(F.col("verdict") == "CHANGE_REQUIRED").alias("alerts"),
    )
    status = F.when(F.col("errored") == F.col("sources"), "error").when(F.col("errored") > 0, "partial").otherwise("ok")
    return out.withColumn("status", status)


def overall(runs: DataFrame) -> DataFrame:
    """One row of totals over a window of runs."""
    return runs.agg(
        F.count_distinct("run_id").alias("runs"),
        F.count_distinct("source_id").alias("sources"),
        errors().alias("errored"),
        error_rate(errors(), F.count("*")).alias("error_rate"),
        F.max(F.struct("ts", "run_id"))["run_id"].alias("latest_run"),
        F.max(stage_number(F.col("stage_reached"))).alias("deepest_stage"),
    )


def verdict_counts(runs: DataFrame, verdicts: list[str]) -> DataFrame:
    """One row with a zero-filled count for each verdict."""
    return runs.agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in verdicts])


def verdicts_by_run(runs: DataFrame, verdicts: list[str]) -> DataFrame:
    """The same as a pivot: one row for each run."""
    counted = runs.groupBy("run_id").pivot("verdict", verdicts).count().na.fill(0)
    return counted.select("run_id", *[F.col(v).alias(v.lower()) for v in verdicts])


def stage_outcomes(runs: DataFrame, stages: int = 6) -> DataFrame:
    """Counts of outcomes for each stage from 1 on, zeros included."""
    spark = runs.sparkSession
    counted = runs.groupBy(stage_number(F.col("stage_reached")).alias("stage")).agg(
        F.count_if(F.col("outcome") == "completed").alias("completed"),
        F.count_if(F.col("outcome") == "no_change").alias("no_change"),
        errors().alias("errored"),
    )
    every = spark.range(1, stages + 1).select(F.col("id").cast("int").alias("stage"))
    return every.join(counted, "stage", "left").na.fill(0)


def source_statistics(runs: DataFrame, since=None) -> DataFrame:
    """Per source: checks, last check, last success, errors, alerts, average confidence."""
    rows = runs if since is None else runs.where(F.col("ts") >= since)
    return rows.groupBy("source_id").agg(
        F.count("*").alias("checks"),
        F.max("ts").alias("last_check"),
        F.max(F.when(F.col("outcome") == "completed", F.col("ts"))).alias("last_success"),
        errors().alias("errored"),
        F.count_if(F.col("verdict") == "CHANGE_REQUIRED").alias("alerts"),
    )


def reliability(runs: DataFrame) -> DataFrame:
    """Per source: checks, errors, success rate, and the day of the last error."""
    failed = F.col("outcome") == "error"
    return runs.groupBy("source_id").agg(
        F.count("*").alias("checks"),
        F.count_if(failed).alias("errored"),
        (1 - error_rate(F.count_if(failed), F.count("*"))).alias("success_rate"),
        F.max(F.when(failed, F.substring(F.col("ts").cast("string"), 1, 10))).alias("last_error"),
    )


def current_streak(runs: DataFrame) -> DataFrame:
    """Per source: kind and length of the newest unbroken series of successes or errors."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("ts"), F.desc("event_id"))
    kind = F.when(F.col("outcome") == "error", "error").otherwise("success")
    marked = runs.withColumn("kind", kind)
    marked = marked.withColumn("change", F.coalesce((F.lag("kind").over(newest) != F.col("kind")).cast("int"), F.lit(0)))
    island = F.sum("change").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("island", island)
        .where("island = 0")
        .groupBy("source_id", "kind")
        .agg(F.count("*").alias("length"))
    )


def consecutive_failures(runs: DataFrame, newest: int = 20) -> DataFrame:
    """Per source: errors in a row, newest first, among the newest rows."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("ts"), F.desc("event_id")))
    first_good = F.min(F.when(F.col("outcome") != "error", F.col("rn"))) - 1
    return (
        runs.withColumn("rn", rank)
        .where(F.col("rn") <= newest)
        .groupBy("source_id")
        .agg(F.coalesce(first_good, F.count("*")).cast("long").alias("failures"))
    )


def health_conditions(runs: DataFrame, max_error_rate: float = 0.30, streak: int = 3) -> DataFrame:
    """One row for each run: whether its error rate or its sources' failure streaks call for an alert."""
    rates = runs.groupBy("run_id").agg(error_rate(errors(), F.count("*")).alias("error_rate"))
    bad = consecutive_failures(runs).where(F.col("failures") >= streak)
    by_run = (
        runs.select("run_id", "source_id").distinct().join(bad, "source_id").groupBy("run_id").agg(F.count("*").alias("failing"))
    )
    return rates.join(by_run, "run_id", "left").select(
        "run_id",
        "error_rate",
        F.coalesce("failing", F.lit(0)).cast("long").alias("failing"),
        (F.col("error_rate") > max_error_rate).alias("rate_alert"),
        (F.coalesce("failing", F.lit(0)) > 0).alias("streak_alert"),
    )


def iso_week(ts: Column) -> Column:
    week = F.lpad(F.extract(F.lit("week"), ts).cast("string"), 2, "0")
    return F.concat(F.extract(F.lit("yearofweek"), ts).cast("string"), F.lit("-W"), week)


def sunday_week(ts: Column) -> Column:
    day = ts.cast("date")
    return F.date_sub(day, F.dayofweek(day) - 1)


def per_period(runs: DataFrame, period: Column, name: str) -> DataFrame:
    """Alerts and all rows for each period."""
    return runs.groupBy(period.alias(name)).agg(
        F.count_if(F.col("verdict") == "CHANGE_REQUIRED").alias("alerts"), F.count("*").alias("total")
    )


def funnel(runs: DataFrame, stages: int = 6) -> DataFrame:
    """How many rows reached each stage, and the share of the stage before."""
    reached = runs.select(stage_number(F.col("stage_reached")).alias("s")).where(F.col("s").between(1, stages))
    counts = reached.select(F.explode(F.sequence(F.lit(1), F.col("s"))).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))
    # A handful of rows, so one window over all of them is no bottleneck.
    before = F.lag("n").over(Window.orderBy("stage"))
    return counts.withColumn("pass_rate", F.col("n") / before)


def stage_table(runs: DataFrame, stages: int = 6) -> DataFrame:
    """For each stage: rows that passed it, were turned down or failed there, or never came."""
    rows = runs.select(stage_number(F.col("stage_reached")).alias("s"), "outcome")
    spread = rows.select("s", "outcome", F.explode(F.sequence(F.lit(1), F.lit(stages))).alias("stage"))
    at = F.col("s") == F.col("stage")
    good = F.col("outcome") == "completed"
    return spread.groupBy("stage").agg(
        F.count_if((F.col("s") > F.col("stage")) | (at & good)).alias("passed"),
        F.count_if(at & (F.col("outcome") == "no_change")).alias("rejected"),
        F.count_if(at & (F.col("outcome") == "error")).alias("errored"),
        F.count_if(F.col("s") < F.col("stage")).alias("skipped"),
    )


def calendar(runs: DataFrame) -> DataFrame:
    """Alerts and their sources for each day."""
    alerts = runs.where(F.col("verdict") == "CHANGE_REQUIRED")
    return alerts.groupBy(F.substring(F.col("ts").cast("string"), 1, 10).alias("day")).agg(
        F.count("*").alias("alerts"), F.count_distinct("source_id").alias("sources")
    )


def daily_error_rate(runs: DataFrame, last_day: str, days: int = 30) -> DataFrame:
    """Error rate of each day of a dense calendar; null where nothing was checked."""
    spark = runs.sparkSession
    end = F.to_date(F.lit(last_day))
    span = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    rolled = runs.groupBy(F.col("ts").cast("date").alias("day")).agg(errors().alias("errored"), F.count("*").alias("checked"))
    out = span.join(rolled, "day", "left")
    rate = F.try_divide(F.col("errored").cast("double"), F.col("checked").cast("double"))
    return out.select(F.col("day").cast("string").alias("day"), F.coalesce("checked", F.lit(0)).alias("checked"), rate.alias("rate"))


def threshold_sweep(scored: DataFrame, score: str, relevant: Column, steps: int = 20) -> DataFrame:
    """For thresholds 0, 1/steps .. 1: rows at or above, precision and relative recall.

    Scores are counted in steps first, so each row is read once whatever the
    number of thresholds.
    """
    spark = scored.sparkSession
    step = F.least(F.greatest(F.floor(F.round(F.col(score) * steps, 9)), F.lit(-1)), F.lit(steps)).cast("int")
    binned = scored.groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.count_if(relevant).alias("hits"))
    limits = spark.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    out = limits.join(binned, F.col("bin") >= F.col("k"), "left").groupBy("k").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("above"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")
    )
    first = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.select(
        (F.col("k") / steps).alias("threshold"),
        "above",
        "hits",
        F.when(F.col("above") >= 3, F.col("hits") / F.col("above")).alias("precision"),
        F.try_divide(F.col("hits").cast("double"), F.first("hits").over(first).cast("double")).alias("recall"),
    )


def due(registry: DataFrame, today: str) -> DataFrame:
    """Adds ``due``: whether a source must be checked on a day. Unknown dates are due."""
    pairs = [F.lit(x) for item in CHECK_DAYS.items() for x in item]
    wait = F.coalesce(F.element_at(F.create_map(*pairs), F.lower("check_frequency")), F.lit(7))
    age = F.datediff(F.to_date(F.lit(today)), F.expr("try_cast(last_checked as date)"))
    return registry.withColumn("due", F.coalesce(age >= wait, F.lit(True)))


def filtered(runs: DataFrame, first=None, last=None, outcome=None, sources=None, verdicts=None, min_stage=None) -> DataFrame:
    """The rows that meet all given conditions."""
    out = runs
    if first is not None:
        out = out.where(F.col("ts") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        out = out.where(F.col("ts") <= F.lit(last).cast("timestamp_ntz"))
    if outcome is not None:
        out = out.where(F.col("outcome") == outcome)
    if sources:
        out = out.where(F.col("source_id").isin(sources))
    if verdicts:
        out = out.where(F.col("verdict").isin(verdicts))
    if min_stage is not None:
        out = out.where(stage_number(F.col("stage_reached")) >= min_stage)
    return out


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of rows; ``order`` must end with a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_alerts(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Alerts of each page, by exact id in the runs' triggered pages; pages without any have 0."""
    hits = (
        runs.where(F.col("verdict") == "CHANGE_REQUIRED")
        .select(F.explode(F.array_distinct("triggered")).alias("page_id"))
        .groupBy("page_id")
        .agg(F.count("*").alias("alerts"))
    )
    return pages.join(hits, "page_id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


def bipartite(runs: DataFrame) -> DataFrame:
    """Edges from sources to triggered pages with the highest confidence."""
    return (
        runs.select("source_id", F.explode("triggered").alias("page_id"), "confidence")
        .groupBy("source_id", "page_id")
        .agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.count("*").alias("n"))
    )


def five_numbers(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Smallest value, quartiles (linear interpolation) and largest value, rounded to 6 places."""
    q = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    out = (df.groupBy(*by) if by else df.groupBy()).agg(q.alias("q"))
    names = ["minimum", "p25", "median", "p75", "maximum"]
    return out.select(*(by or []), *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


def snapshot_versions(snapshots: DataFrame, key: str, version: str, keep: int) -> DataFrame:
    """The newest ``keep`` + 1 versions of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return snapshots.withColumn("rn", rank).where(F.col("rn") <= keep + 1)


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left rows with the first right row of their keys, if any."""
    value = [c for c in right.columns if c not in keys]
    best = right.groupBy(*keys).agg(F.min_by(F.struct(*value), F.col(order)).alias("m"))
    return left.join(best, keys, "left").select(*left.columns, *[F.col(f"m.{c}").alias(c) for c in value if c not in left.columns])


def pass_rates(runs: DataFrame, stages: int = 9) -> DataFrame:
    """Per source and stage: the share of the source's rows that came at least that far."""
    rows = runs.select("source_id", stage_number(F.col("stage_reached")).alias("s"))
    shares = F.array(*[F.count_if(F.col("s") >= k) / F.count("*") for k in range(1, stages + 1)])
    spread = rows.groupBy("source_id").agg(shares.alias("shares")).select("source_id", F.posexplode("shares"))
    return spread.select("source_id", (F.col("pos") + 1).alias("stage"), F.col("col").alias("pass_rate"))


# Days of the named spans of time.
SPANS = {"7D": 7, "30D": 30, "90D": 90, "180D": 180, "365D": 365}


def span_of(preset: str | None, today: str, first: str | None = None, last: str | None = None) -> tuple[str | None, str | None]:
    """(first, last) day of a filter: given ones as they are, else those of a named span that ends today."""
    import datetime

    if first or preset not in SPANS:
        return first, last
    return (datetime.date.fromisoformat(today) - datetime.timedelta(days=SPANS[preset])).isoformat(), today


def with_pages(funnel_rows: DataFrame, runs: DataFrame, stage: int = 7) -> DataFrame:
    """``funnel`` with a stage more: how many different pages the rows triggered."""
    pages = runs.select(F.explode("triggered").alias("p")).agg(F.count_distinct("p").alias("n"))
    last = pages.select(F.lit(stage).alias("stage"), "n", F.lit("pages").alias("unit"))
    return funnel_rows.select("stage", "n", F.lit("runs").alias("unit")).unionByName(last)


def stage_matrix(sources: DataFrame, runs: DataFrame, stages: int = 9) -> DataFrame:
    """(source_id, stage, passed, rejected, errored, unreached) for every source and stage, zeros for sources without rows.

    Each row is counted once at its own stage; what lies before and behind is a
    running sum over the stages of a source.
    """
    s = F.least(stage_number(F.col("stage_reached")), F.lit(stages))
    at = runs.select("source_id", s.alias("stage"), "outcome").groupBy("source_id", "stage").agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "completed").alias("done"), errors().alias("errored")
    )
    grid = sources.select("source_id").distinct().select("source_id", F.explode(F.sequence(F.lit(0), F.lit(stages))).alias("stage"))
    full = grid.join(at, ["source_id", "stage"], "left").na.fill(0, ["n", "done", "errored"])
    by = Window.partitionBy("source_id").orderBy("stage")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.coalesce(F.sum("n").over(by.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    rows = full.withColumn("unreached", before).withColumn("passed", behind + F.col("done"))
    return rows.where("stage > 0").select("source_id", "stage", "passed", (F.col("n") - F.col("done") - F.col("errored")).alias("rejected"), "errored", "unreached")


def run_status(outcome: Column) -> Column:
    """OK, ERROR or another outcome in capitals; IDLE without a run."""
    return F.when(outcome.isNull(), "IDLE").when(outcome == "error", "ERROR").when(outcome.isin("completed", "no_change"), "OK").otherwise(F.upper(outcome))


def latest_run(runs: DataFrame) -> DataFrame:
    """One row: the latest run, the status of its last row, and its deepest stage; IDLE if there is none."""
    last = runs.agg(F.max_by(F.struct("run_id", "outcome"), F.struct("ts", "event_id")).alias("x"))
    deep = runs.join(F.broadcast(last.select(F.col("x.run_id").alias("run_id"))), "run_id", "left_semi").agg(F.max(stage_number(F.col("stage_reached"))).alias("deepest"))
    one = last.crossJoin(deep)  # two rows of one value each
    return one.select(F.col("x.run_id").alias("run_id"), run_status(F.col("x.outcome")).alias("status"), F.coalesce("deepest", F.lit(0)).alias("deepest"))

"""Run-log queries, bound to ``events``: each name has a DataFrame and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import change as C
from ..operators import monitoring as M
from ..operators import retrieval
from ..operators import runs as R
from ..sources.tables import table

# The stage that stands for each type of event.
STAGE_OF = {"signup": "stage1", "view": "stage2", "click": "stage4", "purchase": "stage6_complete", "error": "scrape"}
VERDICTS = ["CHANGE_REQUIRED", "UNCERTAIN", "NO_CHANGE"]


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a run log: a day is a run, a user is a source."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    bought = F.col("event_type") == "purchase"
    stage = F.element_at(F.create_map(*[F.lit(x) for p in STAGE_OF.items() for x in p]), F.col("event_type"))
    verdict = F.when(bought & (k >= 50), "CHANGE_REQUIRED").when(bought & (k >= 25), "UNCERTAIN").when(bought, "NO_CHANGE")
    pages = F.array(F.concat(F.lit("P"), (k % 10).cast("string")), F.concat(F.lit("P"), (k % 7).cast("string")))
    return e.select(
        "event_id",
        F.substring(F.col("ts").cast("string"), 1, 10).alias("run_id"),
        F.col("user_id").alias("source_id"),
        "ts",
        stage.alias("stage_reached"),
        F.when(F.col("event_type") == "error", "error").when(bought, "completed").otherwise("no_change").alias("outcome"),
        F.col("value").alias("duration"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        verdict.alias("verdict"),
        F.when(bought, pages).otherwise(F.array().cast("array<string>")).alias("triggered"),
        k.alias("k"),
    )


RUNS = """runs as (
  select event_id, substr(cast(ts as varchar), 1, 10) as run_id, user_id as source_id, ts,
    case event_type when 'signup' then 'stage1' when 'view' then 'stage2' when 'click' then 'stage4'
      when 'purchase' then 'stage6_complete' when 'error' then 'scrape' end as stage_reached,
    case event_type when 'signup' then 1 when 'view' then 2 when 'click' then 4 when 'purchase' then 6 when 'error' then 1 else 0 end as s,
    case event_type when 'error' then 'error' when 'purchase' then 'completed' else 'no_change' end as outcome,
    value as duration, least(value / 100, 1.0) as confidence,
    cast(json_extract_string(props, '$.k') as int) as k,
    case when event_type = 'purchase' and cast(json_extract_string(props, '$.k') as int) >= 50 then 'CHANGE_REQUIRED'
      when event_type = 'purchase' and cast(json_extract_string(props, '$.k') as int) >= 25 then 'UNCERTAIN'
      when event_type = 'purchase' then 'NO_CHANGE' end as verdict
  from events),
hits as (select event_id, 'P' || (k % 10) as page_id from runs where outcome = 'completed'
  union all select event_id, 'P' || (k % 7) from runs where outcome = 'completed')"""


def sql(body: str) -> str:
    return f"with {RUNS}\n{body}"


# Categories of feedback.
CATEGORIES = ["useful", "not_significant", "wrong_amendment", "wrong_page"]


def feedback(s, d):
    names = F.array(*[F.lit(c) for c in (*CATEGORIES, "other")])
    return run_log(s, d).select("ts", F.get(names, F.col("k") % 5).alias("category"))


def ingestion(s, d):
    k = F.col("k")
    log = run_log(s, d).select(
        "run_id",
        F.col("ts").alias("timestamp"),
        F.get(F.array(*[F.lit(c) for c in ("ingested", "skipped", "stub", "error")]), k % 4).alias("outcome"),
        F.when(k % 6 == 0, "duplicate").otherwise("active").alias("status"),
        F.when(k % 3 != 0, k).alias("boilerplate_bytes_stripped"),
        F.when(k % 5 != 0, F.lit(2)).alias("keyphrase_count"),
        F.when(k % 7 != 0, k + 1).alias("duration_seconds"),
    )
    return M.ingestion_summary(log)


def rerank(s, d):
    logit = F.when(F.col("p_partkey") % 7 != 0, (F.col("p_size") - 25) / 10)
    p = table(s, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").cast("double").alias("lexical"), logit.alias("logit"))
    return retrieval.reranked(p, "logit", "lexical", "p_brand").select("p_partkey", F.round("rerank", 6).alias("rerank"))


def paged(s, d):
    return R.page(run_log(s, d).select("event_id", "run_id", "source_id", "outcome"), [F.col("run_id").desc(), F.col("event_id")], 40, 25)


def registry(s, d):
    c = table(s, d, "customer")
    n = F.pmod(F.col("c_custkey"), F.lit(7)).cast("int")
    freq = F.element_at(F.array(*[F.lit(x) for x in ("daily", "weekly", "fortnightly", "monthly", "quarterly", "yearly", "Daily")]), n + 1)
    last = F.when(n == 3, F.lit("not a date")).otherwise(F.date_sub(F.to_date(F.lit("2024-01-30")), (F.col("c_custkey") % 40).cast("int")).cast("string"))
    return R.due(c.select("c_custkey", freq.alias("check_frequency"), last.alias("last_checked")), "2024-01-30")


def notes(s, d):
    """Feedback with the first run of its source, bound to labels and events."""
    fb = table(s, d, "labels").select(F.col("doc_id").alias("source_id"), "quality")
    rt = run_log(s, d).select("source_id", "event_id", "outcome", "run_id")
    return R.first_match(fb, rt, ["source_id"], "event_id")


def versions(s, d):
    r = run_log(s, d).select("source_id", "event_id", "outcome")
    return R.snapshot_versions(r, "source_id", "event_id", 3).select("source_id", "event_id", "outcome", "rn")


def pages_with_alerts(s, d):
    pages = s.range(12).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("page_id"))
    return R.page_alerts(pages, run_log(s, d))


COUNTS = "cast(count(*) filter (outcome = 'completed') as bigint) as completed, cast(count(*) filter (outcome = 'no_change') as bigint) as no_change, cast(count(*) filter (outcome = 'error') as bigint) as errored"
ALERTS = "count(*) filter (verdict = 'CHANGE_REQUIRED') as alerts, count(*) as total"
RN = "row_number() over (partition by source_id order by ts desc, event_id desc) as rn"

QUERIES = {
    "feedback_shares": (
        lambda s, d: C.feedback_shares(feedback(s, d), CATEGORIES),
        sql("""select category, n, n / cast(sum(n) over () as double) * 100 as percent from (
select case k % 5 when 0 then 'useful' when 1 then 'not_significant' when 2 then 'wrong_amendment' when 3 then 'wrong_page' end as category, count(*) as n
from runs where k % 5 < 4 group by 1)"""),
    ),
    "weekly_precision": (
        lambda s, d: C.weekly_precision(feedback(s, d), "ts"),
        sql("""select cast(cast(ts as date) - cast(dayofweek(ts) as int) as varchar) as week, count(*) filter (k % 5 = 0) as useful, count(*) as total,
count(*) filter (k % 5 = 0) / cast(count(*) as double) as precision from runs group by 1"""),
    ),
    "source_pass_rates": (
        lambda s, d: R.pass_rates(run_log(s, d)),
        sql("""select source_id, cast(stage as int) as stage, count(*) filter (s >= stage) / cast(count(*) as double) as pass_rate
from runs, range(1, 10) t(stage) group by 1, 2"""),
    ),
    "ingestion_summary": (
        ingestion,
        sql("""select run_id, min(ts) as start_time, count(*) as total_pages, count(*) filter (k % 4 = 0) as pages_ingested,
count(*) filter (k % 4 = 1) as pages_skipped, count(*) filter (k % 4 = 2) as stubs, count(*) filter (k % 4 = 3) as errors,
count(*) filter (k % 6 = 0) as duplicates, cast(sum(case when k % 3 <> 0 then k else 0 end) as bigint) as boilerplate_bytes,
cast(sum(case when k % 5 <> 0 then 2 else 0 end) as bigint) as keyphrases_total,
cast(sum(case when k % 7 <> 0 then k + 1 else 0 end) as bigint) as total_duration from runs group by 1"""),
    ),
    "rerank_blend": (
        rerank,
        """select p_partkey, round(0.8 * coalesce(1 / (1 + exp(-(case when p_partkey % 7 <> 0 then (p_size - 25) / 10.0 end))), 0.5)
  + 0.2 * coalesce((p_retailprice - min(p_retailprice) over w) / cast(nullif(max(p_retailprice) over w - min(p_retailprice) over w, 0) as double), 0), 6) as rerank
from part window w as (partition by p_brand)""",
    ),
    "run_rollup": (
        lambda s, d: R.run_rollup(run_log(s, d)).withColumn("duration", F.round("duration", 4)),
        sql(f"""select *, case when errored = sources then 'error' when errored > 0 then 'partial' else 'ok' end as status
from (select run_id, min(ts) as started, round(sum(duration), 4) as duration, count(*) as sources, {COUNTS},
  count(*) filter (verdict = 'CHANGE_REQUIRED') as alerts from runs group by run_id)"""),
    ),
    "run_overall": (
        lambda s, d: R.overall(run_log(s, d)),
        sql("""select count(distinct run_id) as runs, count(distinct source_id) as sources,
  count(*) filter (outcome = 'error') as errored, count(*) filter (outcome = 'error') / cast(greatest(count(*), 1) as double) as error_rate,
  arg_max(run_id, ts) as latest_run, max(s) as deepest_stage from runs"""),
    ),
    "verdict_counts": (
        lambda s, d: R.verdict_counts(run_log(s, d), VERDICTS),
        sql("select " + ", ".join(f"count(*) filter (verdict = '{v}') as {v.lower()}" for v in VERDICTS) + " from runs"),
    ),
    "verdicts_by_run": (
        lambda s, d: R.verdicts_by_run(run_log(s, d), VERDICTS),
        sql("select run_id, " + ", ".join(f"count(*) filter (verdict = '{v}') as {v.lower()}" for v in VERDICTS) + " from runs group by run_id"),
    ),
    "stage_outcomes": (
        lambda s, d: R.stage_outcomes(run_log(s, d)),
        sql(f"select cast(g as int) as stage, {COUNTS} from range(1, 7) t(g) left join runs on s = g group by g"),
    ),
    "source_statistics": (
        lambda s, d: R.source_statistics(run_log(s, d), F.lit("2024-01-10").cast("timestamp_ntz")),
        sql("""select source_id, count(*) as checks, max(ts) as last_check, max(ts) filter (outcome = 'completed') as last_success,
  count(*) filter (outcome = 'error') as errored, count(*) filter (verdict = 'CHANGE_REQUIRED') as alerts
from runs where ts >= timestamp '2024-01-10' group by source_id"""),
    ),
    "source_reliability": (
        lambda s, d: R.reliability(run_log(s, d)).withColumn("success_rate", F.round("success_rate", 9)),
        sql("""select source_id, count(*) as checks, count(*) filter (outcome = 'error') as errored,
  round(1 - count(*) filter (outcome = 'error') / cast(count(*) as double), 9) as success_rate,
  max(run_id) filter (outcome = 'error') as last_error from runs group by source_id"""),
    ),
    "current_streak": (
        lambda s, d: R.current_streak(run_log(s, d)),
        sql(f"""select source_id, kind, count(*) as length from (
  select *, sum(change) over (partition by source_id order by rn) as island from (
    select *, case when lag(kind) over (partition by source_id order by rn) <> kind then 1 else 0 end as change from (
      select source_id, case outcome when 'error' then 'error' else 'success' end as kind, {RN} from runs)))
where island = 0 group by source_id, kind"""),
    ),
    "consecutive_failures": (
        lambda s, d: R.consecutive_failures(run_log(s, d)),
        sql(f"""select source_id, cast(coalesce(min(rn) filter (outcome <> 'error') - 1, count(*)) as bigint) as failures
from (select source_id, outcome, {RN} from runs) where rn <= 20 group by source_id"""),
    ),
    "health_conditions": (
        lambda s, d: R.health_conditions(run_log(s, d), 0.2, 2),
        sql(f"""select run_id, error_rate, coalesce(failing, 0) as failing, error_rate > 0.2 as rate_alert, coalesce(failing, 0) > 0 as streak_alert
from (select run_id, count(*) filter (outcome = 'error') / cast(count(*) as double) as error_rate from runs group by run_id)
left join (select run_id, count(distinct source_id) as failing from runs where source_id in (
  select source_id from (select source_id, outcome, {RN} from runs) where rn <= 20 group by source_id
  having coalesce(min(rn) filter (outcome <> 'error') - 1, count(*)) >= 2) group by run_id) using (run_id)"""),
    ),
    "alerts_by_iso_week": (
        lambda s, d: R.per_period(run_log(s, d), R.iso_week(F.col("ts")), "week"),
        sql(f"select strftime(ts, '%G-W%V') as week, {ALERTS} from runs group by 1"),
    ),
    "alerts_by_sunday_week": (
        lambda s, d: R.per_period(run_log(s, d), R.sunday_week(F.col("ts")).cast("string"), "week"),
        sql(f"select cast(cast(ts as date) - cast(dayofweek(ts) as int) as varchar) as week, {ALERTS} from runs group by 1"),
    ),
    "alerts_by_day": (
        lambda s, d: R.per_period(run_log(s, d), F.col("run_id"), "day"),
        sql(f"select run_id as day, {ALERTS} from runs group by 1"),
    ),
    "alerts_by_month": (
        lambda s, d: R.per_period(run_log(s, d), F.substring("run_id", 1, 7), "month"),
        sql(f"select substr(run_id, 1, 7) as month, {ALERTS} from runs group by 1"),
    ),
    "stage_funnel": (
        lambda s, d: R.funnel(run_log(s, d)),
        sql("select stage, n, n / lag(n) over (order by stage) as pass_rate from (select cast(g as int) as stage, count(*) as n from runs join range(1, 7) t(g) on g <= s group by g)"),
    ),
    "stage_table": (
        lambda s, d: R.stage_table(run_log(s, d)),
        sql("""select cast(g as int) as stage, count(*) filter (s > g or (s = g and outcome = 'completed')) as passed,
  count(*) filter (s = g and outcome = 'no_change') as rejected, count(*) filter (s = g and outcome = 'error') as errored,
  count(*) filter (s < g) as skipped from runs cross join range(1, 7) t(g) group by g"""),
    ),
    "alert_calendar": (
        lambda s, d: R.calendar(run_log(s, d)),
        sql("select run_id as day, count(*) as alerts, count(distinct source_id) as sources from runs where verdict = 'CHANGE_REQUIRED' group by 1"),
    ),
    "daily_error_rate": (
        lambda s, d: R.daily_error_rate(run_log(s, d), "2024-02-03"),
        sql("""select cast(cast(g as date) as varchar) as day, count(event_id) as checked, count(*) filter (outcome = 'error') / nullif(cast(count(event_id) as double), 0) as rate
from generate_series(date '2024-02-03' - 29, date '2024-02-03', interval 1 day) t(g) left join runs on run_id = cast(cast(g as date) as varchar) group by g"""),
    ),
    "threshold_sweep": (
        lambda s, d: R.threshold_sweep(run_log(s, d), "confidence", F.col("k") >= 50),
        sql("""select g / 20 as threshold, count(event_id) as above, count(*) filter (k >= 50) as hits,
  case when count(event_id) >= 3 then count(*) filter (k >= 50) / count(event_id) end as precision,
  count(*) filter (k >= 50) / (select count(*) from runs where k >= 50) as recall
from range(0, 21) t(g) left join runs on round(confidence * 20, 9) >= g group by g"""),
    ),
    "sources_due": (
        registry,
        """select c_custkey, f as check_frequency, l as last_checked,
  coalesce(date_diff('day', try_cast(l as date), date '2024-01-30') >= case lower(f) when 'daily' then 1 when 'weekly' then 7 when 'fortnightly' then 14 when 'monthly' then 30 when 'quarterly' then 91 else 7 end, true) as due
from (select c_custkey, ['daily', 'weekly', 'fortnightly', 'monthly', 'quarterly', 'yearly', 'Daily'][c_custkey % 7 + 1] as f,
  case when c_custkey % 7 = 3 then 'not a date' else cast(date '2024-01-30' - cast(c_custkey % 40 as int) as varchar) end as l from customer)""",
    ),
    "filtered_runs": (
        lambda s, d: R.filtered(run_log(s, d), "2024-01-05", "2024-01-20", None, list(range(1, 40)), ["CHANGE_REQUIRED", "UNCERTAIN"], 6).select("event_id", "run_id", "verdict"),
        sql("""select event_id, run_id, verdict from runs where ts between timestamp '2024-01-05' and timestamp '2024-01-20'
  and source_id between 1 and 39 and verdict in ('CHANGE_REQUIRED', 'UNCERTAIN') and s >= 6"""),
    ),
    "paged_runs": (paged, sql("select event_id, run_id, source_id, outcome from runs order by run_id desc, event_id limit 25 offset 40")),
    "page_alerts": (
        pages_with_alerts,
        sql("""select 'P' || g as page_id, count(distinct event_id) as alerts from range(0, 12) t(g)
left join (select event_id, page_id from hits where event_id in (select event_id from runs where verdict = 'CHANGE_REQUIRED')) h on h.page_id = 'P' || g group by g"""),
    ),
    "source_page_edges": (
        lambda s, d: R.bipartite(run_log(s, d)),
        sql("select source_id, page_id, max(coalesce(confidence, 0)) as confidence, count(*) as n from runs join hits using (event_id) group by source_id, page_id"),
    ),
    "score_distribution": (
        lambda s, d: R.five_numbers(run_log(s, d), "duration", ["outcome"]),
        sql("""select outcome, round(min(duration), 6) as minimum, round(quantile_cont(duration, 0.25), 6) as p25, round(quantile_cont(duration, 0.5), 6) as median,
  round(quantile_cont(duration, 0.75), 6) as p75, round(max(duration), 6) as maximum from runs group by outcome"""),
    ),
    "snapshot_versions": (
        versions,
        sql("select source_id, event_id, outcome, cast(rn as int) as rn from (select *, row_number() over (partition by source_id order by event_id desc) as rn from runs) where rn <= 4"),
    ),
    "feedback_first_run": (
        notes,
        sql("""select doc_id as source_id, quality, event_id, outcome, run_id from labels
left join (select source_id, min(event_id) as event_id, arg_min(outcome, event_id) as outcome, arg_min(run_id, event_id) as run_id from runs group by source_id) on source_id = doc_id"""),
    ),
}

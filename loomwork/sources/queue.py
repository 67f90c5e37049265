"""The queue of deferred triggers as a table: what is to do, what has expired, what is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUEUE = "id long, run_id string, source_id string, page_id string, trigger_data string, created_at string, processed boolean"
TRIGGERS = (
    "struct<ipfr_page_id:string,triggers:array<struct<source_id:string,source_url:string,source_importance:double,source_type:string,diff_text:string,"
    "significance:string,stage4_final_score:double,biencoder_max_chunk_score:double,crossencoder_final_score:double,graph_propagated:boolean>>>"
)
DAYS = 7


def age_in_days(created: Column, now: Column) -> Column:
    """Null where the date cannot be read; a time without a zone is one of the session's."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.try_cast("timestamp"))) / 86_400_000_000


def stale(created: Column, now: Column, days: float = DAYS) -> Column:
    """Older than ``days``; what has no readable date is never stale."""
    return F.coalesce(age_in_days(created, now) > days, F.lit(False))


def store(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with new rows, not processed yet. Rows whose id is there already are left out, so storing twice changes nothing."""
    rows = new.withColumn("processed", F.lit(False)).dropDuplicates(["id"])
    return queue.unionByName(rows.join(queue.select("id"), "id", "left_anti"))


def expire(queue: DataFrame, now: Column, days: float = DAYS) -> DataFrame:
    """The queue with stale rows taken as processed."""
    return queue.withColumn("processed", F.col("processed") | stale(F.col("created_at"), now, days))


def mark_processed(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue with the ids of ``done`` processed; marking twice, or an id that is not there, changes nothing."""
    ids = done.select("id").distinct().withColumn("_done", F.lit(True))
    marked = queue.join(ids, "id", "left")
    return marked.withColumn("processed", F.col("processed") | F.coalesce("_done", F.lit(False))).select(*queue.columns)


def pending(queue: DataFrame, now: Column, days: float = DAYS) -> DataFrame:
    """What is to do, with the triggers decoded; order by created_at to read it in turn."""
    rows = expire(queue, now, days).where(~F.col("processed"))
    return rows.select("id", "run_id", "source_id", "page_id", F.from_json("trigger_data", TRIGGERS).alias("trigger_data"), "created_at")

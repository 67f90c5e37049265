"""Monitoring rules and page rollups with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import monitoring as M
from ..operators import runs as R
from ..sources.tables import table
from .run_queries import RUNS, run_log


def pages(s, d):
    return table(s, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 4 == 0, "stub").otherwise("active").alias("status"))


def rollup(s, d):
    n = F.lit(table(s, d, "pages").count())
    part = lambda t, c: table(s, d, t).select((F.col(c) % n).alias("page_id"))
    return M.page_rollup(pages(s, d), chunks=part("documents", "doc_id"), entities=part("orders", "o_orderkey"), events=part("events", "event_id"))


def edges(s, d):
    li = table(s, d, "lineitem").select((F.col("l_partkey") % 50).alias("source"), (F.col("l_suppkey") % 50).alias("target")).distinct()
    return M.active_edges(li, pages(s, d))


def blocked(s, d):
    html = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("<TITLE> Access Denied </title>"), F.col("html"))).when(
        F.col("page_id") % 9 == 1, F.concat(F.col("html"), F.lit("access denied"))
    ).when(F.col("page_id") % 9 == 2, F.lit("Just a Moment...")).otherwise(F.col("html"))
    return table(s, d, "pages").select("page_id", T.is_blocked(html).alias("blocked"))


def intake(s, d):
    o = table(s, d, "orders")
    ingested = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 5 == 1, F.lit(None)).otherwise("1995-06-01")
    return o.select("o_orderkey", M.needs_ingestion(F.col("o_orderdate").cast("string"), ingested).alias("needed"))


def probes(s, d):
    e = table(s, d, "events")
    old = F.when(F.col("event_id") % 4 != 0, (F.col("user_id") % 3).cast("string"))
    return e.select("event_id", M.rss_changed(old, (F.col("event_id") % 3).cast("string"), F.when(old.isNotNull(), F.lit(1)), F.lit(1)).alias("signal"))


def scores(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("page_id"))
    li = table(s, d, "lineitem")
    a = li.groupBy(F.col("l_partkey").alias("page_id")).agg(F.max("l_discount").alias("relevance"))
    b = li.groupBy(F.col("l_suppkey").alias("page_id")).agg(F.max("l_tax").alias("semantic"))  # parts beyond the suppliers' numbers have none
    return M.stitched(p, a, b)


def searched(s, d):
    p = table(s, d, "part")
    return p.where(M.contains_any("Brand#1", F.col("p_brand"), F.col("p_type"), arrays=(F.array("p_name"),))).select("p_partkey", "p_brand")


def json_fields(s, d):
    e = table(s, d, "events")
    return M.expand_json(e.select("event_id", "props"), "props", {"k": ("$.k", "int"), "none": ("$.a[0].b", "string")}).select("event_id", "k", "none")


def entities(s, d):
    c = table(s, d, "customer")
    raw = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("  Co"), F.when(F.col("c_custkey") % 2 == 0, "'s").otherwise(" "))
    return c.select("c_custkey", M.canonical_entity(raw, {"building co": "Builders"}).alias("entity"))


def phrases(s, d):
    b = table(s, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("phrase"))
    return b.where(M.valid_phrase(F.col("phrase"), 3, ["than"], ["the", "that"])).select("item_id", "phrase")


def chunks(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("content"), F.array().cast("array<struct<char_start:int,heading_text:string>>").alias("sections"))
    return M.natural_chunks(docs).groupBy("page_id").agg(F.count("*").alias("n"), F.max(F.length("chunk_text")).alias("longest"))


def instruments(s, d):
    o = table(s, d, "orders")
    ident = lambda c: F.concat(F.lit("C2023A"), F.lpad((c % 50).cast("string"), 5, "0"))
    none = F.lit(None).cast("string")
    reason = lambda affect, a, b, md: F.struct(affect.alias("affect"), a.alias("affected"), F.lit("Act").alias("affected_series"), b.alias("amended"), none.alias("amended_series"), md.alias("markdown"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    reasons = F.array(
        reason(F.when(key % 2 == 0, "Amend").otherwise("Other"), ident(cust), none, none),
        reason(F.lit("Amend"), none, none, F.concat(F.lit("see "), ident(key), F.lit("."))),
    )
    rows = o.select(key.alias("id"), F.when(key % 3 == 0, ident(key)).otherwise("F2020L1").alias("register_id"), reasons.alias("reasons"))
    return M.amending_instruments(rows)


def health(s, d):
    return R.overall(R.filtered(run_log(s, d), "2024-01-10"))


def matrix(s, d):
    """Sources by stage: rows that stopped at each."""
    r = run_log(s, d)
    return r.groupBy("source_id").pivot("stage_reached", list(R.STAGE_NUMBER)).count().na.fill(0)


QUERIES = {
    "page_rollup": (
        rollup,
        """with n as (select count(*) as n from pages), c as (select doc_id % n as p, count(*) as c from documents, n group by 1),
o as (select o_orderkey % n as p, count(*) as c from orders, n group by 1), e as (select event_id % n as p, count(*) as c from events, n group by 1)
select page_id, url, case when page_id % 4 = 0 then 'stub' else 'active' end as status, coalesce(c.c, 0) as chunks, coalesce(o.c, 0) as entities, coalesce(e.c, 0) as events
from pages left join c on c.p = page_id left join o on o.p = page_id left join e on e.p = page_id""",
    ),
    "active_edges": (
        edges,
        """select distinct l_partkey % 50 as source, l_suppkey % 50 as target from lineitem
where l_partkey % 50 % 4 <> 0 and l_suppkey % 50 % 4 <> 0 and l_partkey % 50 in (select page_id from pages) and l_suppkey % 50 in (select page_id from pages)""",
    ),
    "blocked_pages": (
        blocked,
        """select page_id, case page_id % 9 when 0 then true when 2 then true when 1 then length(html) + 13 < 5000 else false end
  or regexp_matches(lower(html), 'just a moment|enable cookies|please enable javascript|captcha|checking your browser|robot check|verify you are human') as blocked from pages""",
    ),
    "intake_needed": (
        intake,
        "select o_orderkey, o_orderkey % 5 <= 1 or cast(o_orderdate as varchar) > '1995-06-01' as needed from orders",
    ),
    "rss_probes": (
        probes,
        "select event_id, case when event_id % 4 = 0 then 'unknown' when user_id % 3 = event_id % 3 then 'unchanged' else 'changed' end as signal from events",
    ),
    "stitched_scores": (
        scores,
        """select p_partkey as page_id, coalesce(a.x, 0) as relevance, coalesce(b.x, 0) as semantic from part
left join (select l_partkey, max(l_discount) as x from lineitem group by 1) a on l_partkey = p_partkey left join (select l_suppkey, max(l_tax) as x from lineitem group by 1) b on l_suppkey = p_partkey""",
    ),
    "free_text_search": (searched, "select p_partkey, p_brand from part where lower(p_brand) like '%brand#1%' or lower(p_type) like '%brand#1%' or lower(p_name) like '%brand#1%'"),
    "json_fields": (json_fields, "select event_id, cast(json_extract_string(props, '$.k') as int) as k, json_extract_string(props, '$.a[0].b') as none from events"),
    "canonical_entities": (
        entities,
        "select c_custkey, case when lower(c_mktsegment) = 'building' then 'Builders' else c_mktsegment || ' Co' end as entity from customer",
    ),
    "valid_phrases": (
        phrases,
        """select item_id, phrase from (select item_id, unnest(string_split(text, ' ')) as phrase from benchmark)
where length(trim(phrase, ' ')) >= 3 and lower(trim(phrase, ' ')) <> 'than' and not (not regexp_matches(phrase, '\\s') and (lower(phrase) in ('the', 'that') or regexp_full_match(phrase, '\\d+')))""",
    ),
    "amending_instruments": (
        instruments,
        """with v as (select o_orderkey as id, 'C2023A' || lpad(cast(o_orderkey % 50 as varchar), 5, '0') as k, 'C2023A' || lpad(cast(o_custkey % 50 as varchar), 5, '0') as c from orders),
r as (select id, 0 as a, k as title_id, 'Act' as series from v where id % 3 = 0 union all select id, 1, c, 'Act' from v where id % 2 = 0 union all select id, 2, k, '' from v)
select id, title_id, series from (select *, row_number() over (partition by id, title_id order by a) as n from r) where n = 1""",
    ),
    "health_window": (
        health,
        f"""with {RUNS} select count(distinct run_id) as runs, count(distinct source_id) as sources, count(*) filter (outcome = 'error') as errored,
  count(*) filter (outcome = 'error') / cast(greatest(count(*), 1) as double) as error_rate, arg_max(run_id, ts) as latest_run, max(s) as deepest_stage
from runs where ts >= timestamp '2024-01-10'""",
    ),
    "source_stage_matrix": (
        matrix,
        f"""with {RUNS} select source_id, {", ".join(f"count(*) filter (stage_reached = '{x}') as {x}" for x in R.STAGE_NUMBER)} from runs group by source_id""",
    ),
    "next_page_number": (
        lambda s, d: M.next_number(table(s, d, "customer"), "c_name"),
        "select max(cast(regexp_extract(c_name, '([0-9]+)', 1) as bigint)) + 1 as next from customer",
    ),
    "natural_chunks": (chunks, None),
}

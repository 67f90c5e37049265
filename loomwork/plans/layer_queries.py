"""Fallback layers, extraction between headings, health from JSON and stored tables, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import health as H
from ..operators import layers as L
from ..sources import stores as S
from ..sources.shared import shared_folder
from ..sources.tables import table
from .run_queries import RUNS, run_log

START, END = [r"th\w+", r"en|is"], [r"er\w*", r"an\w*"]


def extracted(s, d):
    """Documents with a line for each sentence: what stands between two short ones."""
    lines = F.regexp_replace("text", r"[.] ", "\n")
    return table(s, d, "documents").select("doc_id", F.md5(L.between_headings(lines, START, END)).alias("digest"))


def ids(s, d):
    p = table(s, d, "pages")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://example.org/Series/C"), F.col("page_id"), F.lit("/x"))).when(
        F.col("page_id") % 4 == 1, F.concat(F.lit("https://example.org/a/C2023A0"), F.col("page_id"), F.lit("/latest/text;v=1?q=/Z"))
    ).otherwise(F.col("url"))
    bill = F.concat(F.lit("https://example.org/d.w3p;query=Id%3A%22legislation%2Fbillhome%2Fr"), F.col("page_id"), F.lit("%22+x"))
    return p.select("page_id", L.title_id(url).alias("title_id"), L.bill_id(F.when(F.col("page_id") % 3 > 0, bill).otherwise("none")).alias("bill_id"))


def versions(s, d):
    """Orders as versions; two in three have instruments already."""
    o = table(s, d, "orders")
    all_ = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 > 0, F.substring(F.col("o_orderdate").cast("string"), 1, 10)).alias("start"))
    return all_, all_.where("id % 3 > 0").select("id")


def affecting(s, d):
    """Line items as mentions; an order has several of one number, of which the first in the table counts."""
    every, found = versions(s, d)
    li = table(s, d, "lineitem")
    part, n = F.col("l_partkey"), F.col("l_linenumber")
    none = F.lit(None).cast("string")
    name = lambda c: F.concat(F.lit("C"), (c % 20).cast("string"))
    day = F.substring(F.col("l_shipdate").cast("string"), 1, 10)
    items = li.select(
        F.col("l_orderkey").alias("id"), n.alias("pos"), F.when(part % 4 == 0, day).alias("effective"), F.when(part % 4 == 1, "").alias("begins"), none.alias("commences"),
        F.when(part % 3 == 0, name(part)).alias("by_title"), F.when(part % 3 == 0, "Act").alias("by_series"), F.when(part % 3 == 1, name(part)).alias("other_title"), none.alias("other_series"),
        F.when(part % 7 == 0, F.concat(F.lit("B"), n)).alias("by_id"), none.alias("affecting_id"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("seen"),
    )
    return L.affecting(every, found, items)


def attempts(s, d):
    """Line items as tries to get a statement: two of the service, two of the site."""
    li = table(s, d, "lineitem").where("l_linenumber <= 4")
    status = F.when(F.col("l_partkey") % 3 == 0, 200).when(F.col("l_partkey") % 19 == 1, F.lit(None)).when(F.col("l_partkey") % 19 == 2, 500).otherwise(404)
    text = F.when(F.col("l_suppkey") % 5 == 0, "").when(F.col("l_partkey") % 33 == 0, F.lit(None)).otherwise(F.concat(F.lit("Text "), F.col("l_suppkey"), F.lit("\nFinancial notes\nrest")))
    return li.select(
        F.col("l_orderkey").alias("id"), (F.col("l_linenumber") > 2).alias("web"), F.when(F.col("l_linenumber") % 2 == 1, "ES").otherwise("Sup").alias("kind"),
        status.alias("status"), F.when(F.col("l_suppkey") % 4 == 0, "application/JSON").otherwise("word").alias("content_type"), text.alias("text"),
    )


def statements(s, d):
    return L.statement(attempts(s, d), ["financial"]).select("id", "layer", "value")


def acts(s, d):
    """Orders as Acts, texts made of their columns."""
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    words = lambda n: F.array_join(F.array_repeat(F.col("o_orderpriority"), n.cast("int")), " ")
    page = lambda a, n, b: F.concat(F.lit(f"Menu\n {a} \n"), words(n), F.lit(f"\n\n&amp;  more\n{b}\nrest"))
    return o.select(
        k.alias("id"),
        F.when(k % 11 > 0, F.concat(F.lit("x"), F.when(k % 7 > 0, F.concat(F.lit("billhome%2Fr"), k)).otherwise(""))).alias("bill_uri"),
        F.when(k % 2 == 0, page("Key   points", k % 3, "CONTENTS")).when(k % 5 == 0, "Key points of it\nx").alias("digest"),
        F.when(k % 13 > 0, F.when(k % 4 == 1, "nothing").otherwise(page("Summary", k % 120, "Progress of Bill"))).alias("home"),
        F.when(k % 9 == 3, page("General Outline", F.lit(2), "Financial impact statement")).alias("memorandum"),
    )


def summaries(s, d):
    return L.act_summary(acts(s, d)).select("id", "layer", F.md5("value").alias("digest"), "errors")


def explained(s, d):
    """Customers as versions, their orders as instruments: some Acts, some not, some only known from the titles."""
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    instruments = o.select(F.col("o_custkey").alias("id"), k.alias("pos"), k.alias("title_id"), F.when(k % 3 == 0, "Act").when(k % 3 == 1, "SR").alias("series"))
    titles = o.where("o_orderkey % 2 = 0").select(k.alias("title_id"), F.when(k % 4 == 0, "Act ").otherwise("SLI").alias("series"))
    return L.explainers(instruments, titles, L.act_summary(acts(s, d)), L.statement(attempts(s, d), ["financial"])).select("id", F.md5("text").alias("digest"), F.length("error").alias("error_length"))


def logged(s, d):
    """The run log with details and pages as JSON; some of it is none."""
    k = F.col("k")
    details = F.concat(
        F.lit('{"stages": {"relevance": {"top_candidates": [{"final_score": '), F.round(F.col("duration") / 100, 3), F.lit('}, {"other": 1}, {"final_score": null}, {"final_score": '), k, F.lit('}]}, "llm_assessment": {"failed": '),
        (k % 50 == 0).cast("int"), F.lit('}, "crossencoder": {"truncation_warnings": ['), F.when(k % 25 == 0, '"a", "b"').otherwise(""), F.lit("]}}}"),
    )
    pages = F.concat(F.lit('[{"biencoder_max_chunk_score": '), k / 100, F.lit("}, {}, "), F.when(k % 2 == 0, F.concat(F.lit('{"crossencoder_final_score": '), k / 200, F.lit("}"))).otherwise("{}"), F.lit("]"))
    bad = F.col("event_id") % 17 == 0
    return run_log(s, d).withColumn("details", F.when(bad, "{not json").otherwise(details)).withColumn("triggered_pages", F.when(bad, "[").otherwise(pages))


def buckets(s, d):
    return H.score_buckets(logged(s, d))


def states(s, d):
    users = table(s, d, "events").select(F.col("user_id").alias("source_id")).distinct()
    u = F.col("source_id")
    state = F.when(u % 10 == 1, F.lit("{bad")).when(u % 10 == 2, '{"previous_text": "x", "last_error": "e"}').when(u % 40 == 3, '{"previous_text": "", "consecutive_failures": 2}').otherwise('{"consecutive_failures": 0}')
    return users.select("source_id", state.alias("state"))


def conditions(s, d):
    return H.conditions(logged(s, d), states(s, d))


def replaced(s, d):
    """Turns of conversations stored by conversation; a third of these are replaced, a few by nothing, twice."""
    rows = table(s, d, "conversations").select("conv_id", "turn", "text")
    path = f"{shared_folder(s)}/turns-{uuid.uuid4().hex}"
    S.create(rows, path, "conv_id", 8)
    pages = rows.where("conv_id % 3 = 0").select("conv_id")
    new = rows.where("conv_id % 3 = 0 and conv_id % 5 > 0 and turn < 2").withColumn("text", F.concat(F.lit("new "), "text"))
    for _ in range(2):
        S.replace(s, path, pages, new.unionByName(new), "conv_id", ["conv_id", "turn"], 8)
    return S.read(s, path).select("conv_id", "turn", F.md5("text").alias("digest"))


def appended(s, d):
    """A log written run by run; a run is written again after a failure."""
    log = run_log(s, d).select("run_id", "event_id", "outcome")
    path = f"{shared_folder(s)}/log-{uuid.uuid4().hex}"
    half = F.col("run_id") <= "2024-01-15"
    S.append_run(log.where(half), path)
    S.append_run(log.where(~half).where("event_id % 2 = 0"), path)  # broke off
    S.append_run(log.where(~half), path)
    return s.read.parquet(path).groupBy(F.col("run_id").cast("string").alias("run_id"), "outcome").agg(F.count("*").alias("n"))


STRIP = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
SUPP = """with a as (select l_orderkey as id, l_linenumber as layer, l_linenumber > 2 as web, case when l_partkey % 3 = 0 then 200 when l_partkey % 19 = 1 then null when l_partkey % 19 = 2 then 500 else 404 end as st,
  l_suppkey % 4 = 0 as js, case when l_suppkey % 5 = 0 then '' when l_partkey % 33 = 0 then null else 'Text ' || l_suppkey end as t from lineitem where l_linenumber <= 4),
b as (select id, layer, coalesce(st = 200, false) and (web or not js) as there, coalesce(st = 404, false) or (coalesce(st = 200, false) and not web and js) as miss, web, st, t from a),
c as (select id, layer, case when there and t <> '' then t end as v, case when there and t is null then layer + 1 when not web and not there and not miss then 3 end as closes,
  case when there and t is null then 'unreadable ' || case when web then 'web' else 'API' end when there and t = '' then case when web then 'web' else 'API' end || ': empty text'
    when not there and not miss then case when web then 'web' else 'API' end || ' ' || case when layer % 2 = 1 then 'ES' else 'Sup' end || ': status ' || coalesce(cast(st as varchar), 'none') end as err from b),
g as (select id, min(layer) filter (v is not null) as best, min(closes) as closed, string_agg(err, '; ' order by layer, err) as errors from c group by id),
st as (select g.id, case when closed is null or best < closed then best end as layer, min(c.v) as value, coalesce(errors, '') as errors from g left join c on c.id = g.id and c.layer = g.best and (closed is null or best < closed) group by all)"""
REP = "(case when {n} > 0 then array_to_string(list_transform(range(0, {n}), lambda i: p), ' ') || ' ' else '' end || '& more')"
SUMS = f"""o as (select o_orderkey as id, o_custkey, o_orderpriority as p, o_orderkey % 11 > 0 as known, o_orderkey % 7 > 0 as bill, o_orderkey % 13 > 0 as home from orders),
t as (select *, case when known and bill and id % 2 = 0 then {REP.format(n='id % 3')} end as d, case when known and home and id % 4 <> 1 then {REP.format(n='id % 120')} end as s,
  case when known and home and id % 9 = 3 then {REP.format(n='2')} end as m from o),
f as (select *, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) >= 100 as lng from t),
su as (select id, o_custkey, case when d is not null then 1 when s is not null and lng then 2 when m is not null then 3 when s is not null then 4 end as layer,
  coalesce(d, case when lng then s end, m, s) as value, case when coalesce(d, s, m) is not null then '' when not known then 'no bill' when not home then 'no home page' else 'no summary' end as errors from f)"""

QUERIES = {
    "between_headings": (
        extracted,
        rf"""with l as (select doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '[.] ', chr(10), 'g'), chr(10)), lambda x: {STRIP}) as l from documents),
a as (select doc_id, l, list_position(list_transform(l, lambda x: length(x) between 1 and 80 and regexp_full_match(x, '(?i)(?:th[\p{{L}}\p{{N}}_]+|en|is)')), true) as i from l),
b as (select doc_id, i, l[coalesce(i, 0) + 1 :] as r from a), c as (select doc_id, i, r, list_position(list_transform(r, lambda x: length(x) between 1 and 80 and regexp_full_match(x, '(?i)(?:er[\p{{L}}\p{{N}}_]*|an[\p{{L}}\p{{N}}_]*)')), true) as j from b)
select doc_id, md5(case when coalesce(i, 0) = 0 then '' else array_to_string(list_filter(case when coalesce(j, 0) > 0 then r[1 : j - 1] else r end, lambda x: x <> ''), ' ') end) as digest from c""",
    ),
    "title_and_bill_ids": (
        ids,
        r"""select page_id, case page_id % 4 when 0 then 'C' || page_id when 1 then 'C2023A0' || page_id else (list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''))[1] end as title_id,
case when page_id % 3 > 0 then 'r' || page_id end as bill_id from pages""",
    ),
    "affecting_instruments": (
        affecting,
        """with v as (select o_orderkey as id, case when o_orderkey % 5 > 0 then substr(cast(o_orderdate as varchar), 1, 10) end as day from orders where o_orderkey % 3 = 0),
r as (select l_orderkey as id, l_linenumber as pos, case when l_partkey % 4 = 0 then substr(cast(l_shipdate as varchar), 1, 10) end as eff,
  case when l_partkey % 3 in (0, 1) then 'C' || (l_partkey % 20) when l_partkey % 7 = 0 then 'B' || l_linenumber end as title_id, case when l_partkey % 3 = 0 then 'Act' else '' end as series from lineitem)
select id, title_id, series from (select r.*, row_number() over (partition by id, title_id order by pos) as n from r join v using (id) where title_id is not null and (day is null or eff is null or starts_with(eff, day))) where n = 1""",
    ),
    "statement_layers": (statements, f"{SUPP} select id, layer, value from st"),
    "act_summaries": (summaries, f"with {SUMS} select id, layer, md5(value) as digest, errors from su"),
    "explainers": (
        explained,
        f"""{SUPP}, {SUMS},
i as (select o_custkey as cust, o_orderkey as id, case when o_orderkey % 3 = 0 then true when o_orderkey % 3 = 1 then false else o_orderkey % 4 = 0 end as act from orders),
x as (select cust, i.id, case when act then su.value else st.value end as value, case when act then su.errors else st.errors end as errors from i left join su on su.id = i.id left join st on st.id = i.id),
e as (select cust, string_agg(value, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by id) as t, string_agg(nullif(errors, ''), '; ' order by id) as e from x group by cust)
select cust as id, md5(t) as digest, cast(case when t is null then length(coalesce(e, 'No explainer found.')) end as int) as error_length from e""",
    ),
    "json_score_buckets": (
        buckets,
        f"""with {RUNS}, ok as (select * from runs where event_id % 17 <> 0),
v as (select 'stage4_final_score' as label, round(duration / 100, 3) as x from ok union all select 'stage4_final_score', cast(k as double) from ok
  union all select 'biencoder_max_chunk_score', k / 100 from ok union all select 'crossencoder_final_score', k / 200 from ok where k % 2 = 0),
n as (select unnest(['stage4_final_score', 'biencoder_max_chunk_score', 'crossencoder_final_score']) as label), r as (select label, round(x, 6) as x from v where x is not null)
select label, count(x) as n, min(x) as low, quantile_cont(x, 0.25) as p25, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as p75, max(x) as high from n left join r using (label) group by label""",
    ),
    "run_conditions": (
        conditions,
        f"""with {RUNS}, f as (select *, cast(outcome = 'error' as int) as bad, sum(cast(outcome <> 'error' as int)) over (partition by source_id order by ts, event_id) as isl from runs),
st as (select *, sum(bad) over (partition by source_id, isl order by ts, event_id) as streak from f),
s as (select run_id, source_id, max(streak) as streak, max(bad) as bad from st group by 1, 2),
q as (select run_id, max(cast(bad > 0 and streak >= 3 as int)) > 0 as failing, max(cast(source_id % 40 = 3 and source_id % 10 not in (1, 2) as int)) > 0 as blind from s group by 1)
select r.run_id, count(*) filter (outcome = 'error') / count(*) > 0.30 as error_rate, any_value(failing) as consecutive_failures,
  coalesce(sum(cast(k % 50 = 0 as int)) filter (event_id % 17 <> 0), 0) >= 2 as llm_malformed, coalesce(sum(case when k % 25 = 0 then 2 else 0 end) filter (event_id % 17 <> 0), 0) >= 3 as crossencoder_truncation, any_value(blind) as no_baseline
from runs r join q on q.run_id = r.run_id group by r.run_id""",
    ),
    "replaced_turns": (
        replaced,
        """select conv_id, turn, md5(case when conv_id % 3 = 0 then 'new ' || text else text end) as digest from conversations where conv_id % 3 > 0 or (conv_id % 5 > 0 and turn < 2)""",
    ),
    "appended_runs": (appended, f"with {RUNS} select run_id, outcome, count(*) as n from runs group by 1, 2"),
}

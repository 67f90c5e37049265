"""Corpus, change, clustering and SQL-surface queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import change as C
from ..operators import corpus as K
from ..operators import guarded_sql, ml
from ..operators import line_diff as L
from ..sources import tables as S
from ..sources.tables import table


def docs(s, d):
    return table(s, d, "documents")


def stripped(s, d):
    bad = K.frequent_lines(docs(s, d), "doc_id", "text", 0.02)
    return K.strip_lines(docs(s, d), bad, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("digest"), "removed")


LINES = """l as (select distinct doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) as line from documents),
  bad as (select line, count(*) as n from l where length(line) >= 3 group by 1 having count(*) >= (select greatest(2, cast(floor(0.02 * count(*)) as int)) from documents))"""


def duplicates(s, d):
    age = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")))
    return K.exact_duplicates(docs(s, d), "doc_id", "text", age)


def swept(s, d):
    words = table(s, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    return K.sweep_frequent(words, "item_id", "word", 0.3)


TOK = r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))"


def matched(s, d):
    b = table(s, d, "benchmark").select(F.col("item_id").alias("id"), T.shingles(F.col("text")).alias("items"))
    return K.best_matches(b.where("id % 2 = 1"), b.where("id % 2 = 0"), 0.05).withColumn("score", F.round("score", 6))


def chunks(s, d):
    return docs(s, d).select("doc_id", F.inline(T.fixed_chunks(F.col("text")))).select("doc_id", "i", F.md5("chunk").alias("digest"))


def checked(s, d):
    w = T.warnings(F.col("text"), F.col("doc_id") % 900)
    return docs(s, d).select("doc_id", F.array_join(w, ",").alias("warnings"), T.is_stub(F.col("text"), 500, ["nicht"]).alias("stub"))


def url_ids(s, d):
    return table(s, d, "pages").select("page_id", T.page_id(F.col("url")).alias("id"))


def signals(s, d):
    o = table(s, d, "orders")
    old = F.create_map(F.lit("etag"), (F.col("o_custkey") % 5).cast("string"), F.lit("date"), F.lit("x"))
    new = F.when(F.col("o_orderkey") % 7 == 0, F.create_map(F.lit("size"), F.lit("1"))).otherwise(
        F.create_map(F.lit("etag"), (F.col("o_orderkey") % 5).cast("string"), F.lit("size"), F.lit("2"))
    )
    return o.select("o_orderkey", C.compare_signals(old, new).alias("signal"))


def feeds(s, d):
    e = table(s, d, "events")
    old = e.where("event_id % 3 <> 0").select("event_id", "event_type", F.lit(1).alias("v"))
    new = e.where("event_id % 5 <> 0").select("event_id", "event_type", F.when(F.col("event_id") % 4 == 0, 2).otherwise(1).alias("v"))
    return C.feed_changes(old, new, "event_id", ["event_type", "v"])


def sitemap(s, d):
    o = table(s, d, "orders")
    old = o.where("o_orderkey % 4 <> 0").select("o_orderkey", "o_orderdate")
    new = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.expr("o_orderdate + interval 1 day")).otherwise(F.col("o_orderdate")).alias("o_orderdate"))
    return S.left_changes(old, new, "o_orderkey", "o_orderdate").select("o_orderkey", "change")


def merged(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))
    return S.upsert(c, new, ["c_custkey"])


def filled(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return S.backfill(o.where("o_custkey % 2 = 0"), o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


def edge_weights(s, d):
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("edge_type"), F.col("l_quantity").alias("weight"))
    return S.upsert_edges(li.where("weight < 25"), li.where("weight >= 25"))


def turns(s, d, role):
    return table(s, d, "conversations").where(F.col("turn") == role).select("conv_id", "text")


def positional(s, d):
    """Each turn of a conversation against the next, by position."""
    both = each_turn(s, d).withColumn("pair", F.concat_ws(":", "conv_id", "turn"))
    found = C.line_changes(both.select("pair", F.col("old").alias("text")), both.select("pair", F.col("new").alias("text")), "pair", "text")
    part = lambda k: F.split_part("pair", F.lit(":"), F.lit(k)).cast("long")
    return found.select(part(1).alias("conv_id"), part(2).alias("turn"), "line")


def each_turn(s, d):
    return L.with_next(table(s, d, "conversations"), "conv_id", "turn", "text")


def diffs(s, d):
    diff = each_turn(s, d).select("conv_id", "turn", C.unified_diff(F.col("old"), F.col("new")).alias("diff"))
    return diff.select("conv_id", "turn", F.size(C.changed_lines(F.col("diff"))).alias("changed"), F.length("diff").alias("size"))


def prints(s, d):
    text = F.concat(F.lit("Section 12A must apply from 3 May 2024 within 30 days. "), F.col("text"))
    found = docs(s, d).select("doc_id", T.fingerprint(text).alias("f"))
    return found.select("doc_id", *[F.size(f"f.{n}").alias(n) for n in T.FINGERPRINTS], T.significance(F.col("f")).alias("significance"))


def bundled(s, d):
    li = table(s, d, "lineitem")
    t = li.select(F.col("l_partkey").alias("page_id"), F.col("l_suppkey").alias("source_id"), F.col("l_quantity").alias("relevance"), F.col("l_discount").alias("semantic"), F.col("l_tax").alias("rerank"))
    return C.bundles(t).select("page_id", "relevance", "semantic", "rerank", "n")


def replies(s, d):
    reply = F.when(F.col("quality") == 0, F.lit("no json")).when(
        F.col("toxic") == 1, F.lit('```json\n{"verdict": "CHANGE_REQUIRED", "confidence": 0.9, "reasoning": "r", "suggested_changes": ["a"]}\n```')
    ).otherwise(F.concat(F.lit('{"verdict": "NO_CHANGE", "confidence": '), (F.col("doc_id") % 3).cast("string"), F.lit(', "reasoning": "r", "suggested_changes": ["b"]}')))
    out = C.assessments(table(s, d, "labels").select("doc_id", reply.alias("reply")), "reply")
    return out.select("doc_id", "valid", F.size("suggested_changes").alias("n"))


def html(s, d):
    text = T.html_text(F.col("html"))
    return table(s, d, "pages").select("page_id", F.size(F.split(text, "\n")).alias("lines"), F.length(text).alias("size"))


def points(s, d):
    return ml.projected(table(s, d, "embeddings"), "vec_id", "embedding", 2)


def grouped(s, d):
    p = points(s, d).checkpoint()  # read in each round
    lab = ml.clusters(p, "vec_id", "point", 7)
    return ml.cluster_summary(p.join(lab, "vec_id"), "point", 2)


def adhoc(s, d):
    table(s, d, "orders").createOrReplaceTempView("adhoc_orders")
    return guarded_sql.select(s, "-- orders\nselect o_orderpriority, count(*) as n /* rows */ from adhoc_orders group by o_orderpriority;")


def cubed(s, d):
    li = table(s, d, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def revenue(s, d):
    """Revenue of each nation's suppliers; dimension tables are joined by the optimizer's choice."""
    li, sup, nat, reg = (table(s, d, n) for n in ("lineitem", "supplier", "nation", "region"))
    money = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    by = li.groupBy("l_suppkey").agg(F.sum(money).alias("m"))  # before the joins: one row for each supplier
    out = by.join(sup, by["l_suppkey"] == sup["s_suppkey"]).join(nat, sup["s_nationkey"] == nat["n_nationkey"]).join(reg, nat["n_regionkey"] == reg["r_regionkey"])
    return out.groupBy("r_name", "n_name").agg(F.round(F.sum("m"), 2).alias("revenue"))


QUERIES = {
    "frequent_lines": (lambda s, d: K.frequent_lines(docs(s, d), "doc_id", "text", 0.02), f"with {LINES} select * from bad"),
    "strip_boilerplate": (
        stripped,
        f"""with {LINES}, r as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(0, len(string_split(text, chr(10))))) as i from documents)
select doc_id, sha256(coalesce(string_agg(raw, chr(10) order by i) filter (trim(raw) not in (select line from bad)), '')) as digest,
  cast(coalesce(sum(length(raw)) filter (trim(raw) in (select line from bad)), 0) as bigint) as removed from r group by doc_id""",
    ),
    "exact_duplicates": (
        duplicates,
        """select doc_id, f as duplicate_of from (select doc_id, first_value(doc_id) over (partition by sha256(text) order by
  case when doc_id % 3 = 0 then '9999-99-99' else '2024-01-' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') end, doc_id) as f from documents) where f <> doc_id""",
    ),
    "frequent_phrase_sweep": (
        swept,
        f"""with w as (select distinct item_id, unnest({TOK.format(c='text')}) as word from benchmark),
c as (select word from w group by 1 having count(*) >= (select greatest(2, cast(floor(0.3 * count(distinct item_id)) as int)) from w))
select item_id, word from w where word not in (select word from c)""",
    ),
    "shingle_matches": (
        matched,
        """with t as (select item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as t from benchmark),
g as (select distinct item_id, substr(t, cast(i as int), 4) as x from (select item_id, t, unnest(range(1, length(t) - 2)) as i from t)),
n as (select item_id, count(*) as n from g group by 1),
p as (select a.item_id as new_id, b.item_id as old_id, count(*) / (na.n + nb.n - count(*)) as score from g a join g b on a.x = b.x and a.item_id % 2 = 1 and b.item_id % 2 = 0
  join n na on na.item_id = a.item_id join n nb on nb.item_id = b.item_id group by a.item_id, b.item_id, na.n, nb.n)
select new_id, old_id, round(score, 6) as score from (select *, row_number() over (partition by new_id order by score desc, old_id) as rn from p where score >= 0.05) where rn = 1""",
    ),
    "fixed_chunks": (
        chunks,
        """select doc_id, cast(i as int) as i, md5(c) as digest from (select doc_id, i, trim(substr(text, cast(i * 448 + 1 as bigint), 512), ' ') as c
  from (select doc_id, text, unnest(range(0, (length(text) + 447) // 448)) as i from documents)) where c <> ''""",
    ),
    "validation_warnings": (
        checked,
        """select doc_id, array_to_string(list_filter([case when length(text) < 200 then 'too_short' end,
  case when regexp_matches(lower(text), 'captcha|verify you are human|robot check|please enable javascript|enable cookies|checking your browser') then 'captcha' end,
  case when doc_id % 900 > 0 and (length(text) / (doc_id % 900) < 0.30 or length(text) / (doc_id % 900) > 3.00) then 'size_change' end], lambda x: x is not null), ',') as warnings,
  length(text) < 500 or contains(lower(text), 'nicht') as stub from documents""",
    ),
    "page_ids": (
        url_ids,
        """select page_id, case when regexp_full_match(u, '[A-Z][0-9]{3,6}') then u else 'X' || upper(substr(sha256(url), 1, 5)) end as id
from (select page_id, url, upper(regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1)) as u from pages)""",
    ),
    "probe_signals": (
        signals,
        """select o_orderkey, case when o_orderkey % 7 = 0 then 'unknown' when o_custkey % 5 <> o_orderkey % 5 then 'changed' else 'unchanged' end as signal from orders""",
    ),
    "feed_changes": (
        feeds,
        """select event_id, case when event_id % 3 = 0 then 'new' else 'mutated' end as change from events where event_id % 5 <> 0 and (event_id % 3 = 0 or event_id % 4 = 0)""",
    ),
    "sitemap_changes": (
        sitemap,
        """select o_orderkey, case when o_orderkey % 4 = 0 then 'new' when o_orderkey % 5 = 0 then 'deleted' when o_orderkey % 3 = 0 then 'updated' else 'same' end as change
from orders where o_orderkey % 4 <> 0 or o_orderkey % 5 <> 0""",
    ),
    "upsert": (
        merged,
        """with n as (select c_custkey * 2 as c_custkey from customer where c_custkey % 3 = 0)
select c_custkey, c_acctbal from customer where c_custkey not in (select c_custkey from n) union all select c_custkey, 0.0 from n""",
    ),
    "backfill": (filled, "select o_custkey, min(o_orderkey) as o_orderkey from orders where o_custkey % 2 <> 0 group by 1"),
    "edge_weights": (edge_weights, "select l_suppkey as source, l_partkey as target, l_returnflag as edge_type, max(l_quantity) as weight from lineitem group by all"),
    "line_positions": (
        positional,
        """with p as (select a.conv_id, a.turn, a.text as x, b.text as y from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1),
a as (select conv_id, turn, unnest(string_split(x, chr(10))) as t, unnest(range(0, len(string_split(x, chr(10))))) as i from p),
b as (select conv_id, turn, unnest(string_split(y, chr(10))) as t, unnest(range(0, len(string_split(y, chr(10))))) as i from p)
select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.turn, b.turn) as turn, cast(coalesce(a.i, b.i) + 1 as int) as line from a full join b on a.conv_id = b.conv_id and a.turn = b.turn and a.i = b.i where a.t is distinct from b.t""",
    ),
    "unified_diffs": (diffs, None),
    "fingerprints": (prints, None),
    "trigger_bundles": (
        bundled,
        "select l_partkey as page_id, max(l_quantity) as relevance, max(l_discount) as semantic, max(l_tax) as rerank, count(*) as n from lineitem group by 1",
    ),
    "assessment_validity": (
        replies,
        """select doc_id, quality = 1 and (toxic = 1 or doc_id % 3 <= 1) as valid, case when quality = 1 and toxic = 1 then 1 else 0 end as n from labels""",
    ),
    "html_text": (html, None),
    "kmeans_clusters": (grouped, None),
    "pca_projection": (lambda s, d: ml.projected(table(s, d, "embeddings"), "vec_id", "embedding", 2), None),
    "adhoc_select": (adhoc, "select o_orderpriority, count(*) as n from orders group by 1"),
    "rollup_lines": (cubed, "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by rollup (l_returnflag, l_linestatus)"),
    "nation_revenue": (
        revenue,
        """select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join supplier on l_suppkey = s_suppkey
join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""",
    ),
}

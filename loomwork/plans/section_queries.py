"""Sections, phrases, line differences, keyphrases and the deferred queue with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import keyphrases as P
from ..operators import line_diff as L
from ..operators import sections as S
from ..sources import queue as Q
from ..sources.tables import table


def docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def found_headings(s, d):
    """Documents with a line for each sentence; short ones look like titles."""
    sentences = F.regexp_replace(F.regexp_replace("text", r"[.!] ", "\n "), r"\? ", "?\n")
    return S.headings(docs(s, d).withColumn("text", sentences), "doc_id", "text")


def page_xml(s, d):
    """Pages whose headings are ``head`` elements, as extractors write them."""
    head = F.regexp_replace("html", r"(?s)<h([1-6])>(.*?)</h[1-6]>", '<head rend="h$1">$2</head>')
    return table(s, d, "pages").select("page_id", head.alias("xml"))


def xml_headings(s, d):
    return S.xml_headings(page_xml(s, d), "page_id", "xml")


def starts(s, d):
    """Where the first letters of each line stand, asked for from the last line to the first, then once more."""
    line = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 12)
    asked = F.transform(line, lambda x: F.left(x, F.lit(12)))
    sections = F.transform(F.concat(F.reverse(asked), asked), lambda x: F.struct(x.alias("heading_text"), F.lit(None).cast("int").alias("heading_level")))
    rows = docs(s, d).select("doc_id", F.explode(S.anchored(F.col("text"), sections)).alias("x")).select("doc_id", "x.*")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("char_start").alias("starts"), F.sum("char_end").alias("ends"), F.max("heading_level").alias("level"))


def phrase_list(s, d):
    """The first three words of each benchmark item."""
    return table(s, d, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("phrase"))


def cleaned(s, d):
    bad = K.frequent_lines(docs(s, d), "doc_id", "text", 0.02)
    return S.cleaned(docs(s, d), "doc_id", "text", bad, phrase_list(s, d)).select("doc_id", F.sha2("text", 256).alias("digest"), "removed")


def turn_diffs(s, d):
    """Each turn of a conversation against the next, by words: one to a line."""
    words = table(s, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", " ", "\n").alias("text"))
    return L.with_next(words, "conv_id", "turn", "text").select("conv_id", "turn", L.line_diff(F.col("old"), F.col("new")).alias("edits"))


def phrase_scores(s, d):
    return P.scored_phrases(docs(s, d), "doc_id", "text", best=True).select("doc_id", "phrase", "tf", "df", F.round("score", 6).alias("score"))


def phrases(s, d):
    return P.keyphrases(docs(s, d), "doc_id", "text").select("doc_id", "rank", "phrase", F.round("score", 6).alias("score"))


NOW = "2024-01-20 00:00:00"


def deferred(s, d):
    """Events as deferred triggers; one in eleven has no readable date."""
    e = table(s, d, "events")
    data = F.concat(F.lit('{"ipfr_page_id": "B'), F.col("user_id").cast("string"), F.lit('", "triggers": [{"source_id": "S1", "graph_propagated": true}]}'))
    return e.select(
        F.col("event_id").alias("id"), F.lit("r").alias("run_id"), F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("page_id"),
        data.alias("trigger_data"), F.when(F.col("event_id") % 11 == 0, "soon").otherwise(F.col("ts").cast("string")).alias("created_at"), (F.col("event_type") == "error").alias("processed"),
    )


def queue_pending(s, d):
    done = deferred(s, d).where("id % 5 = 0").select("id")
    queue = Q.mark_processed(Q.mark_processed(deferred(s, d), done), done)
    todo = Q.pending(queue, F.lit(NOW), 7)
    return todo.select("id", "page_id", F.col("trigger_data.ipfr_page_id").alias("decoded"), F.size("trigger_data.triggers").alias("n"))


def queue_state(s, d):
    half = deferred(s, d).where("id % 2 = 0")
    queue = Q.store(Q.store(half, deferred(s, d).drop("processed")), deferred(s, d).drop("processed"))
    return Q.expire(queue, F.lit(NOW), 7).select("id", "processed")


LETTERS = r"[\p{L}\p{N}_’''-]"
BLANKS = r"^\s+|\s+$"
GRAMS = " union all ".join(
    f"select doc_id, array_to_string(w[i : i + {k - 1}], ' ') as phrase, w[i] as a, w[i + {k - 1}] as b from (select doc_id, w, unnest(range(1, len(w) - {k - 2})) as i from seg)" for k in (1, 2, 3)
)
STOP = ", ".join(f"'{w}'" for w in P.STOPWORDS)

QUERIES = {
    "heading_lines": (
        found_headings,
        f"""with r as (select doc_id, string_split(regexp_replace(regexp_replace(text, '[.!] ', chr(10) || ' ', 'g'), '\\? ', '?' || chr(10), 'g'), chr(10)) as l from documents), x as (select doc_id, unnest(l) as raw, unnest(range(1, len(l) + 1)) as i from r),
p as (select doc_id, regexp_replace(raw, '{BLANKS}', '', 'g') as h, length(regexp_extract(raw, '^\\s*')) + coalesce(sum(length(raw) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos,
  length(regexp_replace(lead(raw) over (partition by doc_id order by i), '{BLANKS}', '', 'g')) > 0 as below from x)
select doc_id, h as heading_text, cast(2 as int) as heading_level, cast(pos as bigint) as char_start, cast(pos + length(h) as bigint) as char_end from p
where below and length(h) between 3 and 80 and not h like '%.' and (regexp_matches(h, '^.{{3,80}}[?:]$') or regexp_matches(h, '^(?:[A-Z]{LETTERS}*(?:\\s+|$)){{1,8}}[?!:]?$'))""",
    ),
    "xml_headings": (
        xml_headings,
        r"""with p as (select page_id, regexp_replace(html, '<h([1-6])>(.*?)</h[1-6]>', '<head rend="h\1">\2</head>', 'gs') as x from pages),
e as (select page_id, regexp_extract_all(x, '<head\b[^>]*>.*?</head>|<p\b[^>]*>.*?</p>|<list\b[^>]*>.*?</list>', 0, 's') as l from p),
r as (select page_id, unnest(l) as e, unnest(range(1, len(l) + 1)) as i from e),
t as (select page_id, i, e, regexp_replace(regexp_replace(e, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') as h from r),
o as (select *, coalesce(sum(length(h) + 1) over (partition by page_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from t)
select page_id, h as heading_text, coalesce(try_cast(regexp_extract(e, '^<head\b[^>]*rend="h(\d)"', 1) as int), 2) as heading_level, cast(pos as bigint) as char_start, cast(pos + length(h) as bigint) as char_end from o where e like '<head%'""",
    ),
    "anchored_sections": (
        starts,
        """with recursive l as (select doc_id, text, list_transform(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 12), lambda x: x[1:12]) as h from documents),
a as (select doc_id, text, list_concat(list_reverse(h), h) as h from l where len(h) > 0),
f as (select doc_id, 0 as k, 0 as cur, cast(null as bigint) as pos from a
  union all select doc_id, k + 1, case when s > 0 then s + 11 else cur end, s from (
    select a.doc_id, k, cur, case when strpos(substr(text, cur + 1), h[k + 1]) > 0 then cur + strpos(substr(text, cur + 1), h[k + 1]) else strpos(text, h[k + 1]) end as s
    from f join a on a.doc_id = f.doc_id and k < len(h)))
select doc_id, count(*) as n, cast(sum(pos - 1) as bigint) as starts, cast(sum(pos + 11) as bigint) as ends, cast(2 as int) as level from f where pos > 0 group by doc_id""",
    ),
    "cleaned_pages": (
        cleaned,
        rf"""with l as (select distinct doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) as line from documents),
bad as (select list(line) as bad from (select line from l where length(line) >= 3 group by 1 having count(*) >= (select greatest(2, cast(floor(0.02 * count(*)) as int)) from documents))),
p as (select list(p order by length(p) desc, p) as ps from (select distinct lower(trim(array_to_string(string_split(text, ' ')[1:3], ' '))) as p from benchmark) where p <> ''),
r as (select doc_id, length(coalesce(text, '')) as size, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: not list_contains(coalesce(bad, []), regexp_replace(x, '{BLANKS}', '', 'g'))),
  lambda x: case when regexp_replace(x, '{BLANKS}', '', 'g') = '' then x else regexp_replace(x, '{BLANKS}', '', 'g') end) as lines from documents, bad),
c as (select doc_id, size, list_filter(list_transform(lines, lambda x: case when regexp_replace(x, '{BLANKS}', '', 'g') = '' then x else
  nullif(regexp_replace(list_reduce(ps, lambda a, q: regexp_replace(a, '(?i)' || regexp_escape(q), '', 'g'), x), '{BLANKS}', '', 'g'), '') end), lambda x: x is not null) as lines from r, p),
t as (select doc_id, size, regexp_replace(regexp_replace(array_to_string(lines, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '{BLANKS}', '', 'g') as t from c)
select doc_id, sha256(t) as digest, cast(greatest(0, size - length(t)) as int) as removed from t""",
    ),
    "turn_diffs": (turn_diffs, None),
    "keyphrase_scores": (
        phrase_scores,
        rf"""with d as (select doc_id, lower(coalesce(text, '')) as t, greatest(5, least(15, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) // 80)) as n from documents),
seg as (select doc_id, list_filter(regexp_split_to_array(s, ' +'), lambda x: x <> '') as w from (select doc_id, unnest(regexp_split_to_array(t, '[^\p{{L}}\p{{N}} ]+')) as s from d)),
g as ({GRAMS}), tf as (select doc_id, phrase, count(*) as tf from g where a not in ({STOP}) and b not in ({STOP}) group by 1, 2), df as (select phrase, count(*) as df from tf group by 1),
sc as (select doc_id, phrase, tf, df, n, round(1 / (1 + tf * (ln(((select count(*) from documents) + 1) / (df + 1)) + 1)), 9) as score from tf join df using (phrase) join d using (doc_id))
select doc_id, phrase, tf, df, round(score, 6) as score from (select *, row_number() over (partition by doc_id order by score, phrase) as rk from sc) where rk <= greatest(3 * n, 10)""",
    ),
    "keyphrases": (phrases, None),
    "queue_pending": (
        queue_pending,
        f"""select event_id as id, cast(user_id as varchar) as page_id, 'B' || user_id as decoded, cast(1 as int) as n from events
where event_type <> 'error' and event_id % 5 <> 0 and (event_id % 11 = 0 or epoch_us(timestamp '{NOW}') - epoch_us(ts) <= 7 * 86400000000)""",
    ),
    "queue_state": (
        queue_state,
        f"""select event_id as id, (event_id % 2 = 0 and event_type = 'error') or (event_id % 11 <> 0 and epoch_us(timestamp '{NOW}') - epoch_us(ts) > 7 * 86400000000) as processed from events""",
    ),
}

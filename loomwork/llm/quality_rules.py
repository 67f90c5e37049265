"""Operator 8, quality rules: line-first cleaning with DataFrame functions only.

Each line is judged by three rules: navigation (several separators), boilerplate
(a fixed phrase) and punctuation (no word ends like prose). Failing lines are
removed; a document that loses more than half of its characters is rejected,
and so is one that fails the base rules (too short, or too repetitive).

Defined results: null or empty text has no words, fails the base rules and is
not kept. Every input row gives one output row, repeated rows included; other
columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, texts, windows, words

# Phrases of page furniture, lower case.
BOILERPLATE = [
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "lorem ipsum",
    "subscribe to our newsletter",
    "click here",
    "sign in",
    "log in",
]
SYMBOLS = r"[#*$%&|<>]"
#: A line is navigation if it has this many separators or more.
SEPARATORS, MIN_SEPARATORS = r"[|»›]", 3
#: A word that ends like prose: a letter or digit, then sentence punctuation and closing marks.
SENTENCE_END = r"[\p{L}\p{N}][.!?:;…]['\")\]’”»]*( |$)"
MAX_REMOVED_PERCENT = 50


def line_verdict(line: Column) -> Column:
    """True where a line may stay."""
    navigation = F.length(F.regexp_replace(line, "[^|»›]", "")) >= MIN_SEPARATORS
    lower = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | lower.contains(phrase)
    prose = line.rlike(SENTENCE_END)
    return ~navigation & ~boilerplate & prose


def quality(docs: DataFrame, repeat_window: int = 5, max_removed_percent: int = MAX_REMOVED_PERCENT) -> DataFrame:
    """One row per document: base figures, the cleaned text and the verdict."""
    split = texts(docs).select(
        "doc_id",
        "text",
        words(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, WHITE, " ")) != "").alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", WHITE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows(F.col("w"), repeat_window, lambda s, _: F.xxhash64(s)).alias("h"),
        F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(x)).alias("line_chars"),
        F.filter("lines", line_verdict).alias("good"),
    )
    # Only texts with a window hash that occurs twice pay for sorting them.
    twice = F.size(F.array_distinct("h")) < F.size("h")
    ranked = hashed.withColumn(
        "s",
        F.when(
            twice, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        ),
    ).drop("h")
    s = F.col("s")
    at = lambda i: F.get(s, i)["h"]
    same = lambda i: F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False))
    starts = ranked.withColumn(
        "p",
        F.when(
            s.isNotNull(),
            F.sort_array(
                F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), same), lambda i: F.get(s, i)["p"])
            ),
        ).otherwise(F.array().cast("array<int>")),
    ).drop("s")
    covered = F.aggregate(
        "p",
        F.struct(F.lit(-repeat_window).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(
            p.alias("last"), (a["n"] + F.least(F.lit(repeat_window), p - a["last"])).alias("n")
        ),
        lambda a: a["n"],
    )
    kept_chars = F.aggregate("good", F.lit(0), lambda n, x: n + F.length(x))
    measured = starts.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        covered.cast("long").alias("n_repeat_words"),
        F.col("line_chars").cast("long").alias("line_chars"),
        kept_chars.cast("long").alias("kept_chars"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lost = 100 * (F.col("line_chars") - F.col("kept_chars")) > max_removed_percent * F.col("line_chars")
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def query(docs: DataFrame) -> DataFrame:
    return quality(docs).drop("clean_text")


def sql() -> str:
    """The query for DuckDB, over the view ``documents``."""
    phrases = " or ".join(f"lower(l) like '%{p}%'" for p in BOILERPLATE)
    return rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text,
    list_filter(string_split_regex(text, '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \t\n\x0B\x0C\r]+', '', 'g') <> '') as lines
  from t),
h as (
  select doc_id, text, w, lines,
    list_transform(range(0, greatest(len(w) - 4, 0)), lambda i: list_slice(w, i + 1, i + 5)) as g
  from w),
e as (select doc_id, unnest(g) as g, unnest(range(0, len(g))) as p from h),
r as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as c from e) where c > 1),
c as (
  select doc_id, sum(least(5, p - q)) as n
  from (select doc_id, p, coalesce(lag(p) over (partition by doc_id order by p), -5) as q from r) group by doc_id),
m as (
  select h.doc_id, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(text, '[ \t\n\x0B\x0C\r]+', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
    cast(coalesce(list_sum(list_transform(lines, lambda l: length(l))), 0) as bigint) as line_chars,
    cast(coalesce(list_sum(list_transform(list_filter(lines, lambda l:
      length(regexp_replace(l, '[^|»›]', '', 'g')) < {MIN_SEPARATORS} and not ({phrases})
      and regexp_matches(l, '[\p{{L}}\p{{N}}][.!?:;…][''")\]’”»]*( |$)')), lambda l: length(l))), 0) as bigint) as kept_chars
  from h left join c on c.doc_id = h.doc_id)
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
  and not (100 * (line_chars - kept_chars) > {MAX_REMOVED_PERCENT} * line_chars) as kept
from m"""

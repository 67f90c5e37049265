"""Rules of source monitoring and corpus intake as column functions and joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE

# Registry ids of Acts, and possessive endings.
ACT_ID = r"C\d{4}A\d+"
POSSESSIVE = r"('s|’s|'S|’S)$"


def rss_changed(old_id: Column, new_id: Column, old_count: Column, new_count: Column) -> Column:
    """``unknown`` without a stored state, ``changed`` if the newest item or the number of items differs."""
    known = old_id.isNotNull() | old_count.isNotNull()
    same = old_id.eqNullSafe(new_id) & old_count.eqNullSafe(new_count)
    return F.when(~known, "unknown").when(same, "unchanged").otherwise("changed")


def needs_ingestion(modified: Column, ingested: Column, force: bool = False) -> Column:
    """Pages never taken in, or changed since; times are ISO texts and compare as such."""
    return F.lit(force) | F.coalesce(F.nullif(ingested, F.lit("")).isNull(), F.lit(True)) | F.coalesce(modified > ingested, F.lit(False))


def sitemap_urls(xml: DataFrame, col: str = "xml") -> DataFrame:
    """One row for each address of a sitemap."""
    return xml.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url"))


def amending_instruments(versions: DataFrame) -> DataFrame:
    """(id, title_id, series): instruments that amend each version, the first mention of an id kept.

    Input: id, register_id, reasons: array of (affect, affected, affected_series, amended, amended_series, markdown).
    """
    own = versions.where(F.col("register_id").rlike(f"^{ACT_ID}$")).select("id", F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("register_id").alias("title_id"), F.lit("Act").alias("series"))
    reasons = versions.select("id", F.posexplode("reasons").alias("a", "r")).where("r.affect = 'Amend'")
    nothing = F.col("r.affected").isNull() & F.col("r.amended").isNull()
    found = F.array(
        F.struct(F.col("r.affected").alias("title_id"), F.coalesce("r.affected_series", F.lit("")).alias("series")),
        F.struct(F.col("r.amended").alias("title_id"), F.coalesce("r.amended_series", F.lit("")).alias("series")),
        F.struct(F.when(nothing, F.nullif(F.regexp_extract("r.markdown", rf"\b({ACT_ID})\b", 1), F.lit(""))).alias("title_id"), F.lit("").alias("series")),
    )
    rows = reasons.select("id", (F.col("a") + 1).alias("a"), F.posexplode(found).alias("b", "x")).select("id", "a", "b", "x.title_id", "x.series")
    every = own.unionByName(rows).where("title_id is not null and title_id <> ''")
    first = F.row_number().over(Window.partitionBy("id", "title_id").orderBy("a", "b"))
    return every.withColumn("n", first).where("n = 1").select("id", "title_id", "series")


def first_text(*options: Column) -> Column:
    """The first option that has any text."""
    return F.coalesce(*[F.when(F.length(F.trim(x)) > 0, x) for x in options])


def enough_words(text: Column, least: int = 100) -> Column:
    """The text if it has so many words."""
    return F.when(F.size(F.split(F.trim(text), r"\s+")) >= least, text)


def canonical_entity(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Single blanks, no possessive ending, and the canonical name of an alias."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    out = F.rtrim(F.regexp_replace(out, POSSESSIVE, ""))
    if not aliases:
        return out
    pairs = [F.lit(x) for k, v in aliases.items() for x in (k.strip().lower(), v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(out)), out)


def valid_phrase(phrase: Column, shortest: int, blocked: list[str], stopwords: list[str]) -> Column:
    """Long enough, not blocked, and not a single stop word or number."""
    bare = F.trim(phrase)
    single = ~bare.rlike(r"\s")
    bad = single & (F.lower(bare).isin(stopwords) | bare.rlike(r"^\d+$"))
    return (F.length(bare) >= shortest) & (F.length(bare) > 0) & ~F.lower(bare).isin(blocked) & ~bad


# What gives away addresses and code words among entities.
URLISH, CODE = r"(?i)https?://|://|www\.|\.(?:gov|com|org|net|edu)\b", r"[A-Za-z]\d{2,}"


def valid_entity(text: Column, kind: Column, kinds: list[str], shortest: int = 3) -> Column:
    """Of a wanted kind, long enough, and no number, address or code word."""
    return kind.isin(kinds) & (F.length(text) >= shortest) & ~text.rlike(r"(?U)^\p{N}+$") & ~text.rlike(URLISH) & ~text.rlike(CODE)


def stitched(pages: DataFrame, *stages: DataFrame) -> DataFrame:
    """Pages with the scores of each stage, 0 where a stage has none. Each stage: page_id and score columns."""
    out = pages
    for stage in stages:
        out = out.join(stage, "page_id", "left").na.fill(0.0, [c for c in stage.columns if c != "page_id"])
    return out


def active_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges with an active page at both ends."""
    live = pages.where("status = 'active'").select("page_id")
    return edges.join(live.withColumnRenamed("page_id", "source"), "source", "left_semi").join(live.withColumnRenamed("page_id", "target"), "target", "left_semi")


def page_rollup(pages: DataFrame, **parts: DataFrame) -> DataFrame:
    """Pages with the number of rows of each part; parts are counted before they are joined."""
    out = pages
    for name, part in parts.items():
        out = out.join(part.groupBy("page_id").agg(F.count("*").alias(name)), "page_id", "left")
    return out.na.fill(0, list(parts))


def contains_any(query: str, *fields: Column, arrays: tuple[Column, ...] = ()) -> Column:
    """Free-text search: some field, or some element of an array, has the text in any case."""
    q = query.lower()
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(F.lower(f).contains(q), F.lit(False))
    for a in arrays:
        out = out | F.coalesce(F.exists(a, lambda x: F.lower(x).contains(q)), F.lit(False))
    return out


def next_number(ids: DataFrame, col: str) -> DataFrame:
    """One more than the largest number in the ids."""
    number = F.expr(f"try_cast(regexp_extract({col}, '([0-9]+)', 1) as bigint)")
    return ids.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def expand_json(runs: DataFrame, col: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds typed columns from JSON paths: name → (path, type)."""
    return runs.select("*", *[F.get_json_object(col, p).cast(t).alias(n) for n, (p, t) in fields.items()])


# -- chunks at natural breaks ---------------------------------------------------------

# A chunk ends, best first, behind an empty line, a sentence, white space; what may stand behind a heading.
BREAKS = [r"\n\n", rf"[.!?][\"')\]]?[{WHITE}]", r"[ \n\t]"]
BEHIND_HEADING = r"^[ \t\n\r\-–—:.]+"


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def bounds(text: Column, marks: Column, size: int, overlap: int, reach: int) -> Column:
    """[[first, end, first, end ...]]: the chunks of each section of a text, which begin where ``marks`` say.

    A section of a marked text that fits is one chunk. Else a chunk ends behind the
    last of the best breaks in the ``reach`` characters before its full size; the
    next begins at the first word in its overlap, where a word that stands across
    the overlap's edge is passed over.
    """
    reach = min(reach, size // 2)

    @F.pandas_udf("array<array<int>>")
    def cut(texts: pd.Series, begins: pd.Series) -> pd.Series:
        import re
        import unicodedata

        breaks = [re.compile(rf"(?s).*(?:{b})") for b in (BREAKS if reach > 0 else [])]
        kinds: dict[str, bool] = {}

        def letter(c: str) -> bool:
            if c not in kinds:
                kinds[c] = unicodedata.category(c)[0] in "LN"
            return kinds[c]

        def ending(t: str, start: int) -> int:
            stop = start + size
            if stop >= len(t):
                return len(t)
            low = max(start + 1, stop - reach)
            tail = t[low:stop]
            return next((low + m.end() for b in breaks if (m := b.match(tail)) and m.end()), stop)

        def word(t: str, at: int) -> int:
            if letter(t[at - 1]):
                while at < len(t) and letter(t[at]):
                    at += 1
            while at < len(t) and not letter(t[at]):
                at += 1
            return at

        def one(t: str, fits: bool) -> list[int]:
            if fits and len(t) <= size:
                return [0, len(t)]
            found, start = [], 0
            while start < len(t):
                end = ending(t, start)
                found += start, end
                onward = word(t, max(start + 1, end - overlap)) if end < len(t) else end
                start = onward if onward > start else end
            return found

        def sections(t: str, found) -> list[list[int]]:
            starts = sorted({0} | {int(a) for a in found if a is not None and a == a and 0 <= a}) if t else []
            starts = [a for a in starts if a < len(t)]
            return [[a + x for x in one(t[a:b], len(found) > 0)] for a, b in zip(starts, [*starts[1:], len(t)])]

        return pd.Series([sections(t, found) for t, found in zip(texts, begins)], dtype=object)

    return cut(text, marks)


def joined_tails(pieces: Column, least: int, most: int) -> Column:
    """Pieces (t, h) with a short one joined to the one before, under the same heading."""

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        fits = (F.length(x["t"]) < least) & last["h"].eqNullSafe(x["h"]) & (F.length(last["t"]) + 1 + F.length(x["t"]) <= most)
        longer = F.array(F.struct(F.concat(last["t"], F.lit("\n"), x["t"]).alias("t"), x["h"].alias("h")))
        return F.when((F.size(done) > 0) & fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), longer)).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(pieces, F.array().cast("array<struct<t:string,h:string>>"), step)


def without_heading(t: Column, h: Column) -> Column:
    """The chunk without its heading, if it begins with that and is more."""
    bare = stripped(F.coalesce(h, F.lit("")))
    rest = F.regexp_replace(F.substring(t, F.length(bare) + 1, F.length(t)), BEHIND_HEADING, "")
    return F.when((bare != "") & t.startswith(bare) & (rest != ""), rest).otherwise(t)


def natural_chunks(pages: DataFrame, size: int = 1400, overlap: int = 200, reach: int = 160, least: int = 200) -> DataFrame:
    """(page_id, chunk_index, chunk_text, section_heading). Input: page_id, content, sections array of (char_start, heading_text).

    Chunks do not cross sections. A page stays one row until its chunks are made,
    so nothing is shuffled; Python tells where chunks begin and end.
    """
    marks = F.coalesce("sections", F.array().cast("array<struct<char_start:int,heading_text:string>>"))
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.coalesce("content", F.lit("")).alias("text"), marks.alias("marks"))
    rows = rows.withColumn("cuts", bounds(F.col("text"), F.col("marks.char_start"), size, overlap, reach))
    heading = lambda a: F.get(F.reverse(F.filter("marks", lambda m: m["char_start"] == a)), F.lit(0))["heading_text"]
    parts = F.transform("cuts", lambda c: F.struct(c.alias("c"), heading(c[0]).alias("h")))
    pieces = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.size(p["c"]) - 2, F.lit(2)), lambda k: F.struct(
        stripped(F.substring("text", F.get(p["c"], k) + 1, F.get(p["c"], k + 1) - F.get(p["c"], k))).alias("t"), p["h"].alias("h")
    ))))
    rows = rows.select("page_id", joined_tails(F.filter(pieces, lambda x: x["t"] != ""), least, int(size * 1.5)).alias("chunks"))
    found = rows.select("page_id", F.posexplode("chunks").alias("chunk_index", "x"))
    return found.select("page_id", "chunk_index", without_heading(F.col("x.t"), F.col("x.h")).alias("chunk_text"), F.col("x.h").alias("section_heading"))


def ingestion_summary(log: DataFrame) -> DataFrame:
    """Per run: when it began, pages by outcome, duplicates, and sums in which missing figures are 0."""
    by = lambda c, v: F.count_if(F.col(c) == v)
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return log.groupBy("run_id").agg(
        F.min("timestamp").alias("start_time"),
        F.count("*").alias("total_pages"),
        by("outcome", "ingested").alias("pages_ingested"),
        by("outcome", "skipped").alias("pages_skipped"),
        by("outcome", "stub").alias("stubs"),
        by("outcome", "error").alias("errors"),
        by("status", "duplicate").alias("duplicates"),
        total("boilerplate_bytes_stripped").alias("boilerplate_bytes"),
        total("keyphrase_count").alias("keyphrases_total"),
        total("duration_seconds").alias("total_duration"),
    )

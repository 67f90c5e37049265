"""Detecting changes: probe signals, feeds, line differences, triggers and assessments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised
from .runs import sunday_week


def compare_signals(stored: Column, current: Column) -> Column:
    """``unknown`` without a common signal, ``changed`` if one differs, else ``unchanged`` (maps of signals)."""
    common = F.array_intersect(F.map_keys(stored), F.map_keys(current))
    differs = F.exists(common, lambda k: ~F.element_at(stored, k).eqNullSafe(F.element_at(current, k)))
    return F.when(F.coalesce(F.size(common), F.lit(0)) <= 0, "unknown").when(differs, "changed").otherwise("unchanged")


def feed_changes(old: DataFrame, new: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """(key, change): items that are new, or whose payload is not what it was."""
    digest = F.sha2(F.to_json(F.struct(*sorted(payload))), 256)
    a = old.select(key, digest.alias("was"))
    b = new.select(key, digest.alias("now"))
    both = b.join(a, key, "left")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(key, F.when(F.col("was").isNull(), "new").otherwise("mutated").alias("change"))


def feed_items(xml: DataFrame, col: str = "xml") -> DataFrame:
    """One row for each item of a feed; the link stands in for a missing guid."""
    tag = lambda name: F.trim(
        F.regexp_replace(F.regexp_extract("item", rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    )
    rows = xml.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))).alias("item"))
    return rows.select(
        F.coalesce(F.nullif(tag("guid"), F.lit("")), tag("link")).alias("guid"), tag("title").alias("title"), tag("description").alias("description"), tag("link").alias("link")
    )


def unified_diff(old: Column, new: Column) -> Column:
    """A unified line difference with three lines of context, as difflib gives it without line ends."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        make = lambda x, y: "".join(
            difflib.unified_diff((x or "").splitlines(keepends=True), (y or "").splitlines(keepends=True), "previous", "current", lineterm="")
        )
        return pd.Series([make(x, y) for x, y in zip(a, b)], dtype=object)

    return diff(old, new)


def changed_lines(diff: Column) -> Column:
    """The lines of a difference that begin with + or -, without headers."""
    return F.filter(
        F.split(diff, "\n"),
        lambda x: (x.startswith("+") | x.startswith("-")) & ~x.startswith("+++") & ~x.startswith("---"),
    )


def line_changes(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line): numbers (from 1) of lines that differ by position, also where one text is shorter."""
    spread = lambda df, name: df.select(key, F.posexplode(F.split(text, "\n")).alias("i", name))
    both = spread(old, "a").join(spread(new, "b"), [key, "i"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(key, (F.col("i") + 1).alias("line"))


def bundles(triggers: DataFrame) -> DataFrame:
    """One row for each page: its triggers, largest scores and number. Input: page_id, source_id, and three scores."""
    one = F.struct("source_id", "relevance", "semantic", "rerank")
    return triggers.groupBy("page_id").agg(
        F.sort_array(F.collect_list(one)).alias("triggers"),
        F.max("relevance").alias("relevance"),
        F.max("semantic").alias("semantic"),
        F.max("rerank").alias("rerank"),
        F.count("*").alias("n"),
    )


def with_propagated(direct: DataFrame, edges: DataFrame, boosted: DataFrame) -> DataFrame:
    """Direct triggers, and one with the source page's scores for each neighbour that has a boost."""
    passed = (
        direct.join(edges.select(F.col("source").alias("page_id"), "target"), "page_id")
        .join(boosted.select(F.col("id").alias("target")), "target", "left_semi")
        .drop("page_id")
        .withColumnRenamed("target", "page_id")
    )
    return direct.withColumn("propagated", F.lit(False)).unionByName(passed.withColumn("propagated", F.lit(True)))


ASSESSMENT = "verdict string, confidence double, reasoning string, suggested_changes array<string>"


def assessments(replies: DataFrame, col: str) -> DataFrame:
    """Model replies as typed columns, with ``valid``; fences are stripped, changes only stay with CHANGE_REQUIRED."""
    raw = F.regexp_replace(F.trim(F.col(col)), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    out = replies.withColumn("a", F.from_json(raw, ASSESSMENT)).select("*", "a.*").drop("a")
    need = F.col("verdict") == "CHANGE_REQUIRED"
    valid = (
        F.col("verdict").isin("CHANGE_REQUIRED", "NO_CHANGE", "UNCERTAIN")
        & F.col("confidence").between(0, 1)
        & (F.length(F.trim("reasoning")) > 0)
        & (~need | (F.size("suggested_changes") > 0))
    )
    return out.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn(
        "suggested_changes", F.when(need, F.col("suggested_changes")).otherwise(F.array().cast("array<string>"))
    )


def feedback(messages: DataFrame, col: str, categories: list[str]) -> DataFrame:
    """``key: value`` bodies as columns; only known categories are kept."""
    field = lambda k: F.trim(F.regexp_extract(col, rf"(?im)^\s*{k}\s*:\s*(.+)$", 1))
    out = messages.select(
        "*",
        field("run_id").alias("run_id"),
        field("page_id").alias("page_id"),
        F.regexp_replace(F.lower(field("category")), r"[\s-]+", "_").alias("category"),
        field("comment").alias("comment"),
    )
    return out.where(F.col("category").isin(categories))


def feedback_shares(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Count and percentage of each category in order of the list, 0 if it never comes; other categories do not count."""
    counts = rows.agg(*[F.count_if(F.col("category") == c).alias(c) for c in categories])
    total = sum((F.col(c) for c in categories[1:]), F.col(categories[0]))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in categories])).alias("e")
    share = F.when(F.col("total") > 0, F.col("e.n") / F.col("total") * 100).otherwise(0.0)
    return counts.select(total.alias("total"), each).select("e.category", "e.n", share.alias("percent"))


def weekly_precision(rows: DataFrame, stamp: str, useful: str = "useful") -> DataFrame:
    """For each week from Sunday: useful rows, all rows of any category, and their ratio; rows without a date are left out."""
    weeks = rows.where(F.col(stamp).isNotNull()).groupBy(sunday_week(F.col(stamp)).cast("string").alias("week"))
    out = weeks.agg(F.count_if(F.col("category") == useful).alias("useful"), F.count("*").alias("total"))
    return out.withColumn("precision", F.col("useful") / F.col("total"))


# Headings of the two lists of a notification, in their order.
SECTIONS = {"CHANGE_REQUIRED": "AMENDMENT REQUIRED", "UNCERTAIN": "ITEMS REQUIRING HUMAN REVIEW"}
# What stands before the items of a feed's text, and between their parts.
NEW, MUTATED, PARTS = "[NEW ITEM]", "[MUTATED ITEM]", "\n---\n"


def routed(assessments: DataFrame) -> DataFrame:
    """(run_id, page_id, section, place): what a run's notification lists; NO_CHANGE and unknown verdicts are in none."""
    pairs = [x for i, (v, h) in enumerate(SECTIONS.items()) for x in (F.lit(v), F.struct(F.lit(h).alias("section"), F.lit(i).alias("place")))]
    found = F.element_at(F.create_map(*pairs), F.col("verdict"))
    return assessments.select("run_id", "page_id", found.alias("s")).where("s is not null").select("run_id", "page_id", "s.section", "s.place")


def notifications(assessments: DataFrame) -> DataFrame:
    """(run_id, sent, change_required, uncertain, no_change, reason): whether a run has something to send; a run without is told why."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    out = assessments.groupBy("run_id").agg(of("CHANGE_REQUIRED").alias("change_required"), of("UNCERTAIN").alias("uncertain"), of("NO_CHANGE").alias("no_change"))
    sent = F.col("change_required") + F.col("uncertain") > 0
    return out.select("run_id", sent.alias("sent"), "change_required", "uncertain", "no_change", F.when(~sent, "no_alerts").alias("reason"))


def feed_text(new: Column, mutated: Column) -> Column:
    """The text of a feed's changes: new items, then mutated ones, each title, description and content; empty parts and items are left out.

    Both are arrays of structs (title, description, content_encoded), null for none.
    """

    def block(mark: str):
        def one(x: Column) -> Column:
            parts = F.filter(F.array(x["title"], x["description"], x["content_encoded"]), lambda p: F.length(p) > 0)
            return F.when(F.size(parts) > 0, F.concat(F.lit(f"{mark}\n"), F.array_join(parts, PARTS)))

        return one

    listed = lambda items, mark: F.coalesce(F.transform(items, block(mark)), F.array().cast("array<string>"))
    blocks = F.array_compact(F.concat(listed(new, NEW), listed(mutated, MUTATED)))
    return normalised(F.array_join(blocks, "\n\n"))


def sitemap_date(text: Column) -> Column:
    """The day of a sitemap's date: ``2024-01-31``, alone or with a time; null if it is none."""
    bare = F.trim(text)
    good = bare.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}.*)?") & F.length(bare).isNotNull()
    return F.when(good, F.left(bare, F.lit(10)).try_cast("date"))


def register_date(text: Column) -> Column:
    """The day of a register's date, ``31/1/2024`` or ``31/01/24`` (69 to 99 are of the last century); null if it is none."""
    bare = F.trim(text)
    part = lambda k: F.regexp_extract(bare, r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", k)
    short = part(3).try_cast("int")
    year = F.when(F.length(part(3)) == 2, short + F.when(short >= 69, 1900).otherwise(2000)).otherwise(short)
    day = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.when(part(1) != "", day.try_cast("date"))


def sitemap_order(rows: DataFrame) -> DataFrame:
    """Rows with an id first, by id; those without behind, by address."""
    key = F.coalesce("page_id", F.lit(""))
    return rows.orderBy(key == "", F.when(key == "", F.col("url")).otherwise(key), "url")

"""Structure of page texts: headings with their places, places found again after edits, phrases removed inside lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .monitoring import stripped

# A heading has 3 to 80 characters, ends in ? or :, or is up to eight capitalised words.
SHORTEST, LONGEST = 3, 80
QUESTION_OR_COLON = r"(?s)^.{3,80}[?:]$"
TITLE_CASE = r"(?U)^(?:[A-Z][\w’'-]*(?:\s+|$)){1,8}[?!:]?$"
# Elements of a page's XML that hold text, and the level of a heading without one.
ELEMENT = r"(?s)<(head|p|list)\b([^>]*)>(.*?)</\1>"
LEVEL = 2
#: Phrases that one automaton holds; longer lists are gone through in slices.
SLICE = 100_000


def like_heading(line: Column) -> Column:
    """A short line that asks, announces or is a title; a full stop at the end makes it prose."""
    fits = F.length(line).between(SHORTEST, LONGEST) & ~line.endswith(".")
    return fits & (line.rlike(QUESTION_OR_COLON) | line.rlike(TITLE_CASE))


def headings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, heading_text, heading_level, char_start, char_end) of lines that look like headings with text below them.

    Only lengths, candidates and whether a line has text are dealt by document;
    the places are running sums over its lines. Null texts have no headings.
    """
    own = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("doc"), F.split(text_col, "\n").alias("lines"))
    lines = own.select(id_col, "doc", F.posexplode("lines").alias("i", "raw"))
    bare = lines.withColumn("line", stripped(F.col("raw")))
    small = bare.select(
        id_col,
        "doc",
        "i",
        F.when(like_heading(F.col("line")), F.col("line")).alias("heading_text"),
        (F.length("raw") + 1).alias("n"),
        (F.length("line") > 0).alias("full"),
        F.length(F.regexp_extract("raw", r"(?U)^\s*", 0)).alias("lead"),
    )
    by = Window.partitionBy("doc").orderBy("i")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = small.withColumn("char_start", before + F.col("lead")).withColumn("below", F.lead("full").over(by))
    found = placed.where(F.col("heading_text").isNotNull() & F.col("below"))
    return found.select(id_col, "heading_text", F.lit(LEVEL).alias("heading_level"), "char_start", (F.col("char_start") + F.length("heading_text")).alias("char_end"))


def xml_headings(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """The same from a page's XML: ``head`` elements with the level of ``rend="hN"``; places count the texts of all elements, a line each."""
    found = F.arrays_zip(*[F.regexp_extract_all(xml_col, F.lit(ELEMENT), F.lit(k)).alias(n) for k, n in ((1, "tag"), (2, "attrs"), (3, "inner"))])
    own = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("doc"), found.alias("found"))
    rows = own.select(id_col, "doc", F.posexplode("found").alias("i", "x"))
    text = stripped(F.regexp_replace("x.inner", r"<[^>]+>", ""))
    rows = rows.select(id_col, "doc", "i", F.col("x.tag").alias("tag"), F.col("x.attrs").alias("attrs"), text.alias("text"))
    small = rows.select(id_col, "doc", "i", F.when(F.col("tag") == "head", F.col("text")).alias("heading_text"), F.regexp_extract("attrs", r'rend="h(\d)"', 1).alias("level"), (F.length("text") + 1).alias("n"))
    by = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = small.withColumn("char_start", F.coalesce(F.sum("n").over(by), F.lit(0))).where(F.col("heading_text").isNotNull())
    level = F.coalesce(F.nullif(F.col("level"), F.lit("")).cast("int"), F.lit(LEVEL))
    return placed.select(id_col, "heading_text", level.alias("heading_level"), "char_start", (F.col("char_start") + F.length("heading_text")).alias("char_end"))


def places(text: Column, wanted: Column) -> Column:
    """Where each of the wanted strings stands: searched from the end of the one before, else from the start; -1 if nowhere.

    Linear in the text for any number of strings in order: first and last places
    of a string are looked up once, so what is missing is not searched again.
    """

    @F.pandas_udf("array<int>")
    def search(texts: pd.Series, lists: pd.Series) -> pd.Series:
        def one(t: str | None, strings) -> list[int]:
            out, cursor = [], 0
            ends: dict[str, tuple[int, int]] = {}
            for s in [] if strings is None else strings:
                if not s or not t:
                    out.append(-1)
                    continue
                if s not in ends:
                    ends[s] = t.find(s), t.rfind(s)
                first, last = ends[s]
                at = t.find(s, cursor) if cursor <= last else first
                out.append(at)
                cursor = at + len(s) if at >= 0 else cursor
            return out

        return pd.Series([one(t, x) for t, x in zip(texts, lists)])

    return search(text, wanted)


def anchored(text: Column, sections: Column) -> Column:
    """Sections (heading_text, heading_level) with char_start and char_end in ``text``; those that are gone are left out."""
    at = places(text, F.transform(sections, lambda s: F.coalesce(s["heading_text"], F.lit(""))))
    both = F.zip_with(
        sections,
        at,
        lambda s, a: F.struct(
            s["heading_text"].alias("heading_text"),
            F.coalesce(s["heading_level"], F.lit(LEVEL)).alias("heading_level"),
            a.alias("char_start"),
            (a + F.length(s["heading_text"])).alias("char_end"),
        ),
    )
    return F.filter(both, lambda s: s["char_start"] >= 0)


def without_phrases(text: Column, phrases: list[str]) -> Column:
    """The lines without the phrases (lower case, longest first), in any case: they are cut out in this order.

    An automaton finds which phrases a line has; only those are gone through, and
    again after each cut, since a cut may bring letters together. Lines are
    stripped, those left without text go; blank lines stay.
    """

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        find = ahocorasick.Automaton()
        for k, p in enumerate(phrases):
            find.add_word(p, k)
        if phrases:
            find.make_automaton()

        def low(s: str) -> str:
            lower = s.lower()
            return lower if len(lower) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)

        def cut(line: str) -> str | None:
            at = -1
            while hits := [k for _, k in find.iter(low(line)) if k > at]:
                at = min(hits)
                flat, size, pieces, start = low(line), len(phrases[at]), [], 0
                while (found := flat.find(phrases[at], start)) >= 0:
                    pieces.append(line[start:found])
                    start = found + size
                line = "".join(pieces) + line[start:]
            return line.strip() or None

        def one(t: str | None) -> str | None:
            if not t or not phrases:
                return t
            lines = ((x if not x.strip() else cut(x)) for x in t.split("\n"))
            return "\n".join(x for x in lines if x is not None)

        for batch in batches:
            yield batch.map(one)

    return clean(text)


def slices(phrases: DataFrame, phrase: str) -> Iterator[list[str]]:
    """The different phrases, trimmed and in lower case, longest first, ``SLICE`` at a time; the driver holds one slice."""
    own = phrases.select(F.lower(F.trim(phrase)).alias("p")).where("p <> ''").distinct()
    ranked = own.orderBy(F.desc(F.length("p")), "p")
    at = 0
    while some := [r.p for r in ranked.offset(at).limit(SLICE).collect()]:
        yield some
        at += SLICE
        if len(some) < SLICE:
            return


def cleaned(docs: DataFrame, id_col: str, text_col: str, frequent: DataFrame, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(id, text, removed): texts without frequent lines and phrases, at most one empty line in a row, trimmed.

    ``frequent`` are the lines that stand on a share of all documents: no more than
    the lines of an average document over that share, so they are a list in the plan.
    """
    bad = [r.line for r in frequent.select("line").collect()]
    kept = F.filter(F.split(text_col, "\n"), lambda x: ~stripped(x).isin(bad) if bad else F.lit(True))
    out = F.array_join(F.transform(kept, lambda x: F.when(stripped(x) == "", x).otherwise(stripped(x))), "\n")
    rows = docs.select(id_col, F.coalesce(F.length(text_col), F.lit(0)).alias("size"), out.alias("text"))
    for some in slices(phrases, phrase):
        rows = rows.withColumn("text", without_phrases(F.col("text"), some))
    text = stripped(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n{3,}", "\n\n"))
    return rows.select(id_col, text.alias("text"), F.greatest(F.lit(0), F.col("size") - F.length(text)).alias("removed"))

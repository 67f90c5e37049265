"""Sources of last resort: a layer answers only for what the ones before it left open, and some errors end the search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .monitoring import enough_words, stripped

# Headings that begin and end the parts of explaining texts that are wanted; longest heading; words of a full summary.
DIGEST = ([r"key\s+points"], [r"contents"])
SUMMARY = ([r"summary"], [r"progress\s+of\s+bill"])
OUTLINE = ([r"general\s+outline", r"outline"], [r"financial\s+impact(?:\s+statement)?"])
HEADING, FULL = 80, 100
# Ids of titles, ids of bills in addresses, addresses of explanatory memoranda.
TITLE_ID = r"(?U)^[A-Z]\d{4}[A-Z]\w+$"
BILL_ID = r'(?U)billhome/([^"&\s]+)'
MEMORANDUM = r"""(?i)https?://parlinfo\.aph\.gov\.au/parlInfo/search/display/display\.w3p[^\s"'<>]*legislation%2Fems%2F[^\s"'<>]+"""
#: Line ends, as Python's splitlines has them.
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
BETWEEN_TEXTS = "\n\n---\n\n"


def between_headings(text: Column, start: list[str], end: list[str], longest: int = HEADING) -> Column:
    """The lines between a heading that is wholly one of ``start`` and one of ``end`` (or the end), as one line; empty without a start.

    Patterns hold for whole stripped lines of up to ``longest`` characters, in any case.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), stripped)

    def heads(patterns: list[str]):
        whole = rf"(?iU)^(?:{'|'.join(patterns)})\z"
        return lambda x: F.length(x).between(1, longest) & x.rlike(whole)

    place = lambda some, patterns: F.array_position(F.transform(some, heads(patterns)), True).cast("int")
    until = lambda inside, stop: F.when(stop > 0, F.slice(inside, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(inside)
    joined = lambda wanted: F.array_join(F.filter(wanted, lambda x: x != ""), " ")

    def behind(all_: Column, first: Column) -> Column:
        inside = F.slice(all_, first + 1, F.size(all_))
        found = T.bound(inside, lambda i: T.bound(place(i, end), lambda stop: joined(until(i, stop))))
        return F.when(first > 0, found).otherwise("")

    return T.bound(lines, lambda all_: T.bound(place(all_, start), lambda first: behind(all_, first)))


def title_id(url: Column) -> Column:
    """The id of a title in an address: behind ``series``, else the first part that looks like one, else the first part."""
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), r";[^/]*$", "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    series = F.when((F.lower(F.get(parts, F.lit(0))) == "series"), F.get(parts, F.lit(1)))
    return F.coalesce(series, F.get(F.filter(parts, lambda x: x.rlike(TITLE_ID)), F.lit(0)), F.get(parts, F.lit(0)))


def bill_id(uri: Column) -> Column:
    """The id of a bill in an encoded address, or null."""
    plain = F.try_url_decode(F.regexp_replace(uri, r"\+", "%2B"))
    return F.nullif(F.regexp_extract(F.coalesce(plain, uri), BILL_ID, 1), F.lit(""))


def memorandum_link(html: Column) -> Column:
    """The first address of an explanatory memorandum in a page, or null."""
    return F.nullif(F.regexp_extract(html, MEMORANDUM, 0), F.lit(""))


def first_layer(rows: DataFrame, key: str) -> DataFrame:
    """(key, layer, value, errors): the lowest layer with a value that no error closes; null where none has one.

    Input: key, layer (int), value, closes (the layer from which an error ends
    the search, or null), error. One grouped aggregate whatever the number of
    layers; a key has a row or two for each.
    """
    some = F.length(F.trim("value")) > 0
    grouped = rows.groupBy(key).agg(
        F.min(F.when(some, F.struct("layer", "value"))).alias("best"),
        F.min("closes").alias("closed"),
        F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("layer", "error")))).alias("e"),
    )
    open_ = F.col("closed").isNull() | (F.col("best.layer") < F.col("closed"))
    found = F.when(open_, F.col("best"))
    return grouped.select(key, found["layer"].alias("layer"), found["value"].alias("value"), F.array_join(F.transform("e", lambda x: x["error"]), "; ").alias("errors"))


def affecting(versions: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """(id, title_id, series): instruments of the last layer, only for versions that ``found`` has nothing for.

    versions: id, start (date of the compilation, or null). items: id, pos,
    effective, begins, commences, by_title, by_series, other_title, other_series,
    by_id, affecting_id, and seen where items may share a pos. An item counts if it
    has no date or one that begins with the compilation's; the first mention of an
    id is kept, by pos and then by seen.
    """
    text = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    left = versions.join(found.select("id").distinct(), "id", "left_anti")
    rows = items.join(left.select("id", F.left("start", F.lit(10)).alias("day")), "id")
    when = text("effective", "begins", "commences")
    rows = rows.where(F.col("day").isNull() | (F.col("day") == "") | when.isNull() | when.startswith(F.col("day")))
    named = F.col("by_title").isNotNull() | F.col("by_series").isNotNull()
    title = F.when(named, F.col("by_title")).otherwise(F.col("other_title"))
    series = F.when(named, F.col("by_series")).otherwise(F.col("other_series"))
    place = ["pos", "seen"] if "seen" in items.columns else ["pos"]
    rows = rows.select("id", *place, F.coalesce(F.nullif(title, F.lit("")), text("by_id", "affecting_id")).alias("title_id"), F.coalesce(series, F.lit("")).alias("series"))
    first = F.row_number().over(Window.partitionBy("id", "title_id").orderBy(*place))
    return rows.where("title_id is not null").withColumn("n", first).where("n = 1").select("id", "title_id", "series")


def statement(attempts: DataFrame, phrases: list[str]) -> DataFrame:
    """(id, layer, value, errors): the explanatory statement, from the service, else from the site.

    attempts: id, web (boolean), kind (``ES``, else supplementary), status (null
    for a network error), content_type, text (null if it could not be read). A 404
    or a reply of JSON is a miss. The site is asked only if the service had
    nothing but misses and empty texts; a file that cannot be read ends the search.
    """
    supplement = (F.col("kind") != "ES").cast("int")
    layer = F.when(F.col("web"), 3).otherwise(1) + supplement
    json = ~F.col("web") & F.coalesce(F.lower("content_type").contains("json"), F.lit(False))
    there = F.coalesce(F.col("status") == 200, F.lit(False)) & ~json
    miss = F.coalesce(F.col("status") == 404, F.lit(False)) | (F.coalesce(F.col("status") == 200, F.lit(False)) & json)
    unreadable = there & F.col("text").isNull()
    closes = F.when(unreadable, layer + 1).when(~F.col("web") & ~there & ~miss, 3)
    where = F.when(F.col("web"), "web").otherwise("API")
    error = F.when(unreadable, F.concat(F.lit("unreadable "), where)).when(there & (F.length(F.trim("text")) == 0), F.concat(where, F.lit(": empty text")))
    error = F.coalesce(error, F.when(~there & ~miss, F.concat(where, F.lit(" "), "kind", F.lit(": status "), F.coalesce(F.col("status").cast("string"), F.lit("none")))))
    rows = attempts.select("id", layer.alias("layer"), F.when(there, T.until_heading(F.col("text"), phrases)).alias("value"), closes.alias("closes"), error.alias("error"))
    return first_layer(rows, "id")


def act_summary(acts: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, layer, value, errors) of Acts: digest, summary of 100 words, outline of the memorandum, any summary.

    acts: id, bill_uri, digest, home, memorandum: plain texts, null where there is
    none. Without a bill's address there is nothing; without its home page only the
    digest.
    """
    # Columns of their own: decoding uses each several times.
    cut = acts.select(
        F.col(id_col).alias("id"),
        bill_id(F.col("bill_uri")).alias("bill"),
        (F.length("bill_uri") > 0).alias("known"),
        (F.length("home") > 0).alias("at_home"),
        between_headings(F.col("digest"), *DIGEST).alias("d"),
        between_headings(F.col("home"), *SUMMARY).alias("s"),
        between_headings(F.col("memorandum"), *OUTLINE).alias("m"),
    )
    rows = cut.withColumns({c: T.decoded(F.col(c)) for c in ("d", "s", "m")})
    tiers = F.array(
        F.when(F.col("known") & F.col("bill").isNotNull(), F.col("d")),
        F.when(F.col("known") & F.col("at_home"), enough_words(F.col("s"), FULL)),
        F.when(F.col("known") & F.col("at_home"), F.col("m")),
        F.when(F.col("known") & F.col("at_home"), F.col("s")),
    )
    good = F.filter(F.transform(tiers, lambda t, i: F.struct((i + 1).alias("layer"), t.alias("value"))), lambda x: F.coalesce(F.length(x["value"]) > 0, F.lit(False)))
    rows = rows.select("id", "known", "at_home", F.get(good, F.lit(0)).alias("best"))
    best = F.col("best")
    error = F.when(~F.coalesce(F.col("known"), F.lit(False)), "no bill").when(~F.coalesce(F.col("at_home"), F.lit(False)), "no home page").otherwise("no summary")
    return rows.select("id", best["layer"].alias("layer"), best["value"].alias("value"), F.when(best.isNull(), error).otherwise("").alias("errors"))


def explainers(instruments: DataFrame, titles: DataFrame, acts: DataFrame, statements: DataFrame) -> DataFrame:
    """(id, text, error): the explainers of a version's instruments in order, joined; errors only where there is no text.

    instruments: id, pos, title_id, series. A missing series is looked up in
    ``titles`` (title_id, series); Acts take their text from ``acts``, all others
    from ``statements`` (both id = title_id, value, errors).
    """
    looked = titles.select("title_id", F.col("series").alias("known"))
    kind = F.coalesce(F.nullif(F.col("series"), F.lit("")), F.trim("known"))
    routed = instruments.join(looked, "title_id", "left").withColumn("act", F.coalesce(kind == "Act", F.lit(False)))
    source = acts.select(F.col("id").alias("title_id"), F.lit(True).alias("act"), "value", "errors").unionByName(
        statements.select(F.col("id").alias("title_id"), F.lit(False).alias("act"), "value", "errors")
    )
    rows = routed.join(source, ["title_id", "act"], "left")
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.length(c) > 0, F.struct("pos", F.col(c).alias("x"))))), lambda s: s["x"]), BETWEEN_TEXTS if c == "value" else "; ")
    out = rows.groupBy("id").agg(listed("value").alias("t"), listed("errors").alias("e"))
    none = F.col("t") == ""
    return out.select("id", F.nullif("t", F.lit("")).alias("text"), F.when(none, F.when(F.col("e") == "", "No explainer found.").otherwise(F.col("e"))).alias("error"))

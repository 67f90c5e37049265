"""Column functions on text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of bot checks, lower case.
CAPTCHA = ["captcha", "verify you are human", "robot check", "please enable javascript", "enable cookies", "checking your browser"]
# Strings of pages that block robots, lower case.
BLOCK = [
    "just a moment",
    "ddos protection by cloudflare",
    "checking if the site connection is secure",
    "verifying you are human",
    "enable javascript and cookies to continue",
    "please enable javascript",
    "enable cookies",
    "checking your browser",
    "captcha",
    "verify you are human",
    "robot check",
    "this site can't be reached",
    "err_http2_protocol_error",
]
# Patterns of legally meaningful text. "inforce" is what the pattern for "in force" has always matched.
FINGERPRINTS = {
    "defined_terms": r"\b([A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+){1,5})\b",
    "numerical": r"(?iU)(?:\$[\d,]+(?:\.\d+)?|\d+(?:\.\d+)?%|\b\d{1,3}(?:,\d{3})+\b|\bsection\s+\d+[\w.]*|\bs\.\s*\d+[\w.]*|\b\d+\s*(?:days?|months?|years?|weeks?)\b)",
    "dates": r"(?iU)(?:\b\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b|\b\d{4}-\d{2}-\d{2}\b|\bcommences?\b|\bcommencement\b|\binforce\b)",
    "cross_references": r"(?iU)(?:\b(?=[A-Za-z\s]++\d{4}\b)(?:the\s+)?[A-Z][A-Za-z\s]+(?:Act|Regulation|Regulations|Rules|Code|Ordinance|Determination)\s+\d{4}\b|\bAct\s+No\b|\bsee\s+(?:also\s+)?section\b|\bpursuant\s+to\b|\bas\s+amended\s+by\b)",
    "modal_verbs": r"(?iU)\b(must|shall|may\s+not|must\s+not|should|ought\s+to)\b",
}
# How a reference with a year ends, and the references without one.
REFERENCE_END = r"(?iU)(?:Act|Regulations?|Rules|Code|Ordinance|Determination)\s+\d{4}\b"
SHORT_REFERENCES = r"(?iU)(?:\bAct\s+No\b|\bsee\s+(?:also\s+)?section\b|\bpursuant\s+to\b|\bas\s+amended\s+by\b)"

#: What Unicode has as white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once; written into an expression at several places, it is made at each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case words of a-z and 0-9 only; a word with any other letter is none, as with Unicode word edges."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike("^[a-z0-9]+$"))


def normal_space(text: Column) -> Column:
    """Runs of blanks as one, at most one empty line, trimmed; patterns are tried only on texts that may have them."""
    blanks = lambda x: F.when(x.contains("  ") | x.contains("\t"), F.regexp_replace(x, "[ \t]{2,}|\t", " ")).otherwise(x)
    empty = lambda x: F.when(x.contains("\n\n\n"), F.regexp_replace(x, "\n{3,}", "\n\n")).otherwise(x)
    # The pattern's $ also stands before one of these at the end.
    odd = lambda x: x.endswith("\x85") | x.endswith("\u2028") | x.endswith("\u2029")
    trimmed = lambda x: F.when(odd(x), F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(F.trim(x, F.lit(" \t\n\x0b\f\r")))
    return bound(text, lambda x: bound(blanks(x), lambda y: bound(empty(y), trimmed)))


def nfc(text: Column) -> Column:
    """Unicode normal form C, for which Spark has no function."""
    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return compose(text)


def unescape(text: Column) -> Column:
    """HTML entities decoded."""
    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        import html

        return values.map(lambda v: None if v is None else html.unescape(v))

    return decode(text)


def normalised(text: Column) -> Column:
    """No-break blanks as blanks, composed letters, runs of blanks as one, at most one empty line, trimmed."""
    return normal_space(nfc(F.regexp_replace(text, "\u00a0", " ")))


def decoded(text: Column) -> Column:
    """Entities decoded, then ``normalised``; one step in Python for both, that plain ASCII texts without entities are not sent to."""
    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        import html
        import unicodedata

        def one(v: str | None) -> str | None:
            if v is None:
                return None
            v = html.unescape(v)
            return v if v.isascii() else unicodedata.normalize("NFC", v.replace("\u00a0", " "))

        return values.map(one)

    plain = ~text.contains("&") & (F.length(text) == F.octet_length(text))
    return normal_space(F.coalesce(compose(F.when(~plain, text)), text))


def html_text(html: Column, breaks: bool = True) -> Column:
    """Text of a page: scripts, styles and comments go, ends of blocks become line breaks, other tags go."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    if breaks:
        out = F.regexp_replace(out, r"(?i)</(p|div|li|h[1-6]|tr|article|section|ul|ol|table)>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return normal_space(out)


def fixed_chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """(index, text) of fixed-size chunks that overlap; blank ones are left out."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.struct((i / step).cast("int").alias("i"), F.trim(F.substring(text, i + 1, F.lit(size))).alias("chunk")))
    return F.filter(cut, lambda c: c["chunk"] != "")


def shingles(text: Column, size: int = 4) -> Column:
    """The distinct runs of ``size`` characters of a text in lower case with single blanks."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    starts = F.when(F.length(t) >= size, F.sequence(F.lit(1), F.length(t) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(t, i, F.lit(size))))


def fingerprint(text: Column) -> Column:
    """A struct of the distinct matches of each legally meaningful pattern.

    A reference with a year is looked for only in texts that have the end of one:
    elsewhere each word begins a search up to the next digit or mark.
    """
    found = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    parts = {n: found(p) for n, p in FINGERPRINTS.items()}
    named, short = FINGERPRINTS["cross_references"], SHORT_REFERENCES
    parts["cross_references"] = F.when(text.rlike(REFERENCE_END), found(named)).otherwise(found(short))
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def significance(found: Column) -> Column:
    """``high`` if any pattern matched, else ``standard``."""
    some = F.lit(False)
    for name in FINGERPRINTS:
        some = some | (F.size(found[name]) > 0)
    return F.when(some, "high").otherwise("standard")


def warnings(text: Column, previous_length: Column) -> Column:
    """What is wrong with fetched text: too short, a bot check, or far from the former size."""
    lower = F.lower(text)
    bot = F.lit(False)
    for phrase in CAPTCHA:
        bot = bot | lower.contains(phrase)
    ratio = F.length(text) / previous_length
    return F.array_compact(
        F.array(
            F.when(F.length(text) < 200, "too_short"),
            F.when(bot, "captcha"),
            F.when((previous_length > 0) & ((ratio < 0.30) | (ratio > 3.00)), "size_change"),
        )
    )


def is_stub(text: Column, least: int = 500, phrases: list[str] | None = None) -> Column:
    """A page without content: missing, short, or with one of the phrases."""
    lower = F.lower(text)
    out = text.isNull() | (F.length(text) < least)
    for phrase in phrases or []:
        out = out | lower.contains(phrase.lower())
    return out


def is_blocked(html: Column, short: int = 5000) -> Column:
    """A page that keeps robots out; ``access denied`` only counts on short pages or as the whole title."""
    lower = F.lower(html)
    out = F.lit(False)
    for phrase in BLOCK:
        out = out | lower.contains(phrase)
    denied = lower.contains("access denied") & ((F.length(html) < short) | html.rlike(r"(?is)<title[^>]*>\s*access\s+denied\s*</title>"))
    return out | denied


def page_id(url: Column) -> Column:
    """The last path part in upper case if it is an id like B1000, else X and five digits of the url's digest."""
    last = F.upper(F.regexp_extract(url, r"/([^/?#]+)/?(?:[?#].*)?$", 1))
    return F.when(last.rlike("^[A-Z][0-9]{3,6}$"), last).otherwise(F.concat(F.lit("X"), F.upper(F.left(F.sha2(url, 256), F.lit(5)))))


def until_heading(text: Column, phrases: list[str], longest: int = 100) -> Column:
    """The text before the first short line that has one of the phrases, trimmed; all of it if there is none."""
    lines = F.split(text, "\n")

    def stops(line: Column) -> Column:
        bare = F.lower(F.regexp_replace(line, r"^\s+|\s+$", ""))
        found = F.lit(False)
        for phrase in phrases:
            found = found | bare.contains(phrase.lower())
        return found & F.length(bare).between(1, longest)

    at = F.array_position(F.transform(lines, stops), True)
    before = F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(0)).cast("int")), "\n")
    return F.when(at > 0, F.regexp_replace(before, r"^\s+|\s+$", "")).otherwise(text)


def estimated_tokens(text: Column) -> Column:
    return tokens_of(F.length(text))


def tokens_of(letters: Column) -> Column:
    """Estimated tokens of a text of so many letters."""
    return F.greatest(F.lit(1), F.floor(letters / 4))

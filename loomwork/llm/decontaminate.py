"""Operator 2, benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units become typed placeholders that keep their value, so a
question asked again with other figures has the same template. Windows of five
template words are hashed and joined with those of the benchmark. A pair of
document and item is reported if enough of the item's windows occur, word for
word but for the slots' values, and its slots are filled consistently: a value of
the item always becomes the same value in the document, and different values
become different ones. Windows of one diagonal (document position less item
position) belong together; so do those of diagonals up to ``SHIFT`` apart, since
words that were put in or left out move what follows. Consistency is asked of
such a run as a whole, and only its own windows count for coverage.

A capitalised word that begins a sentence may be a name or not, so each text is
read in two ways: such words are words (LITERAL) or name slots (NAMED). Windows
that are mostly slots say nothing and are left out; an item that has no other
windows, or fewer words than a window, is looked for with its values (EXACT):
by windows, or by all its words in a row. Coverage is the share of the item's
distinct windows of one reading that a run has; the first reading with a run that
suffices is reported, with its fullest run.

Defined results: texts without words match nothing, as do such items; a text
shorter than an item matches no exact window of it. Rows that are equal in id
and text count once; rows of one id and different texts are one document, and
several rows of one item id with different texts count as one item. Rows without
an id match nothing. Other columns of both inputs are ignored. An empty table on either side gives an
empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, texts, windows, words

# Marks of the placeholder types, private-use characters that texts do not have.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
# Fixed value: mark of a capitalised word that begins a sentence.
FIRST = "\ue003"
# The readings of a text, bits of a mask.
LITERAL, NAMED, EXACT = READINGS = 1, 2, 4
# Units of measure, lower case.
UNITS = "kg|mg|g|km|cm|mm|m|miles?|feet|foot|inch(?:es)?|lbs?|oz|litres?|liters?|ml|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|mph|kmh"

WINDOW, MIN_COVERAGE = 5, 0.5
#: Words between diagonals that still belong together.
SHIFT = 10
#: Benchmark windows, and ids of documents found, up to this count are broadcast (16 bytes each); more are joined by a shuffle.
MAX_BROADCAST_WINDOWS = 2_000_000
#: Parts that a hash is dealt to where the benchmark's windows are joined by a shuffle.
SALTS = 32


def marked(text: Column) -> Column:
    """The text with each slot value behind its type's mark, lower-cased, without punctuation."""
    # Steps that change nothing in a text without such characters are left out for it.
    own = text.contains(NUMBER) | text.contains(NAME) | text.contains(UNIT) | text.contains(FIRST)
    out = F.when(own, F.regexp_replace(text, "[\ue000-\ue003]", "")).otherwise(text)
    # Patterns look for the rare letter or digit before they look back, so that most places fail at their first test.
    # A name: a capitalised word that does not begin a sentence.
    out = F.regexp_replace(out, r"(?=\p{Lu})(?<=[\p{Ll}\p{N},;:] )(\p{Lu}\p{Ll}+)", NAME + "$1")
    # A sign of currency before a number goes with the punctuation.
    numbers = F.regexp_replace(out, r"([0-9](?<![\p{L}\p{N}][0-9])[0-9.,:/]*)", NUMBER + "$1")
    units = F.regexp_replace(numbers, rf"(?i)({NUMBER}\S*[ \t-\r])({UNITS})(?![\p{{L}}\p{{N}}])", "$1" + UNIT + "$2")
    out = F.when(text.rlike("[0-9]"), units).otherwise(out)
    out = F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}\ue000-\ue002 \t-\r]+", "")
    # What is left of the capitalised words; last, so that it changes none of the other slots.
    return F.lower(F.regexp_replace(out, r"(?=\p{Lu}\p{Ll})(?<![^ \t-\r])", FIRST))


def read_as(text: Column, reading: int) -> Column:
    """A marked text in one reading; the exact one has no marks."""
    if reading == EXACT:
        return F.translate(text, NUMBER + NAME + UNIT + FIRST, "")
    return F.translate(text, FIRST, NAME if reading == NAMED else "")


def template(text: Column) -> Column:
    """A marked text without the slots' values."""
    return F.regexp_replace(text, "([\ue000-\ue002])[^ \t-\r]*", "$1")


def is_slot(word: Column) -> Column:
    return word.rlike("^[\ue000-\ue002]")


def word_hashes(tokens: Column) -> Column:
    """A window's hash is made of its words' hashes, so that each word is hashed once and not in each of its windows."""
    return F.transform(tokens, lambda w: F.xxhash64(w))


def template_windows(raw: Column, h: Column, size: int, reading: int) -> Column:
    """(reading, n, hash, pos, raw) of each window that is not mostly slots; ``h`` has the hashes of the template's words."""
    every = windows(h, size, lambda s, i: F.struct(
        F.lit(reading).alias("reading"), F.lit(size).alias("n"), F.xxhash64(s).alias("hash"), i.alias("pos"), F.slice(raw, i + 1, size).alias("raw")
    ))
    return F.filter(every, lambda x: 2 * F.size(F.filter(x["raw"], is_slot)) <= size)


def exact_windows(n: Column) -> Column:
    """(reading, n, hash, pos, raw) of each window of n words of ``plain``, whose hashes are ``plain_h``."""
    return windows(F.col("plain_h"), n, lambda s, i: F.struct(
        F.lit(EXACT).alias("reading"), n.alias("n"), F.xxhash64(s).alias("hash"), i.alias("pos"), F.slice("plain", i + 1, n).alias("raw")
    ))


def both_readings(rows: DataFrame, size: int) -> DataFrame:
    """(..., literal, named, plain, plain_h): the template windows of a marked text ``m``, read in both ways, and its words with their hashes."""
    for name, reading in (("literal", LITERAL), ("named", NAMED)):
        rows = rows.withColumn("raw", words(read_as(F.col("m"), reading))).withColumn("h", word_hashes(F.transform("raw", template)))
        rows = rows.withColumn(name, template_windows(F.col("raw"), F.col("h"), size, reading)).drop("raw", "h")
    return rows.withColumn("plain", words(read_as(F.col("m"), EXACT))).withColumn("plain_h", word_hashes(F.col("plain")))


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, reading, n, hash, i_pos, i_raw): the benchmark's windows of n words with their slots' values."""
    items = benchmark.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    toks = both_readings(items.select("item_id", marked(F.col("text")).alias("m")), size)
    exact = exact_windows(F.least(F.lit(size), F.size("plain")))
    exact = F.when((F.size("literal") == 0) & (F.size("plain") > 0), exact).otherwise(F.slice("literal", 1, 0))
    rows = toks.select("item_id", F.explode_outer(F.concat("literal", "named", exact)).alias("x")).where("x is not null")
    return rows.select("item_id", "x.reading", "x.n", "x.hash", F.col("x.pos").alias("i_pos"), F.col("x.raw").alias("i_raw"))


def doc_hashes(docs: DataFrame, size: int, lengths: list[int]) -> DataFrame:
    """(doc_id, hash, mask): the windows of each text, repeats included, and the readings that have them.

    Exact windows are of the given lengths only, those that the benchmark asks for.
    """
    # Columns of their own: written as one expression, each window would make them again.
    rows = texts(docs).where("doc_id is not null").select("doc_id", marked(F.col("text")).alias("m"))
    rows = rows.withColumns({"plain": word_hashes(words(read_as(F.col("m"), EXACT)))} if lengths else {}).withColumn("t", words(template(F.col("m"))))
    first = lambda w: w.startswith(FIRST)
    rows = rows.withColumn("literal", F.transform("t", lambda w: F.when(first(w), F.xxhash64(F.substring(w, 2, 1 << 30))).otherwise(F.xxhash64(w))))
    rows = rows.withColumn("named", F.zip_with("t", "literal", lambda w, h: F.when(first(w), F.xxhash64(F.lit(NAME))).otherwise(h))).drop("t", "m")
    # A row for each start and way of reading, not lambdas over arrays: Spark compiles what is made of rows.
    # Ways: 0 literal, 1 named where it differs, then the exact lengths. Outer, since a plain explode makes the arrays twice.
    ways = 2 + len(lengths)
    longest = F.greatest(F.size("literal"), F.size("plain")) if lengths else F.size("literal")
    places = F.when(longest > 0, F.sequence(F.lit(0), longest * ways - 1))
    rows = rows.select("*", F.explode_outer(places).alias("at")).where("at is not null")
    rows = rows.withColumns({"start": F.expr(f"cast(at div {ways} as int)"), "way": F.col("at") % ways})
    start, way = F.col("start"), F.col("way")
    gram = lambda hashes, n: F.xxhash64(*[F.get(hashes, start + k) for k in range(n)])
    differ = functools.reduce(lambda a, b: a | b, [F.get("literal", start + k) != F.get("named", start + k) for k in range(size)])
    asked = (start + size <= F.size("literal")) & ((way == 0) | (way == 1) & differ)
    hashed = F.when(way == 0, gram("literal", size)).otherwise(gram("named", size))
    mask = F.when(way == 1, NAMED).when(differ, LITERAL).otherwise(LITERAL | NAMED)
    for k, n in enumerate(lengths, 2):
        asked = F.when(way == k, start + n <= F.size("plain")).otherwise(asked)
        hashed = F.when(way == k, gram("plain", n)).otherwise(hashed)
        mask = F.when(way == k, EXACT).otherwise(mask)
    return rows.where(asked).select("doc_id", hashed.alias("hash"), mask.alias("mask"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_slots, n_changed for each contaminated pair."""
    known = item_windows(benchmark, window)
    sizes = known.groupBy("item_id", "reading").agg(F.countDistinct("hash").alias("n_item"))
    keys = known.groupBy("hash", "item_id").agg(F.bit_or("reading").alias("asked"))
    lengths = sorted(r.n for r in known.where(F.col("reading") == EXACT).select("n").distinct().collect())
    rows = doc_hashes(docs, window, lengths)
    few = keys.count() <= MAX_BROADCAST_WINDOWS
    if few:
        rows = rows.join(F.broadcast(keys.select("hash").distinct()), "hash", "left_semi")
    # A window that a document repeats counts once, and meets the items that have it once.
    rows = rows.groupBy("doc_id", "hash").agg(F.bit_or("mask").alias("mask"))
    if few:
        joined = rows.join(F.broadcast(keys), "hash")
    else:  # a window that many documents share is dealt to several tasks
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    distinct = joined.select("doc_id", "item_id", F.col("mask").bitwiseAND(F.col("asked")).alias("mask")).where("mask != 0")
    counts = distinct.groupBy("doc_id", "item_id").agg(*[F.count_if(F.col("mask").bitwiseAND(r) != 0).alias(f"n{r}") for r in READINGS])
    by_reading = F.array(*[F.struct(F.lit(r).alias("reading"), F.col(f"n{r}").alias("n_windows")) for r in READINGS])
    pairs = (
        counts.select("doc_id", "item_id", F.inline(by_reading))
        .where("n_windows > 0")
        .join(sizes, ["item_id", "reading"])
        .withColumn("coverage", F.col("n_windows") / F.col("n_item"))
        .where(F.col("coverage") >= min_coverage)
    )
    # Few rows, used several times below: without the cut, each use would scan the documents again.
    pairs = cut(pairs)
    checked = compared(docs, pairs, known, window, lengths).join(sizes, ["item_id", "reading"])
    checked = checked.withColumn("coverage", F.col("n_windows") / F.col("n_item")).where((F.col("coverage") >= min_coverage) & F.col("consistent"))
    # The first reading that suffices, and its fullest run.
    best = F.min(F.struct("reading", (-F.col("n_windows")).alias("fewer"), "n_changed", "n_windows", "coverage", "n_slots")).alias("x")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.n_windows", "x.coverage", "x.n_slots", "x.n_changed")


def compared(docs: DataFrame, pairs: DataFrame, known: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """doc_id, item_id, reading, n_windows, n_slots, n_changed, consistent of each run of neighbouring diagonals: windows word for word, and how slots are filled.

    Only documents of a pair are read again, for the words of their windows.
    """
    ids = pairs.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_WINDOWS else ids
    chosen = texts(docs).join(ids, "doc_id", "left_semi")
    toks = both_readings(chosen.select("doc_id", marked(F.col("text")).alias("m")), window)
    exact = [exact_windows(F.lit(n)) for n in lengths]
    bare = lambda raw: F.transform(raw, template)
    rows = (
        toks.select("doc_id", F.explode_outer(F.concat("literal", "named", *exact)).alias("x"))
        .select("doc_id", "x.reading", "x.hash", "x.pos", F.col("x.raw").alias("d_raw"))
        .join(known.select("hash", "reading").distinct(), ["hash", "reading"], "left_semi")
        .join(known, ["hash", "reading"])
        .join(pairs.select("doc_id", "item_id", "reading"), ["doc_id", "item_id", "reading"], "left_semi")
        .where(bare(F.col("i_raw")) == bare(F.col("d_raw")))
        .withColumn("diagonal", F.col("pos") - F.col("i_pos"))
    )
    pair = ["doc_id", "item_id", "reading"]
    along = Window.partitionBy(*pair).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT, F.lit(False)).cast("int")
    rows = rows.withColumn("apart", apart).withColumn("run", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    rows = cut(rows.select(*pair, "run", "hash", "i_pos", "i_raw", "d_raw"))
    run = [*pair, "run"]
    # Values side by side, one row for each slot of the item and value in the document.
    values = (
        rows.select(*run, "i_pos", F.posexplode(F.arrays_zip("i_raw", "d_raw")).alias("k", "v"))
        .where(is_slot(F.col("v.i_raw")))
        .select(*run, (F.col("i_pos") + F.col("k")).alias("slot"), F.col("v.i_raw").alias("a"), F.col("v.d_raw").alias("b"))
        .distinct()
    )
    # One value of the document for each value of the item, and the other way round.
    filled = values.groupBy(*run).agg(
        F.count_distinct("slot").alias("n_slots"),
        F.count_distinct("a").alias("n_a"),
        F.count_distinct("b").alias("n_b"),
        F.count_distinct("a", "b").alias("n_ab"),
        F.count_distinct(F.when(F.col("a") != F.col("b"), F.struct("a", "b"))).alias("n_changed"),
    )
    one_to_one = (F.col("n_ab") == F.col("n_a")) & (F.col("n_ab") == F.col("n_b"))
    windows_of = rows.groupBy(*run).agg(F.countDistinct("hash").alias("n_windows"))
    return windows_of.join(filled, run, "left").select(
        *pair, "n_windows", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"), F.coalesce(one_to_one, F.lit(True)).alias("consistent")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a contaminated pair, all columns kept."""
    bad = contamination(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark)

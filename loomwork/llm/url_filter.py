"""Operator 7, URL filters: host and path rules first, boosted trees for the rest.

The trees are ``pyspark.ml`` gradient-boosted trees on lexical features (length,
depth, digit ratio, entropy, parameter counts, suffix statistics), trained from
labelled URLs. The features are column expressions and the fitted model scores
rows in the JVM, so no Python runs on the executors.

``fit`` takes any labelled table. The query has none but the pages, so a bounded
sample of them (``MAX_TRAINING_ROWS``, by a hash of the url) is labelled: 1 where
a word of the host is one of ``TERMS``, else 0. The trees see no words, only
lexical figures, so they carry what such hosts look like over to words that no
list has. Block rules are no labels: they follow sites and languages, which say
nothing of other urls. Pages whose hash leaves 0 modulo ``HOLD_OUT`` are never
learned from; ``held_out_figures`` measures the trees on them, and with ``hide``
on hosts with terms that were taken out of both list and training.

Defined results: a null url or one without ``://`` has an empty host and path,
matches no rule, and is judged by the trees (its features are those of an empty
text). Every input row gives one output row,
repeated rows included; other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

# Rule text and verdict.
RULES = {
    "com/en/": "block",
    "example.com/en/7": "allow",
    "net/de/": "allow",
    "example.net/de/8": "block",
    "org/es/": "block",
}

#: Words of hosts that labels are made from: bets, adult sites, pills, spam, advertising and tracking.
TERMS = [
    *("bet", "bets", "betting", "casino", "jackpot", "lottery", "poker", "slots"),
    *("adult", "escort", "porn", "sex", "xxx"),
    *("cialis", "pharma", "pills", "viagra"),
    *("clickbait", "phishing", "spam", "warez"),
    *("ads", "adserver", "popups", "track", "tracker", "tracking"),
]
FEATURES = [
    "f_length",
    "f_host_length",
    "f_depth",
    "f_labels",
    "f_digits",
    "f_hyphens",
    "f_params",
    "f_entropy",
    "f_vowels",
    "f_suffix_rate",
]
#: Rows of labelled URLs that the trees are fitted on at most; more are sampled down.
MAX_TRAINING_ROWS, HOLD_OUT = 20_000, 5


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both empty where the url is null or has no ``://``."""
    rest = F.when(F.col(url).contains("://"), F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (
        df.withColumn("rest", rest)
        .withColumn("host", ascii_lower(F.regexp_extract("rest", r"^[^/?#]*", 0)))
        .withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1))
    )


def matched_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    fits = []
    for rule in sorted(rules, key=len, reverse=True):
        domain, slash, start = rule.partition("/")
        on_host = (host == domain) | host.endswith("." + domain)
        fits.append(F.when(on_host & path.startswith(slash + start), F.lit(rule)))
    return F.coalesce(*fits)


def features(df: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds the lexical features. ``suffixes``: (suffix, rate) learned from labelled URLs."""
    letters = F.regexp_replace("host", "[^a-z0-9-]", "")
    size = F.greatest(F.length(letters), F.lit(1))
    chars = F.split(letters, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / size)
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    share = lambda pattern: F.length(F.regexp_replace("host", pattern, "")) / size
    out = (
        df.withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))
        .withColumn("f_length", F.length("rest").cast("double"))
        .withColumn("f_host_length", F.length("host").cast("double"))
        .withColumn("f_depth", F.length(F.regexp_replace("path", "[^/]", "")).cast("double"))
        .withColumn("f_labels", F.length(F.regexp_replace("host", "[^.]", "")).cast("double"))
        .withColumn("f_digits", F.length(F.regexp_replace("rest", "[^0-9]", "")) / F.greatest(F.length("rest"), F.lit(1)))
        .withColumn("f_hyphens", F.length(F.regexp_replace("host", "[^-]", "")).cast("double"))
        .withColumn("f_params", F.length(F.regexp_replace("rest", "[^=&]", "")).cast("double"))
        .withColumn("f_entropy", F.when(F.length(letters) > 0, entropy).otherwise(0.0))
        .withColumn("f_vowels", share("[^aeiou]"))
    )
    if suffixes is None:
        return out
    # One row per label of the suffix; the rates come from the bounded labelled table.
    return out.join(F.broadcast(suffixes), "suffix", "left").withColumn(
        "f_suffix_rate", F.coalesce("f_suffix_rate", F.lit(0.5))
    )


def labelled_pages(pages: DataFrame, terms: list[str] = TERMS) -> DataFrame:
    """(url, label, held_out): 1 where a word of the host is one of the terms."""
    rows = parts(pages.select("url"))
    label = F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*[F.lit(t) for t in terms]))
    return rows.select("url", label.cast("int").alias("label"), (F.pmod(F.xxhash64("url", F.lit(3)), F.lit(HOLD_OUT)) == 0).alias("held_out"))


def held_out_figures(pages: DataFrame, hide: list[str] = ()) -> DataFrame:
    """label, rows, share judged right by the trees alone, on the pages that were not learned from: all with a hidden term, or those held out."""
    labelled = labelled_pages(pages)
    hidden = labelled_pages(pages, list(hide)).where("label = 1").select("url").distinct() if hide else labelled.select("url").where("false")
    model, suffixes = fit(labelled.where("not held_out").join(hidden, "url", "left_anti"))
    unruled = {"none.invalid/": "block"}
    rows = labelled.join(hidden, "url", "left_semi") if hide else labelled.where("held_out")
    judged = judge(rows.withColumn("page_id", F.col("label")), model, suffixes, rules=unruled)
    right = ((F.col("verdict") == "block").cast("int") == F.col("page_id")).cast("int")
    return judged.groupBy(F.col("page_id").alias("label")).agg(F.count("*").alias("rows"), F.avg(right).alias("right"))


def fit(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS, trees: int = 20, depth: int = 5):
    """(model, suffix rates) from a labelled table (url, label 0/1) of at most ``max_rows`` sampled rows."""
    sample = cut(labelled.select("url", "label").orderBy(F.xxhash64("url"), "url").limit(max_rows))
    if sample.isEmpty():  # nothing to learn from: every url is allowed
        sample = labelled.sparkSession.sql("select cast(null as string) as url, 0 as label")
    rows = parts(sample)
    suffixes = (
        rows.groupBy(F.regexp_extract("host", r"[^.]*$", 0).alias("suffix"))
        .agg(F.avg(F.col("label").cast("double")).alias("f_suffix_rate"))
    )
    train = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(rows, suffixes))
    train = train.select("features", F.col("label").cast("double").alias("label")).coalesce(1)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=7, cacheNodeIds=False).fit(train)
    return model, suffixes


def judge(pages: DataFrame, model, suffixes: DataFrame, rules: dict[str, str] = RULES, limit: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score for each url."""
    rows = parts(pages.select("page_id", "url"))
    rows = rows.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(rows, suffixes)))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()])
    return scored.withColumn("score", score).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(by_rule, F.when(F.col("score") > limit, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


def query(pages: DataFrame) -> DataFrame:
    model, suffixes = fit(labelled_pages(pages).where("not held_out"))
    return judge(pages, model, suffixes)

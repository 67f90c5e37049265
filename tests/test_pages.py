"""Pages with their parts, prompts, notifications, feed texts, dates and stage tables on hand-made rows."""

import pytest
from loomwork.operators import change as C
from loomwork.operators import monitoring as M
from loomwork.operators import pages as P
from loomwork.operators import runs as R
from pyspark.sql import functions as F


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


def pages(spark, *rows):
    return spark.createDataFrame(rows, "page_id string, status string, title string")


# -- page details -----------------------------------------------------------------


def test_details_of_pages(spark):
    live = pages(spark, ("A", "active", "a"), ("B", "active", "b"), ("C", "stub", "c"))
    chunks = spark.createDataFrame([("A",), ("A",), ("C",)], "page_id string")
    entities = spark.createDataFrame([("A", "Patent Office", "ORG"), ("A", "Act", "LAW")], "page_id string, entity_text string, entity_type string")
    phrases = spark.createDataFrame([("A", f"k{n:02}", n / 100) for n in range(20)], "page_id string, keyphrase string, score double")
    edges = spark.createDataFrame([("A", t, "x", w) for t, w in (("B", 0.5), ("C", 0.9), ("gone", 1.0))] + [("A", "B", f"y{n}", 0.1) for n in range(6)], "source string, target string, edge_type string, weight double")
    log = [(n, "r", "s", f"2024-01-{n + 1:02}" if n < 28 else f"2024-02-{n - 27:02}", "CHANGE_REQUIRED" if n % 2 else "NO_CHANGE", ["A", "A", "AB"]) for n in range(55)]
    runs = spark.createDataFrame(log, "event_id long, run_id string, source_id string, ts string, verdict string, triggered array<string>")
    got = {r.page_id: r for r in P.details(live, chunks, entities, phrases, edges, runs).collect()}
    assert set(got) == {"A", "B"}
    a, b = got["A"], got["B"]
    assert (a.chunk_count, a.entity_count, b.chunk_count, b.entity_count, b.alert_count) == (2, 2, 0, 0, 0)
    assert [k.keyphrase for k in a.keyphrases] == [f"k{n:02}" for n in range(10)]
    assert [(e.entity_text, e.entity_type) for e in a.entities] == [("Act", "LAW"), ("Patent Office", "ORG")]
    assert [(n.neighbour, n.weight) for n in a.neighbours] == [("C", 0.9), ("B", 0.5), ("B", 0.1), ("B", 0.1), ("B", 0.1)]
    assert len(a.alerts) == 50 and a.alerts[0].ts == "2024-02-27" and a.alert_count == 25  # the page AB is another page
    assert b.keyphrases is None and b.alerts is None


def test_rows_of_pages_in_order(spark):
    sections = spark.createDataFrame([("A", "Fees", 400), ("A", "Introduction", 0), ("B", "x", 1)], "page_id string, heading_text string, char_start int")
    got = P.of_pages(sections, pages(spark, ("A", "active", "a"), ("A", "active", "a")), F.col("char_start")).collect()
    assert [r.heading_text for r in got] == ["Introduction", "Fees"]


def test_chunks_to_project(spark):
    live = spark.createDataFrame([("A", "active", "a", [1.0]), ("B", "active", None, None), ("C", "stub", "c", [1.0])], "page_id string, status string, title string, doc_embedding array<float>")
    rows = [("1", "A", 0, "x" * 300, [0.5, 0.5]), ("2", "A", 1, None, []), ("3", "B", 0, "y", None), ("4", "C", 0, "z", [1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, page_id string, chunk_index int, chunk_text string, chunk_embedding array<float>")
    got = {r.chunk_id: (r.document_title, len(r.chunk_text), r.vector) for r in P.active_chunks(chunks, live).collect()}
    assert got == {"1": ("a", 200, [0.5, 0.5]), "2": ("a", 0, [1.0]), "3": ("", 1, None)}


def test_titles_and_corpus_stats(spark):
    chunks = spark.createDataFrame([("A", 1, "late"), ("A", 0, "first"), ("B", 0, ""), ("C", 0, None)], "d string, i int, title string")
    assert {r.d: r.title for r in P.document_titles(chunks, "d", "title", F.col("i")).collect()} == {"A": "first", "B": "B", "C": "C"}
    frame = spark.createDataFrame([(3, 1, "2024-01-02"), (None, None, ""), (4, 1, "2023-09-01")], "chunk_count int, cluster int, last_ingested string")
    edges = spark.createDataFrame([(1,)], "x int")
    assert tuple(P.corpus_stats(frame, edges).first()) == (3, 7, 1, "2024-01-02", 1)
    assert tuple(P.corpus_stats(frame.where("false"), edges.where("false")).first()) == (0, 0, 0, None, 0)


def test_prompt(spark):
    kind = "page_id string, triggers array<struct<source_id:string,source_url:string,source_type:string,significance:string,graph_propagated:boolean,relevance:double,semantic:double,rerank:double,diff_text:string>>"
    triggers = [("s1", "u1", "webpage", "high", False, 0.5, 0.03125, 0.25, "+ new"), ("s2", "u2", "rss", "standard", True, 0.12345, 1.0, 0.0, "d" * 7000)]
    bundles = spark.createDataFrame([("B1", triggers), ("none", [])], kind)
    own = spark.createDataFrame([("B1", "Title", " text ")], "page_id string, title string, content string")
    rows = P.prompts(bundles, own).collect()
    assert len(rows) == 1
    text = rows[0].prompt
    assert text.startswith("## IPFR Page: B1 — Title\n\n### IPFR Page Content\n\ntext\n\n---\n\n## Upstream Change(s) — 2 trigger(s) for this page\n\n### Change 1: Source `s1`\n- **URL:** u1\n")
    assert "- **Relevance scores:**\n  - Stage 4 final score: 0.5000\n  - Bi-encoder max chunk cosine: 0.0312\n  - Cross-encoder final score: 0.2500\n\n#### Change document\n```\n+ new\n```\n\n### Change 2" in text
    assert text.count("**Note:**") == 1 and "d" * 6000 + "\n... [truncated for token budget]\n```" in text and "d" * 6001 not in text
    assert rows[0].tokens == len(text) // 4 and not rows[0].too_long


# -- notifications and feeds ---------------------------------------------------------


def test_routing_of_verdicts(spark):
    rows = spark.createDataFrame([("r", "A", "CHANGE_REQUIRED"), ("r", "B", "UNCERTAIN"), ("r", "C", "NO_CHANGE"), ("q", "D", "NO_CHANGE"), ("q", "E", "odd"), ("q", "F", None)], "run_id string, page_id string, verdict string")
    assert sorted((r.page_id, r.place, r.section) for r in C.routed(rows).collect()) == [("A", 0, "AMENDMENT REQUIRED"), ("B", 1, "ITEMS REQUIRING HUMAN REVIEW")]
    got = {r.run_id: tuple(r)[1:] for r in C.notifications(rows).collect()}
    assert got == {"r": (True, 1, 1, 1, None), "q": (False, 0, 0, 1, "no_alerts")}


def test_feed_text(spark):
    item = "array<struct<title:string,description:string,content_encoded:string>>"
    rows = [([("T", "D", None), ("", None, "")], [("M", "", "C")]), (None, None), ([], [("x", None, None)])]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"id long, new {item}, mutated {item}")
    got = [r.t for r in frame.select("id", C.feed_text(F.col("new"), F.col("mutated")).alias("t")).orderBy("id").collect()]
    assert got == ["[NEW ITEM]\nT\n---\nD\n\n[MUTATED ITEM]\nM\n---\nC", "", "[MUTATED ITEM]\nx"]


@pytest.mark.parametrize(("text", "want"), [("2024-01-31", "2024-01-31"), (" 2024-01-31T10:00:00+10:00 ", "2024-01-31"), ("2024-01-31T10:00:00Z", "2024-01-31"), ("2024-02-30", None), ("31/01/2024", None), ("", None), (None, None)])
def test_sitemap_dates(spark, text, want):
    r = one(spark, C.sitemap_date, text)
    assert (r.isoformat() if r else None) == want


@pytest.mark.parametrize(("text", "want"), [("31/01/2024", "2024-01-31"), (" 1/2/2024", "2024-02-01"), ("31/01/24", "2024-01-31"), ("1/1/70", "1970-01-01"), ("31/02/2024", None), ("2024-01-31", None), ("1/1/024", None), (None, None)])
def test_register_dates(spark, text, want):
    r = one(spark, C.register_date, text)
    assert (r.isoformat() if r else None) == want


def test_sitemap_order(spark):
    rows = spark.createDataFrame([("", "b"), ("B2", "z"), (None, "a"), ("A1", "y")], "page_id string, url string")
    assert [r.url for r in C.sitemap_order(rows).collect()] == ["y", "z", "a", "b"]


def test_entities_that_count(spark):
    names = ["Patent Office", "ab", "1990", "www.x", "review33", "see a.gov", "Act 7", "²³"]
    frame = spark.createDataFrame([(n, "ORG") for n in names] + [("Person", "PERSON")], "t string, k string")
    assert [r.t for r in frame.where(M.valid_entity(F.col("t"), F.col("k"), ["ORG"])).collect()] == ["Patent Office", "Act 7"]


# -- runs -----------------------------------------------------------------------------


def runs(spark, *rows):
    return spark.createDataFrame(rows, "run_id string, source_id string, event_id long, ts string, stage_reached string, outcome string, triggered array<string>")


def test_stage_matrix_and_latest_run(spark):
    log = runs(spark, ("r1", "a", 1, "1", "stage2", "no_change", ["P", "Q"]), ("r1", "a", 2, "2", "scrape", "error", ["P"]), ("r2", "a", 3, "3", "stage6_complete", "completed", []), ("r2", "b", 4, "4", "odd", "skipped", None))
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    got = {(r.source_id, r.stage): tuple(r)[2:] for r in R.stage_matrix(sources, log).collect()}
    assert len(got) == 27 and got["a", 1] == (2, 0, 1, 0) and got["a", 2] == (1, 1, 0, 1) and got["a", 6] == (1, 0, 0, 2) and got["a", 7] == (0, 0, 0, 3)
    assert got["b", 1] == (0, 0, 0, 1) and got["c", 9] == (0, 0, 0, 0)
    assert tuple(R.latest_run(log).first()) == ("r2", "SKIPPED", 6)
    assert tuple(R.latest_run(log.where("false")).first()) == (None, "IDLE", 0)
    assert [(r.stage, r.n, r.unit) for r in R.with_pages(R.funnel(log), log).orderBy("stage").collect()][-1] == (7, 2, "pages")


def test_spans_of_time():
    assert R.span_of("30D", "2024-03-10") == ("2024-02-09", "2024-03-10")
    assert R.span_of("30D", "2024-03-10", "2024-01-01", None) == ("2024-01-01", None)
    assert R.span_of(None, "2024-03-10") == (None, None) == R.span_of("7 days", "2024-03-10")


# -- helpers ---------------------------------------------------------------------------


def test_places_over_all_rows(spark):
    from loomwork.sources.shared import numbered

    frame = spark.createDataFrame([(k * 7919 % 1000, "x") for k in range(1000)], "v long, t string").repartition(7)
    got = {r.v: r.n for r in numbered(frame, "n", F.col("v").desc()).collect()}
    assert got == {v: 999 - v for v in range(1000)}
    assert numbered(frame.where("false"), "n", F.col("v")).collect() == []


@pytest.mark.parametrize("spread", [20_000, 3])
def test_joins_with_frequent_keys(spark, monkeypatch, spread):
    from loomwork.sources import shared

    monkeypatch.setattr(shared, "SPREAD", spread)
    rows = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 7}") for k in range(100)] + [(200, None)], "id long, key string")
    totals = rows.groupBy("key").agg(F.count("*").alias("n"))
    got = {r.id: r.n for r in shared.join_spread(rows, totals, "key", "n").collect()}
    count = {r.key: r.n for r in totals.collect()}
    assert got == {r.id: count[r.key] for r in rows.collect() if r.key is not None}


def test_select_keeps_quoted_text(spark):
    from loomwork.operators import guarded_sql

    text = """/* c */ select '--x' as a, "/* y */" as b, 'it''s' as c -- tail\n;"""
    assert tuple(guarded_sql.select(spark, text).first()) == ("--x", "/* y */", "it's")
    spark.range(5).select(F.col("id").alias("a.b"), F.lit(b"xy").alias("c`d")).createOrReplaceTempView("odd_names")
    rows, n, warning = guarded_sql.answer(spark, "select * from odd_names", 2)
    assert (rows.count(), n, warning) == (2, 5, "Result truncated to 2 of 5 rows.") and rows.columns == ["a.b", "c`d"] and rows.first()[1] == "<BLOB 2 B>"
    assert guarded_sql.answer(spark, "select 1 as x")[1:] == (1, None)


def test_prompt_digests_are_those_of_whole_prompts(spark):
    fields = "page_id string, k int, source_id string, source_url string, source_type string, significance string, graph_propagated boolean, relevance double, semantic double, rerank double, diff_text string"
    one = lambda p, k, t: (p, k, None if k % 3 == 0 else f"S{k}", "u", None, "high", k % 2 == 0, 0.5, None, k / 7, t)
    rows = [one(p, k, t) for p, n in (("A", 7), ("Bé", 1), ("none", 2)) for k, t in enumerate(["x" * 7000, None, "ü\n", "", "y", "z", "w"][:n])]
    triggers = spark.createDataFrame(rows, fields).repartition(3)
    pages = spark.createDataFrame([("A", "T", " a "), ("Bé", None, None), ("C", "T", "c")], "page_id string, title string, content string")
    bundles = triggers.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("k", *[c for c in triggers.columns if c not in ("page_id", "k")]))).alias("triggers"))
    want = P.prompts(bundles, pages).select("page_id", F.md5("prompt"), "tokens", "too_long").collect()
    got = P.prompt_digests(triggers, pages, ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) == 2

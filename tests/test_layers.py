"""Fallback layers, extraction, health from JSON, stored tables and page decisions on hand-made rows."""

import random

import pytest
from loomwork.functions import text as T
from loomwork.functions import vectors as V
from loomwork.operators import health as H
from loomwork.operators import layers as L
from loomwork.operators import retrieval as R
from loomwork.sources import stores as S
from pyspark.sql import functions as F


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


# -- extraction -------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Intro\nKey Points\nFirst.\n\n  Second. \nContents\nx", "First. Second."),
        ("key\tpoints\nto the end", "to the end"),
        ("Key points of the bill\nx\nContents", ""),  # not the whole line
        ("Contents\nKEY POINTS\r\na\rb\x0bc\nContents\nKey points\nd", "a b c"),  # the first start, other line ends
        ("Key points\nContents\nx", ""),
        ("Key points" + " " * 200 + "\na", "a"),  # stripped before it is measured
        ("", ""),
        (None, ""),
    ],
)
def test_between_headings(spark, text, want):
    assert one(spark, lambda t: L.between_headings(t, *L.DIGEST), text) == want


def test_a_long_line_is_no_heading(spark):
    assert one(spark, lambda t: L.between_headings(t, [r"a+"], [r"b"]), "a" * 81 + "\nx") == ""
    assert one(spark, lambda t: L.between_headings(t, [r"a+"], [r"b"]), "a" * 80 + "\nx") == "x"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://example.org/C2004A00652/latest/text", "C2004A00652"),
        ("https://example.org/Series/F2018L00001", "F2018L00001"),
        ("https://example.org/series", "series"),
        ("https://example.org/Details/F2021B00123;x?y=/C2004A00652#z", "F2021B00123"),
        ("https://example.org/about/us", "about"),
        ("https://example.org/", None),
        ("", None),
        (None, None),
    ],
)
def test_title_ids(spark, url, want):
    assert one(spark, L.title_id, url) == want


def test_bill_ids_and_links(spark):
    assert one(spark, L.bill_id, "https://x/d.w3p;query=Id%3A%22legislation%2Fbillhome%2Fr7421%22") == "r7421"
    assert one(spark, L.bill_id, "https://x/billhome/s+1&x") == "s+1"
    assert one(spark, L.bill_id, "https://x/%zz/billhome/r1") == "r1" and one(spark, L.bill_id, "none") is None and one(spark, L.bill_id, None) is None
    link = "https://parlinfo.aph.gov.au/parlInfo/search/display/display.w3p;query=Id%3A%22legislation%2Fems%2Fr1_ems_ab%22"
    assert one(spark, L.memorandum_link, f'<a href="{link}">x</a>') == link and one(spark, L.memorandum_link, "<a>") is None


def test_decoded_texts(spark):
    assert one(spark, T.decoded, " a &amp;  bé\n\n\n\nc ") == "a & bé\n\nc"


# -- layers -----------------------------------------------------------------------


def tries(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "id long, web boolean, kind string, status int, content_type string, text string")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(False, "ES", 200, "application/msword", "Body\nFinancial impact\nx")], (1, "Body")),
        ([(False, "ES", 404, None, None), (False, "Sup", 200, "word", "S")], (2, "S")),
        ([(False, "ES", 404, None, None), (False, "Sup", 200, "Application/JSON", "{}"), (True, "ES", 404, None, None), (True, "Sup", 200, "json", "W")], (4, "W")),
        ([(False, "ES", None, None, None), (False, "Sup", 404, None, None), (True, "ES", 200, "word", "W")], (None, None)),  # a network error keeps from the site
        ([(False, "ES", 500, None, None), (False, "Sup", 200, "word", "S")], (2, "S")),
        ([(False, "ES", 200, "word", None), (False, "Sup", 200, "word", "S")], (None, None)),  # a file that cannot be read ends it
        ([(False, "ES", 200, "word", " "), (False, "Sup", 404, None, None), (True, "ES", 200, "word", "W")], (3, "W")),
    ],
)
def test_statement_layers(spark, rows, want):
    r = L.statement(tries(spark, *rows), ["financial"]).first()
    assert (r.layer, r.value) == want
    assert bool(r.errors) == any(x[2] not in (200, 404) or (x[2] == 200 and not (x[4] or "").strip()) for x in rows)


def test_act_summaries(spark):
    long = " ".join(["word"] * 100)
    page = lambda body: f"Summary\n{body}\nProgress of Bill\nx"
    rows = [
        (1, "u/billhome/r1", "Key points\nDigest &amp; more\nContents", page(long), None, (1, "Digest & more")),
        (2, "u/billhome/r1", "no marks", page(long), "Outline\nOut\nFinancial Impact", (2, long)),
        (3, "u/billhome/r1", None, page("short"), "General  Outline\nOut\nFinancial Impact Statement\nx", (3, "Out")),
        (4, "u/billhome/r1", None, page("short"), "nothing", (4, "short")),
        (5, "u/billhome/r1", None, "nothing", None, (None, None)),
        (6, None, "Key points\nDigest", page(long), None, (None, None)),
        (7, "u/other", "Key points\nDigest", page("short"), None, (4, "short")),
        (8, "u/billhome/r1", "Key points\nDigest", None, None, (1, "Digest")),
    ]
    frame = spark.createDataFrame([r[:-1] for r in rows], "id long, bill_uri string, digest string, home string, memorandum string")
    got = {r.id: r for r in L.act_summary(frame).collect()}
    assert {k: (r.layer, r.value) for k, r in got.items()} == {r[0]: r[-1] for r in rows}
    assert [got[k].errors for k in (5, 6, 1)] == ["no summary", "no bill", ""]


def test_routing_and_joined_texts(spark):
    instruments = spark.createDataFrame([(1, 0, "a", "Act"), (1, 1, "b", None), (1, 2, "c", ""), (2, 0, "d", "SR"), (3, 0, "e", "SR")], "id long, pos int, title_id string, series string")
    titles = spark.createDataFrame([("b", "Act"), ("d", "Act")], "title_id string, series string")
    acts = spark.createDataFrame([("a", "A", ""), ("b", "B", ""), ("d", "never", "")], "id string, value string, errors string")
    statements = spark.createDataFrame([("c", None, "c failed"), ("d", None, "d failed")], "id string, value string, errors string")
    got = {r.id: (r.text, r.error) for r in L.explainers(instruments, titles, acts, statements).collect()}
    assert got == {1: ("A\n\n---\n\nB", None), 2: (None, "d failed"), 3: (None, "No explainer found.")}


# -- health -----------------------------------------------------------------------


def runs(spark, *rows):
    return spark.createDataFrame(rows, "run_id string, source_id string, event_id long, ts string, outcome string, details string, triggered_pages string")


def test_conditions_of_runs(spark):
    failed = '{"stages": {"llm_assessment": {"failed": 1}, "crossencoder": {"truncation_warnings": ["a", "b"]}}}'
    log = runs(
        spark,
        *[(f"r{k}", "s1", k, f"2024-01-0{k}", "error", failed if k == 3 else "{bad", None) for k in (1, 2, 3)],
        *[(f"r{k}", s, 10 * k + n, f"2024-01-0{k}", "completed", failed if (k, s) == (3, "s2") else None, None) for k in (1, 2, 3) for n, s in enumerate(["s2", "s3", "s4"])],
        ("r4", "s1", 90, "2024-01-04", "completed", "{}", None),
    )
    states = spark.createDataFrame([("s2", '{"previous_text": "", "last_error": "e"}'), ("s3", '{"probe_signals": {}}'), ("s4", "{bad"), ("s1", '{"previous_text": "t", "consecutive_failures": 9}')], "source_id string, state string")
    got = {r.run_id: tuple(r)[1:] for r in H.conditions(log, states).collect()}
    assert got == {"r1": (False, False, False, False, True), "r2": (False, False, False, False, True), "r3": (False, True, True, True, True), "r4": (False,) * 5}
    only = runs(spark, ("r", "s", 1, "t", "error", None, None), ("r", "s2", 2, "t", "completed", None, None))
    assert H.conditions(only, states.where("false")).first().error_rate
    assert H.conditions(only.where("false"), states).collect() == []


def test_scores_from_json(spark):
    log = runs(
        spark,
        ("r", "s", 1, "t", "ok", '{"stages": {"relevance": {"top_candidates": [{"final_score": 1}, {"final_score": 2.5}, {"x": 1}, {"final_score": null}]}}}', '[{"biencoder_max_chunk_score": 0.5}, "B1012"]'),
        ("r", "s", 2, "t", "ok", "{bad", "[bad"),
        ("r", "s", 3, "t", "ok", None, '[{"biencoder_max_chunk_score": 0.7, "crossencoder_final_score": null}]'),
    )
    got = {r.label: tuple(r)[1:] for r in H.score_buckets(log).collect()}
    assert got["stage4_final_score"] == (2, 1.0, 1.375, 1.75, 2.125, 2.5)
    assert got["crossencoder_final_score"] == (0, None, None, None, None, None)
    assert got["biencoder_max_chunk_score"][0] >= 1


# -- stored tables ------------------------------------------------------------------


def test_replacing_by_page(spark, tmp_path):
    path = f"{tmp_path}/keyphrases"
    rows = lambda *r: spark.createDataFrame(list(r), "page_id string, keyphrase string, score double")
    page = lambda *p: spark.createDataFrame([(x,) for x in p], "page_id string")
    read = lambda: sorted((r.page_id, r.keyphrase) for r in S.read(spark, path).collect())
    S.replace(spark, path, page("B1012"), rows(("B1012", "trade mark", 0.1), ("B1012", "fee", 0.2)), "page_id", parts=4)
    S.replace(spark, path, page("C1", "D1"), rows(("C1", "a", 0.1), ("D1", "b", 0.1), ("other", "left out", 0.1)), "page_id", parts=4)
    assert read() == [("B1012", "fee"), ("B1012", "trade mark"), ("C1", "a"), ("D1", "b")]
    for _ in range(2):  # again after a failure
        S.replace(spark, path, page("B1012"), rows(("B1012", "single phrase", 0.1)), "page_id", parts=4)
        assert read() == [("B1012", "single phrase"), ("C1", "a"), ("D1", "b")]
    S.replace(spark, path, page("C1", "D1", "B1012"), rows(("B1012", "x", 0.1), ("B1012", "x", 0.1)), "page_id", ["page_id", "keyphrase"], parts=4)
    assert read() == [("B1012", "x")]  # pages without new rows are empty, equal rows once
    S.replace(spark, path, page(), rows(("B1012", "y", 0.1)), "page_id", parts=4)
    assert read() == [("B1012", "x")]


def test_a_run_that_is_repeated_is_logged_once(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = lambda run, *s: spark.createDataFrame([(run, x) for x in s], "run_id string, source_id string")
    S.append_run(rows("r1", "a", "b"), path)
    S.append_run(rows("r2", "a"), path)
    S.append_run(rows("r2", "a", "b", "c"), path)
    assert sorted((r.run_id, r.source_id) for r in spark.read.parquet(path).collect()) == [("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "b"), ("r2", "c")]


def test_clearing_edges_by_type(spark, tmp_path):
    path = f"{tmp_path}/edges"
    edges = spark.createDataFrame([("A", "B", "embedding_similarity", 0.7), ("A", "C", "entity_overlap", 0.5)], "source string, target string, edge_type string, weight double")
    S.overwrite(edges, path, "edge_type")
    S.clear_edges(spark, path, "embedding_similarity")
    S.clear_edges(spark, path, "none of this type")
    assert [r.edge_type for r in spark.read.parquet(path).collect()] == ["entity_overlap"]
    S.clear_edges(spark, path)
    assert not S.exists(spark, path)


def test_status_of_pages(spark):
    schema = "page_id string, status string, duplicate_of string, title string"
    pages = spark.createDataFrame([("A", "duplicate", "B", "a"), ("B", "active", None, "b"), ("C", "stub", None, "c")], schema)
    again = S.reset_duplicates(pages)
    assert {r.page_id: (r.status, r.duplicate_of) for r in again.collect()} == {"A": ("active", None), "B": ("active", None), "C": ("stub", None)}
    changes = spark.createDataFrame([("B", "duplicate", "A"), ("Z", "stub", None)], "page_id string, status string, duplicate_of string")
    assert sorted(map(tuple, S.set_status(again, changes).collect())) == [("A", "active", None, "a"), ("B", "duplicate", "A", "b"), ("C", "stub", None, "c")]


# -- page decisions in blocks ---------------------------------------------------------


def test_page_decisions(spark):
    corpus = [(1, 10, [1.0, 0.0]), (2, 20, [0.6, 0.8]), (3, 20, [0.6, 0.8]), (4, 20, [0.6, 0.8]), (5, 30, [0.0, 1.0]), (6, 30, None), (7, 30, [])]
    chunks = spark.createDataFrame(corpus, "id long, group long, v array<float>")
    changes = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, q array<float>")
    got = {r.group: (r.decision, r.above) for r in R.page_decisions(changes, chunks).collect()}
    assert got == {10: ("single_chunk_high", 1), 20: ("multi_chunk_medium", 3), 30: (None, 0)}
    some = R.page_decisions(changes, chunks, candidates=spark.createDataFrame([(20,)], "group long")).collect()
    assert [(r.group, [x.id for x in r.top]) for r in some] == [(20, [2, 3, 4])]
    assert R.page_decisions(changes, chunks.where("false")).collect() == [] and R.page_decisions(changes.where("false"), chunks).collect() == []


@pytest.mark.parametrize("sent", [64 << 20, 0])
def test_blocks_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(V, "SENT", sent)
    monkeypatch.setattr(V, "QUERIES", 4)
    random.seed(2)
    vector = lambda: [random.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(3)]
    corpus = [(k, k % 5, vector()) for k in range(60)]
    changes = [(k % 9, vector()) for k in range(20)]
    chunks = spark.createDataFrame(corpus, "id long, group long, v array<float>").repartition(3)
    queries = spark.createDataFrame(changes, "query_id long, q array<float>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {}
    for q in range(9):
        best = {k: max(dot(v, w) for i, w in changes if i == q) for k, _, v in corpus if k != q}
        for g in range(5):
            own = sorted(((-s, k) for k, s in best.items() if k % 5 == g))
            want[q, g] = (-own[0][0], sum(-s >= 0.4 for s, _ in own), [k for _, k in own[:5]])
    got = {(r.query_id, r.group): (r.best, r.above, [x.id for x in r.top]) for r in V.group_scores(queries, chunks, 0.4).collect()}
    assert got == want
    single = queries.dropDuplicates(["query_id"]).collect()
    near = V.nearest(spark.createDataFrame(single, "query_id long, q array<float>"), chunks, 7).collect()
    for r in single:
        best = sorted((-max(0.0, dot(v, r.q)), k) for k, _, v in corpus if k != r.query_id)[:7]
        assert [x.id for x in sorted((x for x in near if x.query_id == r.query_id), key=lambda x: x["rank"])] == [k for _, k in best]


def test_affecting_keeps_the_first_of_equal_places(spark, sf_dir, tmp_path):
    """Line items of one order and number in two files; Spark reads the larger one, which comes second, first."""
    import duckdb
    from loomwork.plans import layer_queries

    con = duckdb.connect()
    (tmp_path / "lineitem.parquet").mkdir()
    con.execute(f"copy (select * from '{sf_dir}/orders.parquet') to '{tmp_path}/orders.parquet'")
    con.execute(f"create view orders as select * from '{sf_dir}/orders.parquet'")
    line = f"select * replace (o_orderkey as l_orderkey, 1 as l_linenumber, {{}} as l_partkey) from (select * from '{sf_dir}/lineitem.parquet' limit 1), (select o_orderkey from orders), range({{}})"
    con.execute(f"copy ({line.format(21, 1)}) to '{tmp_path}/lineitem.parquet/a.parquet'")
    con.execute(f"copy ({line.format(61, 9)}) to '{tmp_path}/lineitem.parquet/b.parquet'")  # 61 and 21: one title, two series
    con.execute(f"create view lineitem as select l.* exclude (o_orderkey) from '{tmp_path}/lineitem.parquet/*.parquet' l")
    query, sql = layer_queries.QUERIES["affecting_instruments"]
    got = sorted(tuple(r) for r in query(spark, str(tmp_path)).select("id", "title_id", "series").collect())
    assert got == sorted(con.execute(f"select id, title_id, series from ({sql})").fetchall())
    assert len(got) == 500 and {r[2] for r in got} == {"Act"}


def test_lines_are_made_once():
    """what a text is split into was made again wherever it was used."""
    assert str(L.between_headings(F.col("t"), ["a"], ["b"])).count("split(") == 1


def test_spaces_as_patterns_have_them(spark):
    texts = [" a  b\t c ", "a\n\n\n\nb \n", "x \x85", "x   ", " x  ", "", None, "\r\n a"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.regexp_replace("t", "[ \t]+", " "), "\n{3,}", "\n\n")
    rows = frame.select(T.normal_space(F.col("t")).alias("a"), F.regexp_replace(plain, r"^\s+|\s+$", "").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]

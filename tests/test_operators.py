"""Operators on hand-made rows: golden values and odd input."""

import pytest
from loomwork.functions import text as T
from loomwork.functions import vectors as V
from loomwork.operators import change as C
from loomwork.operators import corpus as K
from loomwork.operators import graph as G
from loomwork.operators import guarded_sql
from loomwork.operators import ml
from loomwork.operators import retrieval as R
from loomwork.operators import runs as RUNS
from loomwork.sources import tables as S
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column, value="x"):
    return spark.range(1).select(F.lit(value).alias("t")).select(column(F.col("t")).alias("r")).first().r


def test_tokens(spark):
    assert one(spark, T.tokens, "Section 44; über ab_c x1") == ["section", "44", "x1"]


@pytest.mark.parametrize(("values", "ranks"), [([10, 5, 20], [2, 3, 1]), ([0, 0, 0], [1, 1, 1])])
def test_competition_rank(spark, values, ranks):
    df = frame(spark, [(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    got = R.competition_rank(df, "v", "r").orderBy("i").collect()
    assert [x.r for x in got] == ranks


def test_rank_fusion_of_one_page(spark):
    got = R.fused(frame(spark, [(1, 1.0, 1.0)], "i long, a double, b double"), "a", "b").first()
    assert got.rrf == pytest.approx(1 / 61 + 2 / 61)


def test_candidates(spark):
    df = frame(spark, [(1, 0.9), (2, 0.8), (3, 0.7), (4, 0.65), (5, 0.1)], "id long, s double")
    assert R.candidates(df, "s", "id", 2, 0.6).count() == 4
    assert R.candidates(df, "s", "id", 2, 0.6, fast_pass=True).count() == 5


def test_min_max(spark):
    df = frame(spark, [(0.0,), (0.5,), (1.0,)], "v double")
    assert sorted(r.o for r in R.min_max(df, "v", "o").collect()) == [0.0, 0.5, 1.0]
    assert {r.o for r in R.min_max(df.where("v = 0.5"), "v", "o").collect()} == {0.0}
    assert R.min_max(df.where("false"), "v", "o").collect() == []


def test_bm25_prefers_the_rarer_word_and_bears_empty_tables(spark):
    docs = frame(spark, [(1, "apple pear"), (2, "apple apple"), (3, ""), (4, None), (5, "plum kiwi fig")], "doc_id long, text string")
    query = R.query_terms(frame(spark, [(0, "plum apple")], "item_id long, text string"))
    got = {r.doc_id: r.score for r in R.bm25(docs, query).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[5] > got[1] and got[3] == got[4] == 0
    assert R.bm25(docs.where("false"), query).collect() == []


def test_every_query_scores_every_document(spark):
    docs = frame(spark, [(1, "apple pear"), (2, "apple apple"), (3, "plum kiwi fig")], "doc_id long, text string")
    asked = frame(spark, [(0, "plum"), (100, "pear pear"), (200, "")], "item_id long, text string")
    scored = R.bm25(docs, R.query_terms(asked))
    got = {(r.query_id, r.doc_id): r.score for r in scored.collect()}
    assert len(got) == 9 and {k for k, v in got.items() if v > 0} == {(0, 3), (100, 1)}
    alone = R.bm25(docs, R.query_terms(asked.where("item_id = 100"))).where("doc_id = 1").first().score
    assert got[100, 1] == pytest.approx(alone)
    ranks = {(r.query_id, r.doc_id): r.r for r in R.competition_rank(scored, "score", "r", "query_id").collect()}
    assert [ranks[q, i] for q in (0, 100, 200) for i in (1, 2, 3)] == [2, 2, 1, 1, 2, 2, 1, 1, 1]
    top = R.best(scored, "score", "doc_id", 1, "query_id").collect()
    assert {(r.query_id, r.doc_id) for r in top} == {(0, 3), (100, 1), (200, 1)}
    assert R.candidates(scored, "score", "doc_id", 1, 0.1, by="query_id").count() == 3


def test_five_numbers(spark):
    r = RUNS.five_numbers(frame(spark, [(float(i),) for i in range(1, 6)], "v double"), "v").first()
    assert (r.minimum, r.median, r.maximum) == (1, 3, 5)


def test_fixed_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(600))
    got = one(spark, T.fixed_chunks, text)
    assert len(got) == 2 and got[1].chunk == text[448:960]
    assert one(spark, T.fixed_chunks, "") == []


@pytest.mark.parametrize(
    ("edges", "want"),
    [([(1, 2, 1.0)], {2: 0.36}), ([(1, 2, 1.0), (1, 3, 1.0)], {2: 0.18, 3: 0.18})],
)
def test_propagation(spark, edges, want):
    e = frame(spark, edges, "source long, target long, weight double")
    got = {r.id: r.boost for r in G.propagate(e, frame(spark, [(1, 0.8)], "id long, score double")).collect()}
    assert got == pytest.approx(want)


def test_propagation_returns_along_cycles(spark):
    e = frame(spark, [(1, 2, 1.0), (2, 1, 1.0)], "source long, target long, weight double")
    got = {r.id: r.boost for r in G.propagate(e, frame(spark, [(1, 1.0)], "id long, score double")).collect()}
    assert got == pytest.approx({2: 0.45 + 0.45**3, 1: 0.45**2})


def scanned(pairs, length):
    """The scan itself, pair by pair."""
    into = {}
    for a in sorted({a for a, _ in pairs}):
        if a in into:
            continue
        for b in sorted(b for x, b in pairs if x == a):
            if b not in into:
                lose, keep = (a, b) if (length[b], b) > (length[a], a) else (b, a)
                into[lose] = keep
    end = lambda x: end(into[x]) if x in into else x
    return {x: end(x) for x in into}


def test_greedy_duplicates_are_those_of_the_scan(spark):
    import random

    draw = random.Random(3)
    pairs, length = set(), {}
    for part in range(12):  # groups of 12, some dense, some chains
        ids = range(100 * part, 100 * part + 12)
        length |= {i: draw.randrange(1 + part) if part % 3 else -i for i in ids}
        pairs |= {(a, b) for a in ids for b in ids if a < b and (b == a + 1 if part % 4 == 0 else draw.random() < 0.05 * part)}
    got = G.greedy_duplicates(frame(spark, sorted(pairs), "a long, b long"), frame(spark, sorted(length.items()), "id long, length long"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.duplicate_of for r in got.collect()} == scanned(pairs, length)


def test_similar_vectors_in_blocks_are_those_of_one_product(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    v = draw.standard_normal((90, 4)).astype("float32")
    v[40:60] = v[:20]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = frame(spark, [(i, [float(x) for x in v[i]]) for i in range(90)] + [(90, []), (91, None)], "id long, v array<float>")
    sim = v.astype("float64") @ v.T.astype("float64")
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if sim[a, b] >= 0.6}
    best = {(a, b) for a in range(90) for b in sorted((b for b in range(90) if b != a and sim[a, b] >= 0.6), key=lambda b: (-round(sim[a, b], 9), b))[:3]}
    for block in (None, 90, 13):
        pairs = [(r.a, r.b) for r in V.similar_pairs(df, "id", "v", 0.6, block).collect()]
        assert len(pairs) == len(want) and set(pairs) == want
        near = [(r.source, r.target) for r in V.most_similar(df, "id", "v", 3, 0.6, block).collect()]
        assert len(near) == len(best) and set(near) == best
    assert V.similar_pairs(df.where("false"), "id", "v", 0.6).collect() == V.most_similar(df.where("id > 89"), "id", "v", 3, 0.6).collect() == []


def test_similar_pairs_and_greedy_duplicates(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.999, 0.0447]), (3, [0.8, 0.6]), (4, []), (5, None)]
    df = frame(spark, rows, "id long, v array<float>")
    pairs = V.similar_pairs(df, "id", "v", 0.98)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    lengths = frame(spark, [(1, 5), (2, 9), (3, 1)], "id long, length long")
    assert [tuple(r) for r in G.greedy_duplicates(pairs, lengths).collect()] == [(1, 2)]
    # A duplicate is passed over when its turn comes; a tie keeps the larger id.
    both = frame(spark, [(1, 2), (2, 3)], "a long, b long")
    assert [tuple(r) for r in G.greedy_duplicates(both, frame(spark, [(1, 9), (2, 5), (3, 5)], "id long, length long")).collect()] == [(2, 1)]
    tie = frame(spark, [(1, 2)], "a long, b long")
    assert [tuple(r) for r in G.greedy_duplicates(tie, frame(spark, [(1, 5), (2, 5)], "id long, length long")).collect()] == [(1, 2)]
    assert [(r.a, r.b) for r in V.similar_pairs(df, "id", "v", 0.98, block=1).collect()] == [(1, 2)]


def test_vectors(spark):
    df = frame(spark, [([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.unit(F.col("a")).alias("u"), V.unit(F.col("b")).alias("z"), V.cosine(F.col("a"), F.lit(None).cast("array<double>")).alias("c")).first()
    assert r.u == [0.6, 0.8] and r.z == [0.0, 0.0] and r.c == 0.0


def test_exact_duplicates_keep_the_earliest(spark):
    df = frame(spark, [("A", "t", "2024-04-01"), ("B", "t", "2024-04-05"), ("C", "t", ""), ("D", "u", "")], "id string, text string, age string")
    got = {r.id: r.duplicate_of for r in K.exact_duplicates(df, "id", "text", F.col("age")).collect()}
    assert got == {"B": "A", "C": "A"}


def test_frequent_phrases_go(spark):
    rows = [(f"p{i}", "common") for i in range(6)] + [(f"p{i}", f"own{i}") for i in range(6)]
    df = frame(spark, rows, "page string, phrase string")
    assert K.sweep_frequent(df, "page", "phrase", 0.7).count() == 6
    assert K.sweep_frequent(df.where("page < 'p3'"), "page", "phrase", 0.7).count() == 6  # too few pages to judge


def test_strip_lines(spark):
    df = frame(spark, [(1, "menu\none"), (2, "menu\ntwo"), (3, None)], "id long, text string")
    bad = K.frequent_lines(df, "id", "text", 0.5)
    got = {r.id: (r.text, r.removed) for r in K.strip_lines(df, bad, "id", "text").collect()}
    assert got == {1: ("one", 4), 2: ("two", 4), 3: ("", 0)}


def test_signals(spark):
    m = lambda x: F.create_map(*[F.lit(v) for p in x.items() for v in p]) if x else F.create_map().cast("map<string,string>")
    ask = lambda a, b: spark.range(1).select(C.compare_signals(m(a), m(b)).alias("r")).first().r
    assert ask({"e": "1"}, {}) == "unknown" and ask({"e": "1"}, {"d": "1"}) == "unknown"
    assert ask({"e": "1"}, {"e": "1", "d": "2"}) == "unchanged" and ask({"e": "1"}, {"e": "2"}) == "changed"


def test_feed(spark):
    xml = "<rss><item><guid>a</guid><title><![CDATA[T & x]]></title></item><item><link>http://l</link><title>B</title></item></rss>"
    rows = C.feed_items(frame(spark, [(xml,)], "xml string"))
    assert [(r.guid, r.title) for r in rows.collect()] == [("a", "T & x"), ("http://l", "B")]
    old = frame(spark, [("a", "T"), ("c", "Z")], "guid string, title string")
    new = frame(spark, [("a", "U"), ("b", "V"), ("c", "Z")], "guid string, title string")
    assert {tuple(r) for r in C.feed_changes(old, new, "guid", ["title"]).collect()} == {("a", "mutated"), ("b", "new")}


def test_diff_has_glued_headers(spark):
    df = frame(spark, [("a\nb\n", "a\nc\n")], "o string, n string")
    diff = df.select(C.unified_diff(F.col("o"), F.col("n")).alias("d")).first().d
    assert diff == "--- previous+++ current@@ -1,2 +1,2 @@ a\n-b\n+c\n"
    assert one(spark, C.changed_lines, "--- x\n+++ y\n+ok\n-ok\n same\n---lost") == ["+ok", "-ok"]


def test_assessments(spark):
    rows = [
        ('```json\n{"verdict":"CHANGE_REQUIRED","confidence":0.9,"reasoning":"r","suggested_changes":["x"]}\n```', True, 1),
        ('{"verdict":"CHANGE_REQUIRED","confidence":0.9,"reasoning":"r","suggested_changes":[]}', False, 0),
        ('{"verdict":"NO_CHANGE","confidence":0.5,"reasoning":"r","suggested_changes":["x"]}', True, 0),
        ('{"verdict":"MAYBE","confidence":0.5,"reasoning":"r"}', False, 0),
        ("no json", False, 0),
    ]
    got = C.assessments(frame(spark, [(i, r[0]) for i, r in enumerate(rows)], "i int, reply string"), "reply").orderBy("i").collect()
    assert [(r.valid, len(r.suggested_changes)) for r in got] == [r[1:] for r in rows]


def test_feedback_bodies(spark):
    body = "Category: Not-Significant\nrun_id: r1\nPage_ID: p\ncomment: fine"
    got = C.feedback(frame(spark, [(body,), ("category: other",)], "b string"), "b", ["not_significant"]).collect()
    assert [(r.run_id, r.page_id, r.category, r.comment) for r in got] == [("r1", "p", "not_significant", "fine")]


def test_fingerprint_and_headings(spark):
    got = one(spark, T.fingerprint, "You must pay $1,000 within 30 days under section 12A from 3 May 2024.")
    assert got.modal_verbs == ["must"] and got.numerical == ["$1,000", "30 days", "section 12A"] and got.dates == ["3 May 2024"]
    assert one(spark, lambda t: T.until_heading(t, ["notes on clauses"]), "a\nb\nNotes on clauses\nc") == "a\nb"
    assert one(spark, lambda t: T.until_heading(t, ["none"]), "a\nb") == "a\nb"


def test_merges(spark):
    old, new = frame(spark, [(1, "a"), (2, "b")], "k long, v string"), frame(spark, [(2, "c"), (3, "d"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in S.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert sorted(tuple(r) for r in S.insert_or_ignore(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert [tuple(r) for r in S.backfill(old, new, ["k"], ["v"]).collect()] == [(3, "d")]


def test_queue(spark):
    rows = [(1, "2024-01-09 00:00:00", False), (2, "2024-01-01 00:00:00", False), (3, "bad", False), (4, "2024-01-09 00:00:00", True)]
    q = frame(spark, rows, "i long, created string, processed boolean")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert sorted(r.i for r in S.pending(q, now).collect()) == [1, 3]


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("source_id,url,title,source_type,importance,check_frequency,notes,force_selenium\ns,u,t,rss,bad,daily,,TRUE\n")
    r = S.read_registry(spark, str(tmp_path / "r.csv")).first()
    assert r.importance == 0.5 and r.force_selenium
    (tmp_path / "f.jsonl").write_text('{"run_id": "1", "category": "x"}\nnot json\n')
    assert S.read_feedback(spark, str(tmp_path / "f.jsonl")).count() == 1
    blob = spark.createDataFrame([(bytes.fromhex("0000803f"),), (b"",), (None,)], "b binary")
    assert [r.v for r in blob.select(S.vectors(F.col("b")).alias("v")).collect()] == [[1.0], None, None]


def test_html(spark):
    page = '<p>One &amp; two<br>x</p><script>var t="</p>";</script><style>p{}</style><!-- c --><div>End</div>'
    got = one(spark, lambda t: T.unescape(T.html_text(t)), page)
    assert [x.strip() for x in got.split("\n")] == ["One & two", "x", "End"]
    assert one(spark, T.nfc, "é") == "é"


def test_page_ids(spark):
    assert one(spark, T.page_id, "https://x.org/a/b1000?q") == "B1000"
    assert one(spark, T.page_id, "https://x.org/a/other").startswith("X")


def test_guarded_sql(spark):
    spark.range(3).select("id", F.lit(b"abc").alias("b")).createOrReplaceTempView("three")
    got = guarded_sql.select(spark, "/* c */ SELECT id, b FROM three -- x\n;").collect()
    assert len(got) == 3 and got[0].b == "<BLOB 3 B>"
    for bad in ("with a as (select 1) select * from a", "drop table three", "", "selectx"):
        with pytest.raises(ValueError, match="SELECT"):
            guarded_sql.select(spark, bad)


def test_clusters_and_projection(spark):
    rows = [(i, [float(i // 5 * 10), float(i % 5)]) for i in range(10)]
    df = frame(spark, rows, "id long, p array<double>")
    got = {r.id: r.cluster for r in ml.clusters(df, "id", "p", 2).collect()}
    assert len({got[i] for i in range(5)}) == 1 and got[0] != got[9]
    points = [r.point for r in ml.projected(df, "id", "p", 2).collect()]
    assert max(p[0] for p in points) == pytest.approx(1) and min(p[0] for p in points) == pytest.approx(-1)
    assert [r.point for r in ml.projected(df.limit(2), "id", "p", 2).collect()] == [[0.0, 0.0]] * 2


def test_kmeans_query_equals_brute_force(spark, tmp_path):
    """The third to eighth values separate the rows; the first two say nothing."""
    import numpy as np

    from loomwork.plans import catalog

    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 0.01, (140, 8))
    vectors[:, 2] += rng.uniform(-3, 3, 140)
    vectors[:, 5] += rng.uniform(-2, 2, 140)
    vectors = vectors.astype("float32").astype(float)
    frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.n, r.c0, r.c1) for r in catalog.queries()["kmeans_clusters"](spark, str(tmp_path)).collect())

    axes = np.linalg.eigh(np.cov(vectors.T))[1][:, ::-1][:, :2]
    p = vectors @ axes
    p = (p - p.min(0)) / (p.max(0) - p.min(0)) * 2 - 1
    p *= np.where(p.mean(0) < 0, -1, 1)
    centres = np.array([p[i * 140 // 7] for i in range(7)])
    for rounds in range(100):
        label = ((p[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([p[label == k].mean(0) if (label == k).any() else centres[k] for k in range(7)])
        if np.array_equal(new, centres):
            break
        centres = new
    assert rounds > 10
    want = sorted((int((label == k).sum()), *p[label == k].mean(0)) for k in range(7) if (label == k).any())
    assert [x[0] for x in got] == [x[0] for x in want]
    assert np.allclose(got, want, atol=1e-6)


def test_streak_and_failures(spark):
    rows = [(1, i, o) for i, o in enumerate(["completed", "error", "error"])] + [(2, 9, "completed")]
    df = frame(spark, rows, "source_id long, event_id long, outcome string").withColumn("ts", F.col("event_id"))
    assert {(r.source_id, r.kind, r.length) for r in RUNS.current_streak(df).collect()} == {(1, "error", 2), (2, "success", 1)}
    assert {(r.source_id, r.failures) for r in RUNS.consecutive_failures(df).collect()} == {(1, 2), (2, 0)}


def test_due(spark):
    rows = [("daily", "2024-01-09"), ("weekly", "2024-01-09"), ("odd", "2024-01-01"), ("weekly", None), ("weekly", "x")]
    got = RUNS.due(frame(spark, rows, "check_frequency string, last_checked string"), "2024-01-10").collect()
    assert [r.due for r in got] == [True, False, True, True, True]


def test_natural_chunks(spark):
    from loomwork.operators import monitoring as M

    schema = "page_id int, content string, sections array<struct<char_start:int,heading_text:string>>"

    def cut(text, sections, *sizes):
        rows = M.natural_chunks(frame(spark, [(1, text, sections)], schema), *sizes).orderBy("chunk_index").collect()
        assert [r.chunk_index for r in rows] == list(range(len(rows)))
        return [(r.chunk_text, r.section_heading) for r in rows]

    text = ("A short sentence about rivers. " * 20 + "\n\n") * 6
    found = cut(text, [])
    assert len(found) == 4 and all(len(c) <= 2100 for c, _ in found)
    assert all(c.endswith(".") for c, _ in found) and found[0][0] == text[:1244].strip() and found[1][0].startswith("rivers. A short")
    assert cut("Title\n\nBody text here.Next\n\nMore", [(0, "Title"), (22, "Next")], 1400, 200, 160, 0) == [("Body text here.", "Title"), ("More", "Next")]
    assert len(cut("x" * 1000 + "\n\n" + "y" * 30, [], 1000, 0, 0, 200)) == 1
    assert cut("", [], 10, 2, 2, 1) == [] and cut("  \n ", [], 10, 2, 2, 1) == [] and cut(None, None) == []
    # The overlap begins at a word.
    assert cut("one two three four five", [], 12, 4, 6, 1) == [("one two", None), ("two three", None), ("four five", None)]
    # The next chunk begins with a word, so what is left of an unbroken one is passed over.
    assert cut("a" * 25, [], 10, 3, 4, 1) == [("a" * 10, None)]


def test_natural_chunks_of_a_long_text(spark):
    """time is in proportion to the text, the rest of which was copied for each chunk, several times."""
    import time

    from loomwork.operators import monitoring as M

    text = "A short sentence about rivers. " * 30_000
    began = time.time()
    rows = M.natural_chunks(frame(spark, [(1, text, [])], "page_id int, content string, sections array<struct<char_start:int,heading_text:string>>")).collect()
    assert time.time() - began < 20
    assert all(r.chunk_text.endswith(".") and r.chunk_text in text for r in rows)
    assert all(1000 < len(r.chunk_text) <= 1400 for r in rows[:-1]) and sum(len(r.chunk_text) for r in rows) > len(text)


def test_references_of_texts_without_marks(spark):
    """each word began a search to the end of the text; matches are those of the one pattern."""
    import random
    import time

    began = time.time()
    assert one(spark, T.fingerprint, "words without marks " * 10_000).cross_references == []
    assert time.time() - began < 20
    ends = r"(?:Act|Regulation|Regulations|Rules|Code|Ordinance|Determination)\s+\d{4}\b"
    plain = r"(?iU)(?:\b(?:the\s+)?[A-Z][A-Za-z\s]+" + ends + r"|\bAct\s+No\b|\bsee\s+(?:also\s+)?section\b|\bpursuant\s+to\b|\bas\s+amended\s+by\b)"
    rng = random.Random(5)
    parts = ["the ", "Fair ", "Act ", "act\n", "Act  No ", "2009", "20091", " ", ". ", "Ruleſ ", "xRegulations ", "Code", "see also section ", "pursuant to ", "é", "3", "as amended by ", "\u2003"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))),) for _ in range(3000)]
    both = frame(spark, rows, "t string").select(T.fingerprint(F.col("t")).cross_references.alias("a"), F.array_distinct(F.regexp_extract_all("t", F.lit(plain), F.lit(0))).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] and sum(len(r.a) > 0 for r in both) > 500


def test_instruments(spark):
    from loomwork.operators import monitoring as M

    reason = "affect string, affected string, affected_series string, amended string, amended_series string, markdown string"
    rows = [
        (1, "C2020A1", [("Amend", "C2021A2", "Act", "C2020A1", None, None), ("Other", "C9", None, None, None, None)]),
        (2, "F1", [("Amend", None, None, None, None, "see C2019A7.")]),
        (3, None, None),
    ]
    df = frame(spark, rows, f"id int, register_id string, reasons array<struct<{reason.replace(' string', ':string')}>>")
    got = {(r.id, r.title_id, r.series) for r in M.amending_instruments(df).collect()}
    assert got == {(1, "C2020A1", "Act"), (1, "C2021A2", "Act"), (2, "C2019A7", "")}

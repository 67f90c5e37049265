"""Sections, phrases, line differences, keyphrases and the queue on hand-made rows and against brute force."""

import datetime
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from loomwork.operators import corpus as K
from loomwork.operators import keyphrases as P
from loomwork.operators import line_diff as L
from loomwork.operators import sections as S
from loomwork.sources import queue as Q
from loomwork.sources import shared
from loomwork.streaming import queue as SQ
from pyspark.sql import functions as F


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def found(frame):
    return [(r.heading_text, r.char_start, r.char_end) for r in frame.orderBy("id", "char_start").collect()]


# -- headings ---------------------------------------------------------------------


def test_question_headings_keep_their_places(spark):
    text = "What is it?\nIntellectual property is a type of property.\n  Who's involved?  \nThe rights holder and the infringer."
    got = found(S.headings(docs(spark, text), "id", "text"))
    assert [h for h, _, _ in got] == ["What is it?", "Who's involved?"]
    assert all(text[a:b] == h for h, a, b in got)


def test_prose_and_odd_texts_have_no_headings(spark):
    long = "A" + "b" * 79 + ":"
    rows = docs(spark, "A regular sentence that should not be a heading.\nAnother prose line.", None, "", "Title At The End", "Title\n\nblank below", long + "\ntext", "ab\ntext")
    assert found(S.headings(rows, "id", "text")) == []
    assert found(S.headings(docs(spark, "One Two Three\nx", "one Two\nx", "Why:\nx"), "id", "text")) == [("One Two Three", 0, 13), ("Why:", 0, 4)]
    same = docs(spark, "Title\nx").union(docs(spark, "Title\nx"))  # rows of one id are told apart
    assert len(found(S.headings(same, "id", "text"))) == 2


def test_headings_equal_brute_force(spark):
    random.seed(4)
    pieces = ["Title", "Über Alles", "why?", "Note:", "prose here.", "", "  ", " Don’t Do It! ", "A-B C'd", "x", "The End"]
    texts = ["\n".join(random.choice(pieces) for _ in range(random.randrange(12))) for _ in range(60)]
    title = re.compile(r"^(?:[A-Z][\w’'-]*(?:\s+|$)){1,8}[?!:]?$")

    def brute(text):
        lines, at, out = text.split("\n"), 0, []
        for i, line in enumerate(lines):
            bare = line.strip()
            ok = 3 <= len(bare) <= 80 and not bare.endswith(".") and i + 1 < len(lines) and lines[i + 1].strip()
            if ok and (re.match(r".{3,80}[?:]$", bare) or title.match(bare)):
                start = at + line.index(bare)
                out.append((bare, start, start + len(bare)))
            at += len(line) + 1
        return out

    assert found(S.headings(docs(spark, *texts), "id", "text")) == [h for t in texts for h in brute(t)]


def test_xml_headings(spark):
    xml = '<doc><p>One</p><head rend="h3">A <hi>b</hi></head><list><item>x</item></list><head>Last</head></doc>'
    rows = S.xml_headings(docs(spark, xml, None), "id", "text").orderBy("char_start").collect()
    assert [(r.heading_text, r.heading_level, r.char_start, r.char_end) for r in rows] == [("A b", 3, 4, 7), ("Last", 2, 10, 14)]


def brute_places(text, sections):
    cursor, out = 0, []
    for h in sections:
        at = text.find(h, cursor) if h else -1
        at = text.find(h) if h and at < 0 else at
        if at >= 0:
            cursor = at + len(h)
            out.append((h, at, cursor))
    return out


def test_sections_are_anchored_again(spark):
    random.seed(6)
    cases = [("Section\nbody one\nSection\nbody two", ["Section", "Section"]), ("Real heading\nContent body.", ["Chrome line", "Real heading"]), ("a b a", ["b", "a", "b", "a", "a"]), (None, ["x"]), ("x", None), ("x", ["", None, "x"])]
    cases += [("".join(random.choice("ab c") for _ in range(30)), ["".join(random.choice("abc") for _ in range(random.randint(1, 3))) for _ in range(8)]) for _ in range(80)]
    rows = [(k, t, None if s is None else [(h, 1) for h in s]) for k, (t, s) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "id long, text string, sections array<struct<heading_text:string,heading_level:int>>")
    for r in frame.select("id", S.anchored(F.col("text"), F.col("sections")).alias("x")).collect():
        text, sections = cases[r.id]
        got = [(s.heading_text, s.char_start, s.char_end) for s in r.x or []]
        assert got == (brute_places(text, sections) if text is not None and sections is not None else [])


# -- phrases inside lines ----------------------------------------------------------


def brute_clean(text, frequent, phrases):
    phrases = sorted({p.strip().lower() for p in phrases if p and p.strip()}, key=lambda p: (-len(p), p))
    kept = []
    for raw in (text or "").split("\n"):
        bare = raw.strip()
        if not bare:
            kept.append(raw)
            continue
        if bare in frequent or bare.lower() in phrases:
            continue
        for p in phrases:
            raw = re.sub(re.escape(p), "", raw, flags=re.I)
        if raw.strip():
            kept.append(raw.strip())
    out = re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()
    return out, max(0, len(text or "") - len(out))


def cleaned(spark, texts, frequent, phrases):
    lines = spark.createDataFrame([(x,) for x in frequent], "line string")
    listed = spark.createDataFrame([(x,) for x in phrases], "phrase string")
    return {r.id: (r.text, r.removed) for r in S.cleaned(docs(spark, *texts), "id", "text", lines, listed).collect()}


def test_phrases_are_cut_out_of_lines(spark):
    page = "Skip to main content\nMenu\nWhat is copyright?\nCopyright protects creative works.\nMenu\nSee also\nRelated links."
    inline = "Header SKIP to main content inside line\nBody."
    got = cleaned(spark, [page, inline, None, ""], ["Menu"], ["Skip to main content", " ", None])
    left = "What is copyright?\nCopyright protects creative works.\nSee also\nRelated links."
    assert got[0] == (left, len(page) - len(left))
    assert got[1] == ("Header  inside line\nBody.", 20)
    assert got[2] == got[3] == ("", 0)


@pytest.mark.parametrize("at_a_time", [100_000, 3])
def test_cleaning_equals_brute_force(spark, monkeypatch, at_a_time):
    monkeypatch.setattr(S, "SLICE", at_a_time)
    random.seed(at_a_time)
    texts = ["".join(random.choice("aAbBc \n") for _ in range(40)) for _ in range(120)]
    phrases = ["".join(random.choice("abc ") for _ in range(random.randint(1, 4))) for _ in range(9)]
    got = cleaned(spark, texts, ["a", "b c"], phrases)
    assert [got[k] for k in range(len(texts))] == [brute_clean(t, {"a", "b c"}, phrases) for t in texts]


def test_frequent_lines_are_stripped_with_places(spark):
    frame = docs(spark, *["Skip to main content\nTitle %s\nBody of %s." % (c, c) for c in "ABCDE"])
    bad = K.frequent_lines(frame, "id", "text", 0.7)
    assert [r.line for r in bad.collect()] == ["Skip to main content"]


# -- line differences ---------------------------------------------------------------


def brute_edits(old, new):
    table = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, x in enumerate(old):
        for j, y in enumerate(new):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    i, j, out = len(old), len(new), []
    while i or j:
        if i and j and old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
        elif j and (not i or table[i][j - 1] >= table[i - 1][j]):
            j -= 1
            out.append(f"+ {new[j]}")
        else:
            i -= 1
            out.append(f"- {old[i]}")
    return out[::-1]


@pytest.mark.parametrize("step", [128, 3])
def test_edits_are_those_of_the_full_table(monkeypatch, step):
    monkeypatch.setattr(L, "STEP", step)
    random.seed(step)
    for _ in range(1500):
        letters = "abcdefgh"[: random.randint(1, 8)]
        old, new = ([random.choice(letters) for _ in range(random.randrange(16))] for _ in range(2))
        assert L.edits(old, new) == brute_edits(old, new)


def test_turn_differences_equal_brute_force(spark, sf_dir):
    from loomwork.plans.section_queries import turn_diffs

    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): r.edits for r in turn_diffs(spark, sf_dir).collect()}
    assert set(got) == {(c, t) for c, t in turns if (c, t + 1) in turns}
    for (c, t), edits in got.items():
        assert edits == ("\n".join(brute_edits(*[re.split("[ \n]", turns[c, k]) for k in (t, t + 1)])) or None)


def test_differences_of_odd_texts(spark):
    rows = [("a\nb", "a\nb"), (None, "x\ny"), ("x", ""), (None, None), ("", ""), ("a", "a\na"), ("same\n" * 5000 + "old", "same\n" * 5000 + "new")]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, a string, b string")
    got = [r.d for r in frame.select("id", L.line_diff(F.col("a"), F.col("b")).alias("d")).orderBy("id").collect()]
    assert got == [None, "+ x\n+ y", "- x", None, None, "+ a", "- old\n+ new"]


# -- keyphrases -----------------------------------------------------------------------


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_keyphrases_equal_brute_force(spark, monkeypatch):
    texts = ["The patent office grants a patent. Patent offices, patents and the patent office of 12 states!", "A trade mark is a sign; trade marks are signs.", "", None, "copyright " * 30 + "work " * 700, "the of and 12 3"]

    def runs(text):
        out = {}
        for segment in re.split(r"[^\w ]+", (text or "").lower()):
            w = segment.split()
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    if w[i] not in P.STOPWORDS and w[i + n - 1] not in P.STOPWORDS:
                        p = " ".join(w[i : i + n])
                        out[p] = out.get(p, 0) + 1
        return out

    each = [runs(t) for t in texts]
    df = {}
    for r in each:
        for p in r:
            df[p] = df.get(p, 0) + 1
    want = {}
    for k, (t, r) in enumerate(zip(texts, each)):
        n = max(5, min(15, len((t or "").split()) // 80))
        pool = sorted((round(1 / (1 + f * (math.log((len(texts) + 1) / (df[p] + 1)) + 1)), 9), p) for p, f in r.items())[: max(3 * n, 10)]
        taken = []
        for score, p in pool:
            if all(1 - lev(p, q) / max(len(p), len(q)) < 0.7 for _, q in taken):
                taken.append((score, p))
        good = [(p, s) for s, p in taken if len(p) >= 3 and not (" " not in p and (p in P.STOPWORDS or p.isdigit()))]
        want.update({(k, i + 1): x for i, x in enumerate(good[:n])})
    for spread in (20_000, 2):  # all phrases by shuffle, and frequent ones by broadcast
        monkeypatch.setattr(shared, "SPREAD", spread)
        got = {(r.id, r["rank"]): (r.phrase, r.score) for r in P.keyphrases(docs(spark, *texts), "id", "text").collect()}
        assert {k: p for k, (p, _) in got.items()} == {k: p for k, (p, _) in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


# -- deferred queue ---------------------------------------------------------------------


def queue(spark, *rows):
    data = '{"ipfr_page_id": "B1012", "triggers": []}'
    return spark.createDataFrame([(k, "run-001", "SRC001", "B1012", data, created, done) for k, (created, done) in enumerate(rows)], Q.QUEUE)


NOW = "2024-03-10 00:00:00"


def test_queue_of_pending_stale_and_processed(spark):
    rows = queue(spark, ("2024-03-09T10:00:00+00:00", False), ("2024-03-09T10:00:00+00:00", True), ("2020-01-01T00:00:00+00:00", False), ("someday", False), (None, False), ("2024-03-03", False), ("2024-03-02T23:59:59", False))
    todo = Q.pending(rows, F.lit(NOW)).collect()
    assert sorted(r.id for r in todo) == [0, 3, 4, 5]
    assert {r.trigger_data.ipfr_page_id for r in todo} == {"B1012"}
    state = {r.id: r.processed for r in Q.expire(rows, F.lit(NOW)).collect()}
    assert state == {0: False, 1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
    assert Q.pending(rows.where("false"), F.lit(NOW)).collect() == []


def test_marking_and_storing_twice_change_nothing(spark):
    rows = queue(spark, ("2024-03-09", False), ("2024-03-09", False))
    done = spark.createDataFrame([(1,), (1,), (77,)], "id long")
    once = Q.mark_processed(rows, done)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, Q.mark_processed(once, done).collect()))
    assert {r.id: r.processed for r in once.collect()} == {0: False, 1: True}
    again = Q.store(once, rows.drop("processed"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))


def test_queue_as_a_stream(spark, tmp_path):
    day = lambda d, h=0: datetime.datetime(2024, 3, d, h)
    batches = [
        [(1, "store", "B1", day(1)), (2, "store", "B2", day(1)), (1, "store", "B1", day(1, 2))],
        [(1, "processed", None, day(2)), (1, "processed", None, day(2, 1)), (9, "processed", None, day(2))],
        [(3, "store", "B3", day(12))],
        [(2, "processed", None, day(13))],
        [(4, "store", "B4", day(14))],
    ]
    schema = "id long, kind string, page_id string, at timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        sink = SQ.deferred_queue(stream).writeStream.format("memory").queryName("deferred").outputMode("append")
        run = sink.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination(200)
        got = sorted((r.id, r.outcome, r.page_id) for r in spark.table("deferred").collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == [(1, "processed", "B1"), (1, "stored", "B1"), (2, "expired", "B2"), (2, "stored", "B2"), (3, "stored", "B3"), (4, "stored", "B4")]




def test_phrases_travel_as_keys_in_packets(spark, monkeypatch):
    from loomwork.operators import keyphrases

    monkeypatch.setattr(keyphrases, "PACKET", 60)
    monkeypatch.setattr(keyphrases, "PART", 90)
    texts = {i: " ".join(f"w{(i * k) % 7} é{k % 5}," if k % 3 else f"w{i % 4}" for k in range(i % 11 + 1)) for i in range(40)} | {40: None, 41: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    every = docs.select("doc_id", F.explode(keyphrases.runs(F.coalesce("text", F.lit("")))).alias("p")).collect()
    tf = {}
    for r in every:
        tf[r.doc_id, r.p] = tf.get((r.doc_id, r.p), 0) + 1
    df = {p: sum(q == p for _, q in tf) for _, p in tf}
    got = keyphrases.scored_phrases(docs, "doc_id", "text")
    assert sorted((r.doc_id, r.phrase, r.tf, r.df) for r in got.collect()) == sorted((d, p, n, df[p]) for (d, p), n in tf.items())
    key = lambda r: (r.doc_id, r.phrase, r.tf, r.df, r.score, r.n, r["rank"])
    best = keyphrases.pool(keyphrases.scored_phrases(docs, "doc_id", "text", best=True), "doc_id")
    assert sorted(map(key, best.collect())) == sorted(map(key, keyphrases.pool(got, "doc_id").collect()))


ODD = [
    "The patent office; a patent, the  patent office of 12 ſtates. İstanbul ΑΣ ΑΣ, straße_x a b c d", "", None, "  , ; ", "of the", "a", "w1 w2 w3 w4 w1 w2 w3\nw1 w2",
    "naïve naïve 漢字 漢字, 𝒳 𝒳 x² ½ ٣ ৩ 😀 x", "\t\x0b\x85\xa0 one two three‍four \x00 five", "c " * 40 + "b. " * 5, "ab a b abc a bc", "patent office the patent", "x" * 300 + " y",
]


def test_phrases_are_numbers_of_words(spark, monkeypatch):
    """phrases were made by nested functions and counted as objects, both twice; texts went through two exchanges."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "id long, text string")
    tf = Counter((r.id, p) for r in rows.select("id", P.runs(F.coalesce("text", F.lit(""))).alias("p")).collect() for p in r.p)
    df = Counter(p for _, p in tf)
    for wide in (1 << 62, 1):  # with few words to a packet, and with so many that numbers are made anew
        monkeypatch.setattr(P, "WIDE", wide)
        got = P.scored_phrases(rows, "id", "text")
        assert {(r.id, r.phrase): (r.tf, r.df) for r in got.collect()} == {k: (n, df[k[1]]) for k, n in tf.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "ReusedExchange" in plan


def test_ids_of_phrases_may_repeat_or_be_null(spark):
    rows = spark.createDataFrame([("a", "one two"), ("a", "two, one"), (None, "two"), (None, None), ("b", "two three"), ("c", None)], "id string, text string")
    got = {(r.id, r.phrase): (r.tf, r.df, r.n) for r in P.scored_phrases(rows, "id", "text").collect()}
    assert got == {
        ("a", "one"): (2, 1, 5), ("a", "two"): (2, 3, 5), ("a", "one two"): (1, 1, 5), (None, "two"): (1, 3, 5), ("b", "two"): (1, 3, 5), ("b", "three"): (1, 1, 5), ("b", "two three"): (1, 1, 5),
    }


def test_keys_are_told_apart_by_their_last_bits():
    high, low = np.array([5, 5, 5, 2], np.uint64), np.array([3 << 24, (3 << 24) + 1, 3 << 24, 9], np.uint64)
    order = P.key_order(high, low)
    assert list(zip(high[order].tolist(), low[order].tolist())) == sorted(zip(high.tolist(), low.tolist()))
    many = np.array([0, 1, 255, 256, 2**32 - 1])
    assert P.unpacked(P.packed(many)).tolist() == many.tolist() and P.unpacked(P.packed(many[:0])).tolist() == []


def test_keyphrases_are_chosen_where_phrases_are_counted(spark):
    """the best phrases were dealt by id twice more, to be ordered and put in lists."""
    plan = P.keyphrases(docs(spark, "one two three", "two three", None), "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(id" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1

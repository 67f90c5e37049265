"""Operators 3, 6 and 10 against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import by_id, components_of, kept_bytes, kept_words, shingles
from loomwork.llm import near_dup, spans, substring_dedup, suffix_dedup


def test_sliding_argmin_takes_the_leftmost_smallest():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 20):
        values = (rng.integers(0, 6, 100).astype(np.uint64) << np.uint64(20)) + np.uint64(0)
        got = spans.sliding_argmin(values, width)
        assert [int(i + np.argmin(values[i : i + width])) for i in range(100 - width + 1)] == got.tolist()


def test_count_min_never_underestimates():
    rng = np.random.default_rng(2)
    blocks = 2
    packets = [rng.integers(0, 500, 300).astype(np.uint64) for _ in range(10)]
    total = {}
    for keys in packets:
        for batch in spans.partition_sketch(1, 0, keys, blocks):
            for block, _, _, cells, counts in zip(*[c.to_pylist() for c in batch.columns]):
                for cell, n in zip(np.cumsum(spans.expand_planes(cells, np.uint32)).tolist(), spans.expand(counts, np.uint8).tolist()):
                    total[block, cell] = total.get((block, cell), 0) + n
    true = Counter(int(k) for keys in packets for k in keys)
    for row in range(spans.ROWS):
        for k, code in zip(true, spans.cells_of(np.array(list(true), dtype=np.uint64), row, blocks).tolist()):
            assert total[row * blocks + code // spans.CELLS, code % spans.CELLS] >= true[k]


def test_sums_modulo_the_prime():
    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, spans.PRIME, 200).astype(np.uint64) for _ in range(2))
    assert spans.times(a, b).tolist() == [int(x) * int(y) % spans.PRIME for x, y in zip(a, b)]
    values = rng.integers(0, spans.PRIME, spans.PIECE + 300).astype(np.uint64)
    whole = spans.run_hashes(values, 7)
    at = spans.PIECE - 4
    assert len(whole) == len(values) - 6 and whole[at : at + 3].tolist() == spans.run_hashes(values[at : at + 9], 7).tolist()
    text = b"one " + b"x" * (spans.PIECE + 9) + b" one two " + b"y" * 20_000 + b" two"
    found = spans.word_hashes(text, *spans.split_words(text)).tolist()
    assert found[0] == found[2] and found[3] == found[5] and len(set(found)) == 4


def twins(n=1024):
    """Two words whose polynomials modulo 2**64 are equal for every odd base."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_a_power_of_two_confuses(spark):
    one, two = twins()
    rest = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, rest + " " + one), (2, rest + " " + two)], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.query(docs).collect()} == {0}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = by_id(suffix_dedup.query(docs))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == kept_bytes(texts, 200)
    lone = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.query(lone).collect()} == {1: 1, 2: 2, 3: 1}


def test_rows_of_one_id_and_without_id_are_rows_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, "other " * 3), (None, text), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.query(docs).collect())
    assert got == [(0, 60, 60), (1, 3, 0), (1, 60, 60), (2, 1, 0)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.query(docs).collect())
    n = len(text)
    assert got == [(0, n, n), (1, 18, 0), (1, n, n), (2, 5, 0)]


def test_substring_dedup_equals_brute_force(sample):
    frame, texts = sample
    got = by_id(substring_dedup.query(frame))
    want = kept_words(texts, 35)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want


def test_substring_dedup_inside_one_text(spark):
    text = " ".join(map(str, range(40))) + " gap " + " ".join(map(str, range(40)))
    r = substring_dedup.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_removed, r.kept_text) == (81, 80, "gap")


def test_suffix_dedup_equals_brute_force(sample):
    frame, texts = sample
    want = kept_bytes(texts, 200)
    for limit in (1_000, 1):  # with a limit of 1, repeated anchors go down to the last level
        got = by_id(suffix_dedup.dedup(frame, group_runs=limit))
        assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want


def test_runs_of_anchors_are_those_of_whole_arrays():
    rng = np.random.default_rng(5)
    step = spans.ANCHOR_STEP
    for raw in (b"a" * (step + 500), bytes(rng.integers(97, 99, 2 * step + 31).astype(np.uint8)), b"ab" * 100, b"x" * 199):
        raw = np.frombuffer(raw, dtype=np.uint8)
        for gram in suffix_dedup.GRAMS:
            chosen, grams = spans.anchors(suffix_dedup.BYTES[raw], 200, gram)
            starts, keys = spans.anchor_runs(raw, suffix_dedup.BYTES, 200, gram)
            want = np.flatnonzero(np.diff(chosen, prepend=-1))
            assert starts.tolist() == want.tolist() and keys.tolist() == grams[chosen[want]].tolist()


def test_deeper_levels_are_dealt_out(sample, monkeypatch):
    """Few bytes of runs that overlap are much work, so they are not one task."""
    frame, _ = sample
    seen = []
    inner = suffix_dedup.sketched
    monkeypatch.setattr(suffix_dedup, "sketched", lambda segments, *rest: seen.append(segments) or inner(segments, *rest))
    assert suffix_dedup.dedup(frame, group_runs=1).count() == frame.count()
    assert len(seen) == len(suffix_dedup.GRAMS)
    assert all(x.rdd.getNumPartitions() >= 16 for x in seen[1:])


def test_packets_are_moved_once(sample):
    """The joins with packets shuffle the other side only."""
    frame, _ = sample
    lines = suffix_dedup.dedup(frame)._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [below for x, below in zip(lines, lines[1:]) if "Exchange hashpartitioning(part" in x]
    assert moved and not [x for x in moved if "ids#" in x]


def test_levels_are_the_same_sorted_or_laid_out(spark, monkeypatch):
    schema = ", ".join(f"{n} {t}" for n, t in (("block", "int"), ("part", "long"), ("piece", "int"), ("cells", "binary"), ("counts", "binary")))
    rng = np.random.default_rng(6)
    rows = []
    for part in range(5):
        for batch in spans.partition_sketch(part, 0, rng.integers(0, 50, 40).astype(np.uint64), 4):
            rows += [tuple(r.values()) for r in batch.to_pylist()]
    frame, found = spark.createDataFrame(rows, schema), []
    for few in (0, 1 << 16):
        monkeypatch.setattr(spans, "FEW", few)
        run = spans.merged_levels(frame, 3).collect()
        found.append({r.part: (r.hot, sorted((x.piece, x.block, spans.expand(x.levels, np.uint8).tolist()) for x in r.answers)) for r in run})
    assert found[0] == found[1] and {v for x in found[0].values() for _, _, level in x[1] for v in level} == {0, 1, 2}


def test_maximal_repeats_of_a_small_string():
    runs = [(b"xabcabcy", 8), (b"zabcq", 5)]
    found = {(size, tuple(sorted(hits))) for size, hits in suffix_dedup.maximal_repeats(runs, 3)}
    assert (3, ((0, 1), (0, 4), (1, 1))) in found


def test_repeat_groups_have_all_occurrences(sample):
    frame, texts = sample
    raw = {i: t.encode() for i, t in texts.items()}
    groups = {}
    for r in suffix_dedup.repeats(frame).collect():
        groups.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.start))
    seen = {}
    for (_, size), places in groups.items():
        assert len(places) > 1 and size >= 200
        (data,) = {raw[i][a : a + size] for i, a in places}
        seen[data] = places
    # All occurrences: those of each repeat's bytes anywhere in the corpus.
    for data in list(seen)[:60]:
        want = {(i, k) for i, t in raw.items() for k in range(len(t)) if t.startswith(data, k)}
        assert seen[data] == want


def test_near_dup_equals_brute_force(sample):
    frame, texts = sample
    got = by_id(near_dup.query(frame))
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    want = components_of(sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_dup_chain_across_a_bucket(spark):
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for k in range(12):  # each differs from the one before in a few words, the ends differ much
        base = base[:]
        base[k * 9] = f"n{k}"
        texts[100 - k] = " ".join(base)
    texts[500] = " ".join(f"q{i}" for i in range(200))
    got = by_id(near_dup.query(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == components_of({i: shingles(t, 4) for i, t in texts.items()})


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300, 5000):
        assert (near_dup.sketch(rng.integers(0, 2**63, n).astype(np.uint64)) != ~np.uint64(0)).all()
    shared = rng.integers(0, 2**63, 800).astype(np.uint64)
    a, b = (np.concatenate([shared, rng.integers(0, 2**63, 100).astype(np.uint64)]) for _ in range(2))
    assert abs((near_dup.sketch(a) == near_dup.sketch(b)).mean() - 0.8) < 0.12


@pytest.mark.parametrize("call", [substring_dedup.query, suffix_dedup.query, near_dup.query])
def test_odd_tables(call, odd_docs, no_docs):
    rows = call(odd_docs).collect()
    assert {r.doc_id for r in rows} >= {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12}
    assert call(no_docs).collect() == []


def test_odd_results(odd_docs):
    words = {r.doc_id: r for r in substring_dedup.query(odd_docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all((words[i].n_words, words[i].kept_sha256) == (0, empty) for i in (1, 2, 3))
    assert words[4].n_removed == words[4].n_words == words[5].n_removed  # equal long texts
    near = {r.doc_id: r for r in near_dup.query(odd_docs).collect()}
    assert near[5].component_id == 4 and near[7].component_id == 6
    assert near[1].n_shingles == 0 and near[1].kept and near[2].component_id == 2
    assert len(near_dup.keep_one(odd_docs).where("doc_id = 6").collect()) == 1
    assert near_dup.keep_one(odd_docs).columns == odd_docs.columns

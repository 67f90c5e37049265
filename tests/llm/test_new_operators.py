"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest_llm import LOWER
from loomwork.llm import id_coder, id_files, importance, vector_codes
from pyspark.sql import functions as F

# -- 11 --------------------------------------------------------------------------


def buckets_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute_importance(docs, target):
    """docs: [(doc_id, text)], target: [text]."""
    found = [(i, *buckets_of(t)) for i, t in docs]
    s, t = Counter(b for _, _, x in found for b in x), Counter(b for x in target for b in buckets_of(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    rows = []
    for i, n, x in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        rows.append((i, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(r[0], *r[2:], rank.get(id(r))) for r in rows]


def test_importance_equals_brute_force(spark, sf_dir, sample, odd_docs, no_docs):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    goal = [r.text for r in target.collect()]
    for frame in (sample[0], odd_docs, no_docs):
        docs = [(r.doc_id, r.text) for r in frame.collect()]
        got = [tuple(r) for r in importance.query(frame, target).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute_importance(docs, goal)))
    empty = importance.query(sample[0], target.where("false")).collect()
    want = brute_importance(list(sample[1].items()), [])
    assert sorted(map(repr, map(tuple, empty))) == sorted(map(repr, want))


def test_importance_ties_and_repeats(spark):
    text = " ".join(f"wort{i}" for i in range(30))
    rows = [(k % 50, text) for k in range(400)] + [(900, "kurz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = importance.query(frame, target).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, 21)) and len(got) == 401
    order = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(-r.score, r.doc_id) for r in order] == sorted((-r.score, r.doc_id) for r in order)
    assert importance.resample(frame.dropDuplicates(["doc_id"]), target, percent=10).columns == ["doc_id", "text", "rank"]


# -- 12 --------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: [(vec_id, vector, label)], complete ones only."""
    rows = sorted(rows, key=lambda r: r[0])
    v = [[math.floor(256 * x) for x in r[1]] for r in rows]
    w = len(v[0]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for x in v]
    book = [[cut[e][p] for e in range(min(entries, len(v)))] for p in range(parts)]

    def assign(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book[p]))

    for _ in range(rounds):
        got = [[assign(x[p], p)[1] for p in range(parts)] for x in cut]
        for p in range(parts):
            for e in range(len(book[p])):
                own = [x[p] for x, g in zip(cut, got) if g[p] == e]
                if own:
                    book[p][e] = [sum(c) // len(own) for c in zip(*own)]
    final = [[assign(x[p], p) for p in range(parts)] for x in cut]
    error = [sum(d for d, _ in f) for f in final]
    label = Counter()
    for r, e in zip(rows, error):
        label[r[2]] += e
    digest = hashlib.sha256(",".join(str(y) for p in book for e in p for y in e).encode()).hexdigest()
    return {r[0]: ("".join(f"{e:02x}" for _, e in f), d, label[r[2]], digest) for r, f, d in zip(rows, final, error)}


def test_codes_equal_sql_and_brute_force(spark, sf_dir):
    path = f"{sf_dir}/embeddings.parquet"
    frame = spark.read.parquet(path)
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.query(frame).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}'")
    assert got == {r[0]: r[1:] for r in con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({vector_codes.sql()})").fetchall()}
    some = frame.where("vec_id < 150")
    rows = [(r.vec_id, r.embedding, r.label) for r in some.collect()]
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.query(some).collect()} == brute_codes(rows)


def test_codes_of_odd_vectors(spark):
    good = [(k, [float((k * j) % 7) / 7 for j in range(32)], None if k % 3 else 1) for k in range(40)]
    nan, inf = float("nan"), float("inf")
    bad = [(-1, None, 1), (-2, [], 1), (-3, [0.5] * 31 + [None], 1), (-4, [nan] * 32, 1), (-5, [0.1] * 31 + [-inf], 2), (50, [0.1] * 8, 2)]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash")).withColumn("error", F.lit("clash"))
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.query(frame.repartition(3)).collect()}
    exact = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in good]
    assert got == brute_codes(exact)
    assert vector_codes.query(frame.where("vec_id < 0")).collect() == [] and vector_codes.query(frame.where("false")).collect() == []
    same = frame.where("vec_id = 7").union(frame.where("vec_id = 7"))
    assert len(vector_codes.query(same).collect()) == 2
    lone = spark.createDataFrame([(None, [0.25] * 20, None)], "vec_id long, embedding array<float>, label int")
    assert [r.error for r in vector_codes.query(lone).collect()] == [0]


def test_codes_decode_near_the_vectors(spark, sf_dir):
    rows = vector_codes.kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    size, book = vector_codes.fit(rows)
    back = vector_codes.decode(vector_codes.encode(rows, size, book), book).join(rows.select("vec_id", "v"), "vec_id").collect()
    for r in back[:50]:
        off = sum((math.floor(256 * x) - 256 * y) ** 2 for x, y in zip(r.v, r.vector))
        assert off == pytest.approx(r.error)


# -- 13 --------------------------------------------------------------------------


def test_coder_gives_ids_back():
    random.seed(3)
    some = [random.choice([220, 11, 13, 50256, 0, 65535, random.randrange(50257)]) for _ in range(9000)]
    cases = [[], [7], [0] * 5000, list(range(65536)), some, some[:2049] * 3, [1, 2, 3] * 4000]
    for ids in cases:
        ids = np.array(ids, np.uint16)
        frame = id_coder.pack(ids)
        assert (id_coder.unpack(frame) == ids).all()
    assert len(id_coder.pack(np.array([1, 2, 3] * 4000, np.uint16))) < 12_000  # repeats are learned: under 8 of 16 bits
    frame = bytearray(id_coder.pack(np.array(some, np.uint16)))
    for at in (3, 30, len(frame) - 40):
        broken = bytearray(frame)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            id_coder.unpack(bytes(broken))


def test_blocks_do_not_need_each_other():
    ids = np.array([random.Random(5).randrange(900) for _ in range(10_000)], np.uint16)
    order0 = id_coder.Order0.of(ids)
    counts, words = id_coder.encode_blocks(ids, order0)
    other = words.copy()
    other[: counts[0]] = 7  # the first block is lost
    back = id_coder.decode_blocks(len(ids), order0, counts, other)
    first = id_coder.lengths(len(ids))[0]
    assert (back[first:] == ids[first:]).all() and not (back[:first] == ids[:first]).all()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_library():
    random.seed(11)
    own, lib = id_files.Texts(public_tokenizers.path("byte_bpe_50k.json")), library()
    assert own.fast is not None
    bits = ["a", "the", "The", " ", "  ", "\n", "\t", " ", " ", "'s", "'", "é", "ß", "漢", "😀", "12", "3", ".", "--", "<|endoftext|>", "\x00", "\x1c", "ing", "\r\n", "​", "Ġ", "zq"]
    texts = ["".join(random.choice(bits) for _ in range(random.randrange(40))) for _ in range(4000)] + ["", " ", "a ", " a", "\n", "a\n"]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids, text
    assert id_files.Texts(public_tokenizers.path("word_bpe_49k.json")).fast is None


def brute_files(rows):
    lib, at, out = library(), 0, []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_equal_brute_force(spark, sample, odd_docs, no_docs, monkeypatch):
    rows = sorted(sample[1].items())
    got = sorted(tuple(r) for r in id_files.query(sample[0]).collect())
    assert got == brute_files(rows)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in id_files.query(odd_docs).collect()), key=lambda r: r[1])
    keys = [r[0] for r in got]
    assert keys == sorted(keys, key=lambda i: (i is None, i or 0)) and len(got) == len(odd)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    assert Counter((i, n, c) for i, _, n, c in got) == Counter((i, n, c) for i, _, n, c in brute_files(odd))
    assert id_files.query(no_docs).collect() == []


def test_files_give_the_ids(spark, tmp_path):
    frame = spark.createDataFrame([(3, "b a"), (1, "the end"), (2, None)], "doc_id long, text string")
    id_files.write(frame, f"{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"), 2)
    got = {r.doc_id: r.ids for r in id_files.read(spark, f"{tmp_path}/ids", with_ids=True).collect()}
    lib = library()
    assert got == {i: [*lib.encode(t, add_special_tokens=False).ids, 2] for i, t in ((3, "b a"), (1, "the end"), (2, ""))}

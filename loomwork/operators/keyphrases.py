"""Keyphrases: runs of words weighed by their frequency in a document and in the corpus, near-equal ones once."""

from __future__ import annotations

import ctypes
import zlib
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .monitoring import valid_phrase

# Phrases for so many words, at least and at most; the pool is three times that; similar phrases from this on.
PER_WORDS, FEWEST, MOST, POOL, SIMILAR, SHORTEST = 80, 5, 15, 3, 0.7, 3
#: Words of a phrase, at most.
RUN = 3
#: Words that no phrase begins or ends with.
STOPWORDS = "a an and are as at be by for from in is it of on or that the these this those to was were with".split()


def wanted(words: Column) -> Column:
    """How many phrases a text of so many words gets."""
    return F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.floor(words / PER_WORDS).cast("int")))


def runs(text: Column, stopwords: list[str] = STOPWORDS, longest: int = RUN) -> Column:
    """All runs of up to ``longest`` words in lower case that no mark interrupts and no stop word begins or ends."""
    segments = F.split(F.lower(text), r"[^\p{L}\p{N} ]+")
    words = F.filter(F.transform(segments, lambda s: F.filter(F.split(s, " +"), lambda w: w != "")), lambda s: F.size(s) > 0)

    def of(s: Column, size: int) -> Column:
        starts = F.when(F.size(s) >= size, F.sequence(F.lit(1), F.size(s) - (size - 1))).otherwise(F.array().cast("array<int>"))
        ends = lambda i: ~F.get(s, i - 1).isin(stopwords) & ~F.get(s, i + (size - 2)).isin(stopwords)
        return F.transform(F.filter(starts, ends), lambda i: F.array_join(F.slice(s, i, size), " "))

    return F.flatten(F.transform(words, lambda s: F.concat(*[of(s, k) for k in range(1, longest + 1)])))


#: Letters of the texts of a packet, about, at most and at least, and of a part of the keys; how many packets before they grow.
PACKET, SMALLEST, PART, SPLIT = 4_000_000, 200_000, 8_000_000, 64
#: The word that stands for marks; below this numbers of words are put together to one number; bytes of a key after the first four.
MARK, WIDE, REST = "\n", 1 << 62, 7
#: Keys of the words' hashes.
HASHES = "keyphrases, high", "keyphrases, low."


class Packet:
    """Phrases of some texts as numbers, in the order of the phrases; texts are words in lower case, blanks and MARKs, with one at the end.

    words: the words in order. spelled: the numbers of a phrase's words from 1 on, 0 for none, a row for each place in a
    phrase. doc, phrase, tf: counts in order of doc and phrase. docs, n: the ids and how many phrases each gets.
    """

    def __init__(self, rows: pa.Table, stopwords: list[str] = STOPWORDS, longest: int = RUN):
        ids = rows["doc"].combine_chunks().dictionary_encode("encode")
        at, self.docs = ids.indices.to_numpy(), ids.dictionary
        self.n = np.zeros(len(self.docs), np.int64)
        np.maximum.at(self.n, at, rows["n"].to_numpy())
        lists = pc.split_pattern(pc.replace_substring(rows["text"].combine_chunks(), MARK, f" {MARK} "), " ")
        found = lists.flatten().dictionary_encode()
        order = pc.sort_indices(found.dictionary).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.words = found.dictionary.take(pa.array(order))
        word, doc = place[found.indices.to_numpy()], np.repeat(at, pc.list_value_length(lists).to_numpy())
        there = word != self.words.index("").as_py()
        word, doc = word[there], doc[there]
        mark = word == self.words.index(MARK).as_py()
        never = pc.is_in(self.words, pa.array([*stopwords, MARK])).to_numpy(zero_copy_only=False)[word]
        spelled, docs = [], []
        for size in range(1, longest + 1):
            last = max(len(word) - size + 1, 0)
            good = ~never[:last] & ~never[size - 1 :]
            for k in range(1, size - 1):
                good &= ~mark[k : last + k]
            spelled.append(np.stack([word[k : last + k][good] + 1 if k < size else np.zeros(good.sum(), np.int32) for k in range(longest)]))
            docs.append(doc[:last][good])
        spelled, doc = np.concatenate(spelled, axis=1), np.concatenate(docs).astype(np.int64)
        code, base = spelled[0].astype(np.int64), len(self.words) + 1
        for k in range(1, longest):  # a blank comes before all letters, so numbers are in order as phrases are
            if code.max(initial=0) >= WIDE // base:
                code = np.unique(code, return_inverse=True)[1]
            code = code * base + spelled[k]
        coded = pa.array(code).dictionary_encode()
        order = np.argsort(coded.dictionary.to_numpy())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        phrase = place[coded.indices.to_numpy()]
        first = np.empty(len(order), np.int64)
        first[phrase] = np.arange(len(phrase))
        self.spelled = spelled[:, first]
        both, self.tf = np.unique(doc * max(len(order), 1) + phrase, return_counts=True)
        self.doc, self.phrase = np.divmod(both, max(len(order), 1))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the phrases in order, as 32 and 56 bits, and whose they are.

        They come from SipHash of the words under two keys: that any two of 3 billion phrases share 88 bits has a chance of 1 in 60 million.
        """
        spelled = self.words.to_numpy(zero_copy_only=False)
        words = [hash_array(spelled, hash_key=key, categorize=False) for key in HASHES]
        high, low = np.zeros((2, self.spelled.shape[1]), np.uint64)
        for word in self.spelled:
            high, low = (np.where(word > 0, mixed(x + h[word - 1]), x) for h, x in zip(words, (high, low)))
        high, low = high >> np.uint64(32), low >> np.uint64(64 - 8 * REST)
        order = key_order(high, low)
        return high[order].astype(np.int64), low[order], order

    def spell(self, phrases: np.ndarray) -> pa.Array:
        """The phrases of these numbers as text."""
        each = [self.words.take(pa.array(word[phrases] - 1, mask=word[phrases] == 0)) for word in self.spelled]
        return pc.binary_join_element_wise(*each, " ", null_handling="skip")


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all bits of those given; different ones stay different."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def key_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order of keys of 32 and 56 bits; but for rare ones the first 64 bits tell, and equal keys come in whatever order."""
    first = high << np.uint64(32) | low >> np.uint64(8 * REST - 32)
    order = np.argsort(first)
    near = np.diff(first[order]) == 0
    return np.lexsort((low, high)) if (near & (np.diff(low[order]) != 0)).any() else order


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, all first bytes, then all second ones and so on: most are small, and zeros take no room."""
    return zlib.compress(numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "u1").reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def given_back(table: pa.Table) -> pa.Table:
    """``table``, after what its making has freed went back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    return table


def score_of(tf: Column, df: Column, total: int) -> Column:
    """1 / (1 + tf * (ln((N + 1) / (df + 1)) + 1)) over N documents; lower scores are better."""
    return F.round(1 / (1 + tf * (F.log((F.lit(total) + 1) / (df + 1)) + 1)), 9)


def scored_phrases(docs: DataFrame, id_col: str, text_col: str, best: bool = False) -> DataFrame:
    """(id, phrase, tf, df, score, n): each phrase of a document with ``score_of``. n: how many the document gets.

    Ids are taken as keys. With ``best`` only phrases that are in the ``pool`` of their document.
    """
    lists, total = counted_phrases(docs, id_col, text_col, best)
    rows = lists.select(id_col, "n", F.inline("phrases"))
    return rows.select(id_col, "phrase", "tf", "df", score_of(F.col("tf"), F.col("df"), total).alias("score"), "n")


def counted_phrases(docs: DataFrame, id_col: str, text_col: str, best: bool = False) -> tuple[DataFrame, int]:
    """(id, n, phrases), a row for each id with a list of phrase, tf and df, and the number of documents.

    Phrases do not travel: packets of texts do, once, and make their phrases as numbers in each step. A packet sends each
    key once, in parts by the key's range, with the number of its documents; a part adds up and answers with the numbers
    of the other packets in the order in which the keys came, so an answer is a number for each key, mostly 0.
    """
    own = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    about = own.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters")).first()
    total, letters = about.n, about.letters or 0
    packets, parts = 1 + letters // min(PACKET, max(SMALLEST, letters // SPLIT)), 1 + letters // PART
    marked = F.concat(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N} ][^\p{L}\p{N}]*", MARK), F.lit(MARK))
    n = wanted(F.size(F.array_remove(F.split("text", r"\s+"), "")))
    texts = own.select(F.pmod(F.xxhash64("doc"), F.lit(packets)).alias("packet"), "doc", n.alias("n"), marked.alias("text"))
    # Numbers of their own: packets are small, but much work, and would be put together in few tasks.
    by_packet = texts.repartition(min(2 * packets, 2000), "packet")

    def send(rows: pa.Table) -> pa.Table:
        mine = Packet(rows)
        high, low, order = mine.keys()
        df = np.bincount(mine.phrase, minlength=len(order))[order]
        rest = low.astype("<u8").view("u1").reshape(-1, 8)[:, :REST]
        some, starts = np.unique(high * parts >> 32, return_index=True)
        cuts = list(zip(starts, [*starts[1:], len(order)]))
        lists = [[packed(np.diff(high[x:y], prepend=0)) for x, y in cuts], [rest[x:y].tobytes() for x, y in cuts], [packed(df[x:y]) for x, y in cuts]]
        out = [pa.array([rows["packet"][0].as_py()] * len(some), pa.int64()), pa.array(some), *(pa.array(x, pa.binary()) for x in lists)]
        return given_back(pa.table(out, ["packet", "part", "high", "low", "counts"]))

    def add(rows: pa.Table) -> pa.Table:
        high = [np.cumsum(unpacked(x)) for x in rows["high"].to_pylist()]
        ends = np.cumsum([len(x) for x in high])
        rest = np.zeros((ends[-1], 8), "u1")
        rest[:, :REST] = np.frombuffer(b"".join(rows["low"].to_pylist()), "u1").reshape(-1, REST)
        high, low = np.concatenate(high).astype(np.uint64), rest.view("<u8").ravel()
        counts = np.concatenate([unpacked(x) for x in rows["counts"].to_pylist()])
        order = key_order(high, low)
        first = np.flatnonzero(np.r_[True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])])
        df = np.empty(len(order), np.int64)
        df[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.r_[first, len(order)]))
        df -= counts
        others = [packed(df[x:y]) for x, y in zip(np.r_[0, ends[:-1]], ends)]
        return given_back(pa.table([rows["packet"], rows["part"], pa.array(others, pa.binary())], ["packet", "part", "others"]))

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        mine = Packet(rows)
        order = mine.keys()[2]
        df = np.empty(len(order), np.int64)
        df[order] = np.concatenate([np.empty(0, np.int64), *(unpacked(x) for _, x in sorted(zip(answers["part"].to_pylist(), answers["others"].to_pylist())))])
        doc, phrase, tf = mine.doc, mine.phrase, mine.tf
        df = (df + np.bincount(phrase, minlength=len(df)))[phrase]
        if best:
            pairs = pa.array(tf << 32 | df).dictionary_encode()
            each = [round(1 / (1 + (x >> 32) * (log((total + 1) / ((x & 0xFFFFFFFF) + 1)) + 1)), 9) for x in pairs.dictionary.to_pylist()]
            rank = np.unique(each, return_inverse=True)[1][pairs.indices.to_numpy()] if each else tf
            order = np.argsort(doc * (len(each) + 1) + rank, kind="stable")  # rows of a document stay in the order of phrases
            first = np.searchsorted(doc, np.arange(len(mine.docs)))
            order = order[np.arange(len(doc)) - first[doc] < np.maximum(mine.n * POOL, 2 * FEWEST)[doc]]
            doc, phrase, tf, df = doc[order], phrase[order], tf[order], df[order]
        found = pa.StructArray.from_arrays([mine.spell(phrase), pa.array(tf, pa.int64()), pa.array(df, pa.int64())], ["phrase", "tf", "df"])
        ends = pa.array(np.searchsorted(doc, np.arange(len(mine.docs) + 1)), pa.int32())
        return given_back(pa.table([mine.docs, pa.array(mine.n, pa.int32()), pa.ListArray.from_arrays(ends, found)], ["doc", "n", "phrases"]))

    name = own.schema["doc"].dataType.simpleString()
    sent = by_packet.groupBy("packet").applyInArrow(send, "packet long, part long, high binary, low binary, counts binary")
    answers = sent.repartition(min(2 * parts, 2000), "part").groupBy("part").applyInArrow(add, "packet long, part long, others binary")
    rows = by_packet.groupBy("packet").cogroup(answers.groupBy("packet")).applyInArrow(score, f"doc {name}, n int, phrases array<struct<phrase:string,tf:long,df:long>>")
    return rows.withColumnRenamed("doc", id_col), total


def pool(scored: DataFrame, id_col: str) -> DataFrame:
    """The best phrases of each document, ``POOL`` times as many as it gets; ties by phrase."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("score", "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= F.greatest(F.col("n") * POOL, F.lit(2 * FEWEST)))


def similarity(a: Column, b: Column) -> Column:
    """One less the share of letters to change."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def keyphrases(docs: DataFrame, id_col: str, text_col: str, similar: float = SIMILAR, blocked: list[str] = ()) -> DataFrame:
    """(id, rank, phrase, score): from the best on, phrases that are not like one already taken, filtered, as many as the text gets.

    The choice is a fold over a document's pool, which has at most ``POOL * MOST`` phrases.
    """
    best, total = counted_phrases(docs, id_col, text_col, best=True)
    scored = F.transform("phrases", lambda x: F.struct(score_of(x["tf"], x["df"], total).alias("score"), x["phrase"].alias("phrase")))
    lists = best.select(id_col, "n", F.sort_array(scored).alias("pool"))
    none = F.array().cast("array<struct<score:double,phrase:string>>")
    fresh = lambda done, x: ~F.exists(done, lambda y: similarity(y["phrase"], x["phrase"]) >= similar)
    taken = F.aggregate("pool", none, lambda done, x: F.when(fresh(done, x), F.concat(done, F.array(x))).otherwise(done))
    kept = F.filter(taken, lambda x: valid_phrase(x["phrase"], SHORTEST, list(blocked) or [""], STOPWORDS))
    rows = lists.select(id_col, F.posexplode(F.slice(kept, F.lit(1), F.col("n"))).alias("i", "x"))
    return rows.select(id_col, (F.col("i") + 1).alias("rank"), F.col("x.phrase").alias("phrase"), F.col("x.score").alias("score"))

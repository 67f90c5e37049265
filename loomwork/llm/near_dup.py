"""Operator 10, near-duplicates by fast similarity sketching.

A document is its set of word shingles, as hashes modulo the prime 2**61 - 1. The
sketch has ``COORDS`` coordinates (Dahlgaard, Knudsen and Thorup, 2017): in round
i each element is thrown into a random bin with a random value, and a bin keeps
its smallest (round, value); after as many rounds as there are bins, round
COORDS + b throws every element into bin b, so each coordinate fills, and long
documents fill in one round. Bands of ``ROWS`` coordinates give candidates, and
candidates are verified on full sets: 100 * intersection >= 80 * union. Two sets
at similarity 0.8 share no band with probability (1 - 0.8**6)**64, below 1e-8;
sets that share a few common phrases (similarity 0.03) share one with
probability below 1e-7.

Groups. Equal sets are one class, counted by digest. In a band's bucket every
class is first compared with the bucket's hub (its smallest class), which costs
a group of near copies its size. A hub's spokes are dealt to packs of
``SPOKES``, and each pack gets the hub's set once. What the hubs have linked is
made into components. Only buckets that then still hold different components
are looked at again, each on its own: its classes outside its largest component
are compared with the others. They are dealt to blocks of so many shingles
(``BLOCK_SHINGLES``); a task holds one block as posting lists, streams the other
side through it and reports a spanning forest of the links it finds. No pair is
a row, and no link between different components is lost. Components are found by
joins (smallest neighbour, then pointer doubling).

Defined results: without words or text the set is empty and linked with nothing.
Shorter texts than a shingle are one shingle. Every input row gives one output
row, repeated rows included. Rows without an id are linked with nothing and
kept, with a null component. Rows of one id and different texts are compared by
their own text. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import ascii_lower, cut, releasing, texts

SHINGLE, PERCENT = 5, 80
ROWS, BANDS = 6, 64
COORDS = ROWS * BANDS
#: Spokes of a hub in a pack; shingles of a block that a task holds; classes streamed through a block in one group.
SPOKES, BLOCK_SHINGLES, STREAM = 256, 200_000, 1_024
U64 = np.uint64


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a lower-cased text, sorted."""
    values = spans.word_hashes(text, *spans.split_words(text))
    if not len(values):
        return values
    return np.unique(spans.run_hashes(values, min(shingle, len(values))))


def sketch(elements: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes: ``coords`` values, equal in as many places as sets are similar.

    Rounds go in blocks: a later round never replaces a value of an earlier one,
    so rounds after the last that is needed change nothing.
    """
    out = np.full(coords, ~U64(0), dtype=U64)
    low, step, i = U64((1 << 48) - 1), max(1, 6 * coords // len(elements)), 0
    while i < coords and (out == ~U64(0)).any():
        rounds = np.arange(i, min(i + step, coords), dtype=U64)[:, None]
        h = spans.mix(elements + (rounds + U64(1)) * U64(0x9E3779B97F4A7C15))
        np.minimum.at(out, ((h >> U64(48)) % U64(coords)).astype(np.int64).ravel(), ((h & low) | rounds << U64(48)).ravel())
        i += len(rounds)
    for b in np.flatnonzero(out == ~U64(0)):
        h = spans.mix(elements + U64((coords + int(b) + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        out[b] = ((h & low) | U64(coords + b) << U64(48)).min()
    return out


def band_keys(sketched: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of the sketch."""
    bands = sketched.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)
    for k in range(rows):
        key = spans.mix(key ^ bands[:, k])
    return key.view(np.int64)


MARKS = "doc_id long, text_md5 string, n_shingles long, digest binary, bands array<long>, z binary"


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_md5, n_shingles, digest of the set, band keys (both null if it is empty), the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                sizes, digests, keys, packed = [], [], [], []
                for text in batch.column(2).cast(pa.binary()):
                    text = text.as_py()
                    found = shingle_set(text, shingle)
                    sizes.append(len(found))
                    # 128 bits: two sums of mixed elements, so equal sets have equal digests.
                    pair = np.array([spans.mix(found).sum(dtype=U64), spans.mix(found ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)])
                    digests.append(pair.tobytes() if len(found) else None)
                    keys.append(band_keys(sketch(found)) if len(found) else None)
                    packed.append(coder.compress(text))
                columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_md5", "n_shingles", "digest", "bands", "z"])

    return docs.select("doc_id", F.md5("text").alias("text_md5"), "text").mapInArrow(releasing(run), MARKS)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of ``edges`` (a, b): the smallest id that can be reached.

    Each round points an id to its smallest smaller neighbour and links its other
    smaller neighbours to that one instead, so the edges become fewer until each
    id has one: a forest, whose pointers are then followed by doubling.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    left = cut(edges.where("a != b").select(hi, lo).distinct())
    while True:
        least = cut(left.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("k")))
        if least.where("k > 1").isEmpty():
            break
        open_ = left.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        left = cut(least.select("hi", F.col("m").alias("lo")).union(open_).distinct())
    label = least.select(F.col("hi").alias("id"), F.col("m").alias("root"))
    while True:
        above = label.select(F.col("id").alias("up"), F.col("root").alias("far"))
        new = cut(label.join(above, F.col("root") == F.col("up"), "left").select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        label = new.select("id", "root")
        if new.where("moved").isEmpty():
            # Roots themselves have no pointer.
            return label.union(label.select(F.col("root").alias("id"), "root").distinct())


def similar(both: int, one: int, two: int, percent: int) -> bool:
    return 100 * both >= percent * (one + two - both)


def verified(pairs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough. ``sets``: (id, z).

    The spokes b of a hub a are dealt to packs; the hub's set goes to each pack once, before its spokes.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPOKES).alias("packs"))
    hubs = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack"), F.lit(None).cast("long").alias("b"))
    spokes = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("packs")).alias("pack"), "b")
    text = sets.select("id", "z")
    rows = hubs.join(text, F.col("a") == F.col("id")).union(spokes.join(text, F.col("b") == F.col("id"))).select("a", "pack", "b", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, hub_sets = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            keep = []
            for a, pack, b, z in zip(*batch.columns):
                a, pack, b = a.as_py(), pack.as_py(), b.as_py()
                if (a, pack) != now:
                    now, hub_sets = (a, pack), []
                mine = shingle_set(reader.decompress(z.as_py()), shingle)
                if b is None:
                    hub_sets.append(mine)
                keep.append(b is not None and any(similar(len(np.intersect1d(x, mine, assume_unique=True)), len(x), len(mine), percent) for x in hub_sets))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2)], names=["a", "b"])

    return rows.repartition("a", "pack").sortWithinPartitions("a", "pack", F.col("b").asc_nulls_first()).mapInArrow(releasing(run), "a long, b long")


class Block:
    """Sets of one block as posting lists, and the roots that links have joined."""

    def __init__(self, held: list[tuple[int, int, np.ndarray]]) -> None:
        self.ids, self.roots = [x[0] for x in held], [x[1] for x in held]
        self.sizes = np.array([len(x[2]) for x in held], dtype=np.int64)
        every, owner = np.concatenate([x[2] for x in held]), np.repeat(np.arange(len(held)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.every, self.owner, self.parent = every[order], owner[order], {}

    def root(self, x: int) -> int:
        while self.parent.get(x, x) != x:
            x = self.parent[x]
        return x

    def links(self, name: int, root: int, mine: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """Links of a set with sets of the block that are not yet in one component with it."""
        a, b = np.searchsorted(self.every, mine, "left"), np.searchsorted(self.every, mine, "right")
        found = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
        common = np.bincount(self.owner[found], minlength=len(self.sizes))
        for k in np.flatnonzero(100 * common >= percent * (self.sizes + len(mine) - common)):
            p, q = self.root(root), self.root(self.roots[k])
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                yield name, self.ids[k]


def across_components(members: DataFrame, roots: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket. ``members``: (key, id, hub, size).

    The hub has been compared with all of its bucket and is left out.
    """
    inside = members.where("size > 2 and id != hub").select("key", "id")
    rows = inside.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    per = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    open_ = per.groupBy("key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("n"), F.count("*").alias("k"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    open_ = open_.where("k > 1").select("key", "n", "x", "y", F.col("main.root").alias("main"))
    # Buckets of the same classes need one look: told by their number and 128 bits.
    open_ = open_.groupBy("n", "x", "y", "main").agg(F.min("key").alias("key"))
    classes = rows.join(open_.select("key", "main"), "key").join(sets.select("id", "n_shingles", "z"), "id")
    classes = cut(classes.select("key", "id", "root", "main", "n_shingles", "z"))
    dealt = classes.groupBy("key").agg(
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("blocks"), F.ceil(F.count_if(F.col("root") != F.col("main")) / STREAM).alias("streams")
    )
    both = classes.join(dealt, "key")
    block, stream = F.pmod(F.xxhash64("id"), F.col("blocks")), F.pmod(F.xxhash64("id", F.lit(2)), F.col("streams"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = both.select("key", block.alias("block"), every("streams").alias("stream"), F.lit(0).alias("side"), "id", "root", "z")
    streamed = both.where("root != main").select("key", every("blocks").alias("block"), stream.alias("stream"), F.lit(1).alias("side"), "id", "root", "z")
    group = ["key", "block", "stream"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, held, block = zstandard.ZstdDecompressor(), None, [], None
        for batch in batches:
            found = []
            for row in zip(*batch.columns):
                *key, side, name, root, z = [x.as_py() for x in row]
                if key != now:
                    now, held, block = key, [], None
                mine = shingle_set(reader.decompress(z), shingle)
                if side == 0:
                    held.append((name, root, mine))
                elif held or block:
                    block, held = block or Block(held), []
                    found += block.links(name, root, mine, percent)
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return held.union(streamed).repartition(*group).sortWithinPartitions(*group, "side").mapInArrow(releasing(run), "a long, b long")


def marked_groups(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_md5, n_shingles, component_id, kept for each row."""
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.col("text")).alias("text"))
    marks = cut(sketches(rows, shingle))
    linked = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    filled = marks.where(linked)
    # Classes of equal sets; the map tasks combine, so a set that a third of the documents have is no hot group.
    classes = cut(filled.groupBy("digest").agg(F.min("doc_id").alias("id")))
    of_class = filled.select(F.col("doc_id").alias("id"), "digest", "n_shingles", "bands", "z").join(classes, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    keys = of_class.select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    # Members of buckets with company.
    members = cut(keys.join(buckets, "key").select("key", "id", "hub", "size"))
    near = members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    sets = cut(of_class.select("id", "n_shingles", "z").join(members.select("id").distinct(), "id", "left_semi"))
    sizes = lambda side, name: sets.groupBy(F.col("id").alias(side)).agg(F.min("n_shingles").alias(f"least_{name}"), F.max("n_shingles").alias(f"most_{name}"))
    # Sets whose sizes differ too much are not similar enough, whatever they share.
    fit = (100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a"))
    spokes = cut(near.join(sizes("a", "a"), "a").join(sizes("b", "b"), "b").where(fit).select("a", "b"))
    links = cut(verified(spokes, sets, shingle, percent))
    roots = components(links)
    more = cut(across_components(members, roots, sets, shingle, percent))
    if not more.isEmpty():
        roots = components(links.union(more))
    names = classes.join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    shown = ["doc_id", "text_md5", "n_shingles"]
    found = filled.select(*shown, "digest").join(names, "digest").select(*shown, "component_id")
    alone = marks.where(~linked).select(*shown, F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    return marked_groups(docs, shingle, percent).drop("text_md5")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that stay: the smallest id of each group of near-duplicates. All columns stay.

    Rows that repeat an id and its text count as one document; rows without an id stay.
    """
    kept = marked_groups(docs, shingle, percent).where("kept").select(F.col("doc_id").alias("kept_id"), "text_md5")
    named = docs.where(F.col("doc_id").isNotNull()).withColumns({"kept_id": F.col("doc_id").cast("long"), "text_md5": F.md5(ascii_lower(F.coalesce("text", F.lit(""))))})
    one = named.join(kept, ["kept_id", "text_md5"], "left_semi").dropDuplicates(["kept_id", "text_md5"])
    return one.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))


def query(docs: DataFrame) -> DataFrame:
    return similar_groups(docs, shingle=4, percent=80)

"""Operator 3, substring dedup by windows of words, with a count-min prefilter.

First pass: every packet of documents makes a count-min sketch of its windows of
35 words; added up, the sketches overestimate how often each window stands in
the corpus (see ``spans``). Second pass: only windows estimated as repeated leave
their task, as 128-bit keys of their words, and are grouped exactly. Estimates
are never too small, so no repeated window is lost. Words covered by a repeated
window are removed.

Defined results: null or empty text has no words. A document shorter than the
window loses nothing. Repeated rows are copies of each other, so both lose all
their windows; every input row gives one output row, whatever its id, ids that
repeat or are null included. Other columns are ignored. An empty table gives an
empty result. The packets are dealt out by part once and read by three steps of one
plan, and made again alike if an executor is lost; so ``docs`` has to be a table or
a checkpoint, not rows in changing order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import releasing, text_bytes, texts

WINDOW = 35
#: Repeated windows of a block of exact keys, and words of a packet that are worked on at once.
BLOCK_ENTRIES, PIECE_WORDS = 30_000, 1 << 19
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def windows_of(z: bytes, sizes: list[int], window: int, bases=spans.BASES[:1]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(piece, first words, a hash by each base) of the windows of a packet that lie in one document."""
    text = spans.packet_text(z)
    starts, ends = spans.split_words(text)
    owner = np.searchsorted(spans.packet_starts(sizes), starts, side="right")
    values = [spans.word_hashes(text, starts, ends, base) for base in bases]
    for piece, (a, b) in enumerate(spans.pieces(len(starts), window, PIECE_WORDS)):
        inside = np.flatnonzero(owner[a : b - window + 1] == owner[a + window - 1 : b])
        yield piece, inside + a, [spans.run_hashes(v[a:b], window, base)[inside] for v, base in zip(values, bases)]


def repeated_windows(docs: DataFrame, by_part: DataFrame, window: int) -> DataFrame:
    """(part, places): for each packet the first words of windows that start elsewhere too. ``by_part``: packets of ``docs``."""
    size = text_bytes(docs)
    blocks, buckets = spans.blocks_for(size // 6), spans.buckets_for(size)
    n_exact = max(16, size // 6 // 4 // BLOCK_ENTRIES)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sizes, z in zip(*[batch.column(c).to_pylist() for c in ("part", "sizes", "z")]):
                for piece, _, (keys,) in windows_of(z, sizes, window):
                    yield from spans.partition_sketch(part, piece, keys, blocks)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = spans.KeyPacker(n_exact, width=2)
        for batch in batches:
            for part, sizes, z, answers in zip(*[batch.column(c).to_pylist() for c in ("part", "sizes", "z", "answers")]):
                for piece, places, keys in windows_of(z, sizes, window, spans.BASES):
                    likely = np.flatnonzero(spans.estimated_levels(keys[0], blocks, answers, piece))
                    found.add(part, np.stack([k[likely] for k in keys], axis=1), places[likely])
                    if found.full():
                        yield from found.packets()
        yield from found.packets()

    answers = spans.merged_levels(by_part.mapInArrow(releasing(sketch), spans.SKETCH))
    packed = by_part.join(answers.drop("hot"), "part", "left").mapInArrow(releasing(exact), spans.PACKED)
    return spans.gather(spans.repeated_places(packed, buckets, 2)).withColumnRenamed("doc_id", "part")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words joined by blanks."""
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Dealt by part once: the steps read one exchange, so each asks for all its columns, and joins add no filter to it.
    by_part = spans.packets(rows).repartition("part")
    joined = by_part.join(repeated_windows(rows, by_part, window), "part", "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, z, parts in zip(*[batch.column(c).to_pylist() for c in ("ids", "sizes", "z", "places")]):
                text, out, first = spans.packet_text(z), [], 0
                edges = spans.packet_starts(sizes).tolist()
                places = spans.all_places(parts)
                for doc_id, a, b in zip(ids, edges, edges[1:]):
                    words = text[a : b - 1].split()  # bytes split at blank and \x09-\x0D
                    n = len(words)
                    mine = places[np.searchsorted(places, first) : np.searchsorted(places, first + n)]
                    if len(mine):
                        words = list(compress(words, ~spans.covered(mine - first, window, n)))
                    kept = b" ".join(words)
                    out.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8")))
                    first += n
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return joined.mapInArrow(releasing(keep), KEPT)


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("kept_text")

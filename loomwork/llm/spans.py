"""Finding what repeats in a corpus, in numpy batches: packets, sketches, exact keys.

Documents are packed into packets of a few megabytes, kept compressed in the
shared folder, so that later passes read them by packet and never join on
document ids. Operators 3 and 6 then work in two passes over the packets.

First pass: each packet makes a count-min sketch of its keys (two rows of
cells). A packet's sketch has few cells that are not zero, so it travels as the
list of those, dealt to blocks of cells; merged by addition, the blocks answer
each packet with the levels of its own cells only. An estimate is never too
small. Second pass: only keys that are estimated as repeated leave their task.

Exact keys travel packed too: one row for each task and block. A task sends a
key once, with its first place; later places of the same key in that task are
known to be repeated without any exchange. A key that stands in a third of all
documents is therefore one entry for each task.

Hashes. Words and windows are polynomials modulo the prime 2**61 - 1, for which
two different sequences of n values agree for at most n of the 2**61 bases; two
of them with different bases are a 128-bit key. The cheaper polynomials modulo
2**64 only choose anchors, where equal hashes of different grams do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, releasing, worker_cache

U64 = np.uint64
#: Odd multiplier of the rolling polynomial modulo 2**64, and multipliers of the final mix.
ODD = 0x9E3779B97F4A7C15
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * MIX1
    x = x ^ (x >> U64(27))
    x = x * MIX2
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


def window_hashes(values: np.ndarray, size: int, base: int = ODD) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` values (uint64, already mixed), for choosing anchors only."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    up = powers(base, len(values))
    down = powers(pow(base, -1, 1 << 64), n)
    total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(values * up, dtype=U64)])
    return mix((total[size:] - total[:n]) * down)


def split_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of UTF-8 bytes; blank and \\x09-\\x0D separate them."""
    raw = np.frombuffer(text, dtype=np.uint8)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


# -- hashes that hold ---------------------------------------------------------

PRIME = (1 << 61) - 1
M61, M31 = U64(PRIME), U64((1 << 31) - 1)
#: Two bases, any numbers below the prime.
BASES = (0x1A2F5C9B3D7E8461, 0x0F83B1D6A94C2E75)
#: Values hashed at once, and bytes of a word above which its digest is taken instead of its polynomial.
PIECE, LONG_WORD = 1 << 17, 1 << 14


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & M61) + (x >> U64(61))
    return np.where(x >= M61, x - M61, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both below it: 31-bit halves, 2**62 is 2 and 2**61 is 1."""
    a1, a0, b1, b0 = a >> U64(31), a & M31, b >> U64(31), b & M31
    mid = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << U64(1)) + (mid >> U64(30)) + ((mid & U64((1 << 30) - 1)) << U64(31)) + a0 * b0)


def prime_powers(base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base**0, base**1, ... modulo the prime, by doubling, and their halves; kept in the worker (4 MB)."""

    def make() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.ones(1, dtype=U64)
        while len(out) <= PIECE + LONG_WORD:
            out = np.concatenate([out, times(out, np.full(len(out), pow(base, len(out), PRIME), dtype=U64))])
        out = out[: PIECE + LONG_WORD + 1]
        return out, out & M31, out >> U64(31)

    return worker_cache(("powers", base), make)


def sums(low: np.ndarray, high: np.ndarray, starts: np.ndarray, ends: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Polynomials of [start, end) from 31-bit halves of the terms, moved to one exponent."""
    low, high = (np.concatenate([np.zeros(1, dtype=U64), np.cumsum(x, dtype=U64)]) for x in (low, high))
    a, b = reduced(low[ends] - low[starts]), reduced(high[ends] - high[starts])
    turned = ((b & U64((1 << 30) - 1)) << U64(31)) + (b >> U64(30))  # b * 2**31
    return times(reduced(a + turned), up[len(up) - 1 - starts])


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A hash below the prime for each word, by its bytes."""
    (up, low, high), out, i = prime_powers(base), np.empty(len(starts), dtype=U64), 0
    raw = np.frombuffer(text, dtype=np.uint8)
    long = set(np.flatnonzero(ends - starts > LONG_WORD).tolist())
    stops = sorted({*long, *[k + 1 for k in long], len(starts)})
    for stop in stops:
        while i < stop:
            if i in long:
                digest = hashlib.blake2b(text[starts[i] : ends[i]], digest_size=8, key=base.to_bytes(8, "big")).digest()
                out[i] = int.from_bytes(digest, "big") % PRIME
                i += 1
                continue
            j = min(stop, max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right"))))
            a, b = int(starts[i]), int(ends[j - 1])
            values, n = raw[a:b].astype(U64) + U64(1), b - a
            out[i:j] = sums(values * low[:n], values * high[:n], starts[i:j] - a, ends[i:j] - a, up)
            i = j
    return out


def run_hashes(values: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """A mixed 61-bit hash of each run of ``size`` values below the prime."""
    (up, _, _), found = prime_powers(base), []
    for a, b in pieces(len(values), size, PIECE - size):
        term = times(values[a:b], up[: b - a])
        starts = np.arange(b - a - size + 1)
        found.append(mix(sums(term & M31, term >> U64(31), starts, starts + size, up)))
    return np.concatenate(found) if found else np.empty(0, dtype=U64)


# -- anchors --------------------------------------------------------------------


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the index of its leftmost smallest one."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    # Block-wise prefix and suffix minima: two passes whatever the width.
    rank = values & ~U64(0xFFFF)  # the low bits hold the place in its block, so that the leftmost of equal ones wins
    pad = -len(values) % width
    full = np.concatenate([rank, np.full(pad, ~U64(0), dtype=U64)]).reshape(-1, width)
    place = np.arange(width, dtype=U64)
    forward = np.minimum.accumulate(full | place, axis=1).ravel()
    backward = np.minimum.accumulate((full | place)[:, ::-1], axis=1)[:, ::-1].ravel()
    i = np.arange(n, dtype=np.int64)
    a, b = backward[:n], forward[width - 1 : width - 1 + n]
    block = i // width * width
    at_a = block + (a & U64(0xFFFF)).astype(np.int64)
    at_b = (i + width - 1) // width * width + (b & U64(0xFFFF)).astype(np.int64)
    return np.where((a & ~U64(0xFFFF)) <= (b & ~U64(0xFFFF)), at_a, at_b)


def anchors(values: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(chosen, grams): the anchor's place for each window, and the hash of each gram, over mixed values."""
    grams = window_hashes(values, gram)
    return sliding_argmin(grams, window - gram + 1), grams


#: Bytes whose anchors are looked for at once, so that the arrays stay in the processor's cache; 16 bits tell the places.
ANCHOR_STEP = 1 << 15


def byte_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of ``ODD`` and of its inverse, kept in the worker."""
    return worker_cache(("byte powers", n), lambda: (powers(ODD, n), powers(pow(ODD, -1, 1 << 64), n)))


def anchor_runs(raw: np.ndarray, table: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, keys): where the windows of one anchor begin, and the hash of that anchor.

    The same anchors as ``anchors`` gives for ``table[raw]``: of the grams with the smallest hash (but for its low
    16 bits) in a window the leftmost. The low bits of a hash make room for its place, so the smallest number of a
    window tells both; minima of 2, 4, 8 ... numbers are made one from the other.
    """
    width, most = window - gram + 1, ANCHOR_STEP + window
    up, down = byte_powers(most)
    place, low = np.arange(most, dtype=U64), U64(0xFFFF)
    starts, keys, last = [], [], -1
    for a, b in pieces(len(raw), window, ANCHOR_STEP):
        n = b - a - gram + 1
        total = np.zeros(b - a + 1, dtype=U64)
        np.cumsum(table[raw[a:b]] * up[: b - a], out=total[1:])
        grams = mix((total[gram:] - total[:n]) * down[:n])
        least, have = (grams & ~low) | place[:n], 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: n - width + 1], least[width - have :][: n - width + 1])
        chosen = (least & low).astype(np.int64)
        cuts = np.flatnonzero(np.diff(chosen, prepend=last - a))  # the anchor before this piece may go on
        last = int(chosen[-1]) + a
        starts.append(cuts + a)
        keys.append(grams[chosen[cuts]])
    return (np.concatenate(starts), np.concatenate(keys)) if starts else (np.empty(0, dtype=np.int64), np.empty(0, dtype=U64))


def pieces(n: int, window: int, step: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Parts of a sequence that overlap so that each window lies in one whole; they bound the arrays of long texts."""
    for a in range(0, max(n - window + 1, 0), step):
        yield a, min(a + step + window - 1, n)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """True for each of ``n`` places that lies in [start, start + length) of some start."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0


# -- packets ----------------------------------------------------------------------

PACKET = "part long, ids array<long>, sizes array<long>, n_bytes long, z binary"
#: Bytes of text of a packet; a longer text is a packet of its own.
PACKET_BYTES = 2_000_000


def packets(docs: DataFrame) -> DataFrame:
    """(part, ids, sizes, n_bytes, z): the texts of (doc_id, text), in order, each followed by a newline, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        ids, held, size = [], [], 0

        def packet() -> pa.RecordBatch:
            nonlocal number
            number += 1
            lengths = [len(x) for x in held]
            z = coder.compress(b"".join([x + b"\n" for x in held]))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            columns = [pa.array([v], k) for v, k in zip((number, ids, lengths, sum(lengths), z), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["part", "ids", "sizes", "n_bytes", "z"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                text = text.as_py()
                if held and size + len(text) > PACKET_BYTES:
                    yield packet()
                    ids, held, size = [], [], 0
                ids.append(doc_id.as_py())
                held.append(text)
                size += len(text)
        if held:
            yield packet()

    return docs.mapInArrow(releasing(run), PACKET)


def packet_text(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def packet_starts(sizes: list[int]) -> np.ndarray:
    """Where each text of a packet begins, and the end."""
    return np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)])


# -- count-min sketches -------------------------------------------------------------

#: Cells of a block, cells for each key expected, and rows of a sketch.
CELLS, CELLS_PER_KEY, ROWS = 1 << 22, 8, 2
#: Squeezed bytes of cells, a byte or more each, up to which the sketches of a block are added up by sorting their cells.
FEW = 1 << 16
SKETCH = "block int, part long, piece int, cells binary, counts binary"
LEVELS = "part long, block int, piece int, hot boolean, levels binary"


def blocks_for(keys: int) -> int:
    """Blocks of a row, for about so many keys in the corpus."""
    return max(4, keys * CELLS_PER_KEY // CELLS)


def cells_of(keys: np.ndarray, row: int, blocks: int) -> np.ndarray:
    """The cell of each key in a row of the sketch: the block above, the cell in it below."""
    h = mix(keys + U64((row + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
    return ((h >> U64(32)) % U64(blocks) * U64(CELLS) + (h & U64(CELLS - 1))).astype(np.int64)


def by_blocks(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(block, first, end) of the runs of sorted codes."""
    edges = np.flatnonzero(np.concatenate([[True], np.diff(codes // CELLS) != 0, [True]])) if len(codes) else [0]
    return ((int(codes[a] // CELLS), a, b) for a, b in zip(edges[:-1], edges[1:]))


def partition_sketch(part: int, piece: int, keys: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """A packet's sketch of its keys: the cells that are not zero, by block, and how many keys fell into each (255 stands for more)."""
    rows = []
    for row in range(ROWS):
        codes, counts = np.unique(cells_of(keys, row, blocks), return_counts=True)
        for block, a, b in by_blocks(codes):
            cells = np.diff(codes[a:b] % CELLS, prepend=0).astype(np.uint32)
            rows.append((row * blocks + block, part, piece, squeeze_planes(cells), squeeze(np.minimum(counts[a:b], 255).astype(np.uint8))))
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    for i in range(0, len(rows), 2_000):
        columns = [pa.array(c, k) for c, k in zip(zip(*rows[i : i + 2_000]), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "piece", "cells", "counts"])


def merged_levels(sketches: DataFrame, hot: int = 1 << 30) -> DataFrame:
    """(part, answers, hot): the partition sketches added up, and for each packet the levels of its own cells.

    A level is 0 for a cell of one key, 1 for one of two keys or more, 2 for one of more than ``hot``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in runs_of_first(batches):
            if sum(len(x[3]) for x in rows) < FEW:  # few cells are sorted, the block is not laid out
                cells = [np.cumsum(expand_planes(x[3], np.uint32)) for x in rows]
                _, at = np.unique(np.concatenate(cells), return_inverse=True)
                added = np.bincount(at, np.concatenate([expand(x[4], np.uint8) for x in rows])).astype(np.int64)[at]
                levels = np.split((added > 1).astype(np.uint8) + (added > hot), np.cumsum([len(x) for x in cells])[:-1])
            else:
                total = np.zeros(CELLS, dtype=np.int64) if total is None else total
                total[:] = 0
                for _, _, _, cells, counts in rows:
                    total[np.cumsum(expand_planes(cells, np.uint32))] += expand(counts, np.uint8)  # a packet has a cell once
                level, levels = (total > 1).astype(np.uint8) + (total > hot), None
            for i in range(0, len(rows), 1_000):
                few = rows[i : i + 1_000]
                block, part, piece, cells, _ = zip(*few)
                answers = levels[i : i + 1_000] if levels is not None else [level[np.cumsum(expand_planes(c, np.uint32))] for c in cells]
                columns = [part, block, piece, [bool((x > 1).any()) for x in answers], [squeeze(x) for x in answers]]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "block", "piece", "hot", "levels"])

    merged = sketches.repartition("block").sortWithinPartitions("block").mapInArrow(releasing(run), LEVELS)
    return merged.groupBy("part").agg(F.collect_list(F.struct("piece", "block", "levels")).alias("answers"), F.max("hot").alias("hot"))


def runs_of_first(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows with one value in the first column at a time, from batches sorted by it."""
    now, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[0] != now:
                yield held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield held


def estimated_levels(keys: np.ndarray, blocks: int, answers: list[dict], piece: int) -> np.ndarray:
    """The level of each key of a packet: the smallest of its cells', which is never too small."""
    known = {x["block"]: x["levels"] for x in answers if x["piece"] == piece}
    best = None
    for row in range(ROWS):
        codes, at = np.unique(cells_of(keys, row, blocks), return_inverse=True)
        level = np.concatenate([expand(known[row * blocks + block], np.uint8) for block, _, _ in by_blocks(codes)] or [np.empty(0, np.uint8)])
        best = level[at] if best is None else np.minimum(best, level[at])
    return best


# -- packed keys ------------------------------------------------------------


PACKED = "block int, local boolean, keys binary, docs binary, places binary, counts binary, text binary"
PACKED_ARROW = pa.schema(
    [("block", pa.int32()), ("local", pa.bool_()), *[(c, pa.binary()) for c in ("keys", "docs", "places", "counts", "text")]]
)
#: ``places`` are int64: a start, or a start and a length as start << 32 | length.
HITS = "bucket int, docs binary, places binary"
HITS_ARROW = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("places", pa.binary())])


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def expand(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def squeeze_planes(array: np.ndarray) -> bytes:
    """Squeezed byte by byte of the values, as their higher bytes are mostly zero."""
    return squeeze(np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T)


def expand_planes(data: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(expand(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def delta(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values[:1] * 0)


class KeyPacker:
    """Collects (key, document, place) of a task and packs them by block.

    Keys are rows of ``width`` uint64 words. ``limit`` entries are held at most;
    then a packet is sent and collecting starts anew, which bounds memory and
    costs at most one more entry for a key.
    """

    def __init__(self, blocks: int, width: int = 1, limit: int = 1_000_000) -> None:
        self.blocks, self.width, self.limit = blocks, width, limit
        self.keys: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int, keys: np.ndarray, places: np.ndarray) -> None:
        if len(places):
            self.keys.append(keys.reshape(-1, self.width))
            self.docs.append(np.full(len(places), doc_id, dtype=np.int64))
            self.places.append(places.astype(np.int64))
            self.held += len(places)

    def full(self) -> bool:
        return self.held >= self.limit

    def packets(self) -> list[pa.RecordBatch]:
        if not self.held:
            return []
        keys, docs, places = np.concatenate(self.keys), np.concatenate(self.docs), np.concatenate(self.places)
        self.keys, self.docs, self.places, self.held = [], [], [], 0
        order = np.lexsort(keys.T[::-1])  # stable, so the first of equal keys is the first added
        ranked = keys[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(order)))
        twice = np.repeat(counts > 1, counts)
        local = np.sort(order[twice])  # these keys stand in this task more than once
        rows = [local_row(docs[local[i : i + 4096]], places[local[i : i + 4096]], self.blocks) for i in range(0, len(local), 4096)]
        first = order[heads]
        block = block_of(keys[first], self.blocks)
        by = np.lexsort((first, block))
        first, block, counts = first[by], block[by], counts[by]
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            at = first[a:b]
            rows.append(
                (int(block[a]), False, keys[at].tobytes(), squeeze(delta(docs[at])), squeeze(delta(places[at])), squeeze(counts[a:b]), None)
            )
        return packed_batches(rows)


def local_row(docs: np.ndarray, places: np.ndarray, blocks: int) -> tuple:
    """Places that are known to be repeated; the block only spreads such rows."""
    block = -1 - int(mix(docs[:1].astype(U64))[0] % U64(blocks))
    return block, True, None, squeeze(delta(docs)), squeeze(delta(places)), None, None


def packed_batches(rows: list[tuple], size: int = 500) -> list[pa.RecordBatch]:
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    return [
        pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), PACKED_ARROW)], schema=PACKED_ARROW)
        for part in parts
    ]


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(keys[:, 0] ^ U64(0x5851F42D4C957F2D)) % U64(blocks)).astype(np.int64)


def repeated_places(packed: DataFrame, buckets: int, width: int) -> DataFrame:
    """Hits (see ``gather``): the places whose key, compared in full, stands more than once in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = HitPacker(buckets)
        for rows in by_block(batches):
            entries = []
            for _, local, keys, docs, places, counts, _ in rows:
                if local:
                    hits.add(undo(docs), undo(places))
                else:
                    entries.append((np.frombuffer(keys, dtype=U64).reshape(-1, width), undo(docs), undo(places), expand(counts, np.int64)))
            if entries:
                keys, docs, places, counts = map(np.concatenate, zip(*entries))
                total = exact_totals(keys, counts)
                hits.add(docs[total > 1], places[total > 1])
            if hits.held > 2_000_000:
                yield from hits.packets()
        yield from hits.packets()

    return packed.repartition("block").sortWithinPartitions("block").mapInArrow(releasing(run), HITS)


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one block at a time, from batches sorted by block."""
    now, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and (row[0] != now or row[1]):
                yield held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield held


def undo(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.int64))


def exact_totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each entry, how often its key stands in the corpus."""
    order = np.lexsort(keys.T[::-1])
    ranked = keys[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    total = np.empty(len(order), dtype=np.int64)
    total[order] = sums[np.cumsum(new) - 1]
    return total


class HitPacker:
    """Collects reported places and packs them by buckets of documents, one row for each task and bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.docs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.held = 0

    def add(self, docs: np.ndarray, places: np.ndarray) -> None:
        self.docs.append(docs)
        self.places.append(places)
        self.held += len(docs)

    def packets(self) -> Iterator[pa.RecordBatch]:
        rows = []
        if self.held:
            docs, places = np.concatenate(self.docs), np.concatenate(self.places)
            bucket = (mix(docs.astype(U64)) % U64(self.buckets)).astype(np.int64)
            order = np.lexsort((places, docs, bucket))
            docs, places, bucket = docs[order], places[order], bucket[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            rows += [(int(bucket[a]), squeeze(delta(docs[a:b])), squeeze(delta(places[a:b]))) for a, b in zip(edges[:-1], edges[1:])]
        self.docs, self.places, self.held = [], [], 0
        for i in range(0, len(rows), 500):
            part = list(zip(*rows[i : i + 500]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(part, HITS_ARROW)], schema=HITS_ARROW)


def buckets_for(size: int) -> int:
    """Buckets of documents, one for about 8 MB of text."""
    return max(16, size // 8_000_000)


def gather(hits: DataFrame) -> DataFrame:
    """(doc_id, places): one row for each document with hits, its distinct places packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, docs, places in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != now and held:
                    yield from by_document(held)
                    held = []
                now = bucket
                held.append((undo(docs), undo(places)))
        if held:
            yield from by_document(held)

    return hits.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(releasing(run), "doc_id long, places binary")


def by_document(held: list) -> Iterator[pa.RecordBatch]:
    docs, places = map(np.concatenate, zip(*held))
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (places[1:] != places[:-1])])
    docs, places = docs[new], places[new]
    edges = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1], [True]]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(docs[edges[:-1]]), pa.array([squeeze(delta(places[a:b])) for a, b in zip(edges[:-1], edges[1:])], pa.binary())],
        names=["doc_id", "places"],
    )


def all_places(packed: bytes | None) -> np.ndarray:
    """The places of a gathered row, sorted."""
    return undo(packed) if packed else np.empty(0, dtype=np.int64)


def squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, z): the texts as compressed UTF-8, so that shuffling them moves less than half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([coder.compress(x) for x in texts], pa.binary())], names=["doc_id", "z"]
            )

    return docs.mapInArrow(releasing(run), "doc_id long, z binary")

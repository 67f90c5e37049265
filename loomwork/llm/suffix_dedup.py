"""Operator 6, suffix-array dedup: maximal repeats from the common-prefix interval tree.

The suffixes of the corpus are dealt to groups that can be sorted apart. Every
200-byte window has an anchor (see ``spans``): of the grams in it the one with
the smallest hash. Windows that are equal have equal anchors at equal offsets,
so suffixes of one anchor hash form a group. A packet sends, for a run of windows
of one anchor, the bytes of that run. In its group each suffix of at least 200
bytes is sorted into a suffix array with common-prefix lengths; a stack scan
gives the intervals of the common-prefix tree, and an interval whose suffixes
have different bytes on their left is a maximal repeat, with all its
occurrences. Bytes covered by one are removed.

Packets count their runs by anchor in count-min sketches first; runs whose anchor
stands once stay where they are. A group has at most ``GROUP_RUNS`` different
runs, whatever the input: an anchor that may have more is split by a deeper
prefix. Its runs go to the next level, where anchors are longer grams of the
same windows (``GRAMS``), so they are dealt to more groups. At the last level the
gram is the whole window, a group's runs are equal, and it needs no bound. Each
level uses the suffix array, and equal runs of a packet are sent once.

Runs end where the anchor changes, so a repeat longer than a run is found in
several groups; its parts overlap and are merged in each document.

Defined results: null text is empty. A document of fewer than 200 bytes loses
nothing. Repeated rows are copies of each other, so both lose all; every input
row gives one output row, whatever its id, ids that repeat or are null included.
Other columns are ignored. An empty table gives an empty result. The packets are
made from the documents once and written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import cut, releasing, text_bytes, texts

LENGTH = 200
#: Bytes of an anchor by level; the last is the whole window.
GRAMS = (100, 150, 180, 200)
#: Different runs in a group of suffixes, at most.
GROUP_RUNS = 1_000
#: A mixed 64-bit value for each byte value.
BYTES = spans.mix(np.arange(1, 257, dtype=np.uint64))
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
#: A packet of segments: whole documents at first, runs at deeper levels, and where each begins in the packet of documents (null: there).
SEGMENTS = "part long, sizes array<long>, origins array<long>, z binary"


def common_prefix(a: bytes, b: bytes, at_least: int) -> int:
    """Length of the common prefix; 0 if it is shorter than ``at_least``."""
    if a[:at_least] != b[:at_least]:
        return 0
    low, high = at_least, min(len(a), len(b))
    while low < high:  # halving: slices compare at memory speed
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each interval of the common-prefix tree; ``lcp[i]`` is of suffixes i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeat_intervals(runs: list[tuple[bytes, int]], length: int) -> tuple[list[tuple[int, int]], Iterator[tuple[int, int, int]]]:
    """((run, offset) of the suffixes in order, (length, first, last) of the maximal repeats among them).

    A run is its bytes and how many suffixes of it count; what stands left of a
    run is not known, so its first suffix is taken as different from any other.
    Longer repeats come before the shorter ones that enclose them.
    """
    suffixes = sorted((data[j:], r, j) for r, (data, n) in enumerate(runs) for j in range(n))
    lcp = [0] + [common_prefix(a[0], b[0], length) for a, b in zip(suffixes, suffixes[1:])]
    places = [s[1:] for s in suffixes]
    del suffixes
    # A number for each suffix that changes where the byte on its left does.
    changes = [0]
    for (r, j), (q, k) in zip(places, places[1:]):
        differ = j == 0 or k == 0 or runs[r][0][j - 1] != runs[q][0][k - 1]
        changes.append(changes[-1] + differ)
    return places, ((size, a, b) for size, a, b in intervals(lcp) if changes[b] > changes[a])


def maximal_repeats(runs: list[tuple[bytes, int]], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(run, offset)]): the maximal repeats of ``length`` bytes or more, with all occurrences."""
    places, found = repeat_intervals(runs, length)
    return ((size, places[a : b + 1]) for size, a, b in found)


def group_repeats(rows: list[tuple[bytes, int, int, int]], length: int) -> Iterator[tuple[int, int, int]]:
    """(document, start, length) of the longest repeat at each place of the runs (bytes, suffixes, document, start) of one anchor."""
    places: dict[bytes, list[tuple[int, int]]] = {}
    count: dict[bytes, int] = {}
    for data, n, doc, start in rows:
        places.setdefault(data, []).append((doc, start))
        count[data] = n
    runs = list(count.items())
    for data, n in runs:
        if len(places[data]) > 1:  # the whole run repeats
            for doc, start in places[data]:
                yield doc, start, n + length - 1
    if len(runs) < 2:
        return
    order, found = repeat_intervals(runs, length)
    # Enclosing repeats come later and are shorter, so the first that has a suffix is its
    # longest; what is settled is skipped, and nested repeats cost no more than one pass.
    after = list(range(len(order) + 1))

    def unsettled(k: int) -> int:
        while after[k] != k:
            after[k] = after[after[k]]
            k = after[k]
        return k

    for size, first, last in found:
        k = unsettled(first)
        while k <= last:
            r, j = order[k]
            for doc, start in places[runs[r][0]]:
                yield doc, start + j, size
            after[k] = k + 1
            k = unsettled(k + 1)


def runs_of(z: bytes, sizes: list[int], origins: list[int] | None, length: int, gram: int, digests: bool = True) -> Iterator[tuple]:
    """(piece, text, firsts, ends, keys, digests, places) of a packet of segments: the runs of windows of one anchor.

    ``text[first : end + length - 1]`` are the bytes of a run, its key is the anchor's hash, its digest a hash of its
    bytes if asked for, its place is in the packet of documents.
    """
    text = spans.packet_text(z)
    raw, edges = np.frombuffer(text, dtype=np.uint8), spans.packet_starts(sizes)
    # Where windows that lie in one segment begin, and behind the last of them; the newline behind each segment counts as one byte of it.
    a, b = edges[:-1], np.maximum(edges[1:] - length, edges[:-1])
    a, b = a[b > a], b[b > a]
    shift = np.array(origins, dtype=np.int64) - edges[:-1] if origins else np.zeros(len(sizes), dtype=np.int64)
    for piece, (low, high) in enumerate(spans.pieces(len(raw), length)):
        starts, hashes = spans.anchor_runs(raw[low:high], BYTES, length, gram)
        starts = starts + low
        # Runs end where the anchor or the segment changes.
        firsts = np.union1d(starts, a[(a > low) & (a <= high - length)])
        ends = np.append(firsts[1:], high - length + 1)
        segment = np.searchsorted(a, firsts, side="right") - 1
        ends = np.where(segment >= 0, np.minimum(ends, b[segment] if len(b) else 0), firsts)
        real = ends > firsts
        firsts, ends = firsts[real], ends[real]
        keys = hashes[np.searchsorted(starts, firsts, side="right") - 1]
        places = firsts + shift[np.searchsorted(edges, firsts, side="right") - 1]
        # At most length - gram + 1 windows in a row have one anchor.
        marks = run_digests(raw[low:high], firsts - low, ends + length - 1 - low, 2 * length) if digests else None
        yield piece, text, firsts, ends, keys, marks, places


def run_digests(raw: np.ndarray, firsts: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """A hash of each run of at most so many bytes, for counting only: two runs that it confuses are counted as copies, which still are two."""
    up, down = spans.byte_powers(spans.ANCHOR_STEP + longest)
    out = np.empty(len(firsts), dtype=np.uint64)
    steps = range(0, len(raw), spans.ANCHOR_STEP)
    for a, i, j in zip(steps, np.searchsorted(firsts, steps), np.searchsorted(firsts, [x + spans.ANCHOR_STEP for x in steps])):
        values = BYTES[raw[a : a + spans.ANCHOR_STEP + longest]]
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        first, end = firsts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[end] - total[first]) * down[first] + (end - first).astype(np.uint64)
    return out


def twice_at_most(keys: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The keys without the third and further runs of one digest."""
    order = np.argsort(digests, kind="stable")
    ranked, kept = digests[order], np.ones(len(order), dtype=bool)
    kept[2:] = ranked[2:] != ranked[:-2]
    return keys[order[kept]]


def repeated_spans(docs: DataFrame, stored: DataFrame, by_part: DataFrame, length: int, grams: tuple[int, ...], limit: int, every: bool = False) -> DataFrame:
    """Hits (part, start << 32 | length) of repeats; with ``every`` the maximal repeats themselves, with all occurrences."""
    size = text_bytes(docs)
    buckets, found = spans.buckets_for(size), []
    n_group = max(16, size // 4 // (length - grams[0] + 1) // 2_000)
    segments, dealt = [x.withColumn("origins", F.lit(None).cast("array<long>")) for x in (stored, by_part)]
    for level, gram in enumerate(grams):
        last = level == len(grams) - 1
        answers = cut(sketched(segments, size, length, gram, limit))
        chosen = dealt.join(answers, "part", "left")
        sent = chosen.mapInArrow(releasing(sender(length, gram, size, n_group, last, every)), spans.PACKED)
        grouped = sent.repartition("block").sortWithinPartitions("block")
        found.append(grouped.mapInArrow(releasing(listing(length)), REPEATS) if every else grouped.mapInArrow(releasing(comparing(length, buckets)), spans.HITS))
        if last or answers.where("hot").isEmpty():
            break
        segments = cut(chosen.where("hot").mapInArrow(releasing(deeper(length, gram, size)), SEGMENTS))
        # By number: few bytes of runs that overlap are much work, and would else be dealt to few tasks.
        segments = dealt = segments.repartition(tasks_of(size), "part")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def tasks_of(size: int) -> int:
    """Tasks over the packets, one for about 16 MB of text."""
    return max(16, size // 16_000_000)


def sketched(segments: DataFrame, size: int, length: int, gram: int, limit: int) -> DataFrame:
    """(part, answers, hot): the levels of each packet's anchors, and whether some may have more than ``limit`` runs."""
    blocks = blocks_of(size, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sizes, origins, z in zip(*[batch.column(c).to_pylist() for c in ("part", "sizes", "origins", "z")]):
                for piece, _, _, _, keys, digests, _ in runs_of(z, sizes, origins, length, gram):
                    # Twice at most for equal runs: that shows a repeat, and copies do not make an anchor look varied.
                    yield from spans.partition_sketch(part, piece, twice_at_most(keys, digests), blocks)

    return spans.merged_levels(segments.mapInArrow(releasing(run), spans.SKETCH), limit)


def blocks_of(size: int, length: int, gram: int) -> int:
    return spans.blocks_for(2 * size // (length - gram + 2))


def leveled(part_rows: list, length: int, gram: int, size: int, least: int = 1) -> Iterator[tuple[bytes, list, int]]:
    """(bytes, [key, windows, places...], level) of the runs of a packet with its answers, of the least level or a higher one."""
    sizes, origins, z, answers = part_rows
    for piece, text, firsts, ends, keys, _, places in runs_of(z, sizes, origins, length, gram, digests=False):
        if not len(keys):
            continue
        levels = spans.estimated_levels(keys, blocks_of(size, length, gram), answers, piece)
        some, runs = np.flatnonzero(levels >= least), {}
        columns = firsts[some], ends[some], keys[some].view(np.int64), places[some], levels[some]
        for first, end, key, place, level in zip(*[x.tolist() for x in columns]):
            runs.setdefault(text[first : end + length - 1], ([key, end - first], level))[0].append(place)
        for data, (run, level) in runs.items():
            yield data, run, level


def sender(length: int, gram: int, size: int, n_group: int, last: bool, every: bool):
    """Sends the runs whose anchor is estimated as repeated, but hot ones at the last level only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[tuple[int, bytes], list] = {}
        held = 0
        for batch in batches:
            for part, *rows in zip(*[batch.column(c).to_pylist() for c in ("part", "sizes", "origins", "z", "answers")]):
                for data, (key, n, *places), level in leveled(rows, length, gram, size):
                    if level == 1 or level == 2 and last:
                        runs.setdefault((key, data), [n]).extend((part, s) for s in places)
                        held += len(data) + 16 * len(places)
                    elif level == 2 and len(places) > 1 and not every:  # the whole run repeats; only its first place goes on
                        runs.setdefault((key, data), [None]).extend((part, s) for s in places)
                        held += 16 * len(places)
                if held > 48_000_000:
                    yield from run_packets(runs, n_group, length, every)
                    runs, held = {}, 0
        yield from run_packets(runs, n_group, length, every)

    return run


def deeper(length: int, gram: int, size: int):
    """Packets of the runs of hot anchors, each different one once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, *rows in zip(*[batch.column(c).to_pylist() for c in ("part", "sizes", "origins", "z", "answers")]):
                hot = [(data, run[2]) for data, run, _ in leveled(rows, length, gram, size, 2)]
                if hot:
                    columns = [[part], [[len(d) for d, _ in hot]], [[s for _, s in hot]], [coder.compress(b"".join([d + b"\n" for d, _ in hot]))]]
                    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "sizes", "origins", "z"])

    return run


def groups_of(rows: list[tuple], length: int) -> Iterator[tuple[int, list]]:
    """(key, [(bytes, windows, part, place)]) of the groups of a block."""
    groups: dict[int, list] = {}
    for _, local, keys, parts, places, counts, text in rows:
        if not local:
            for key, n, part, start, data in unpack_runs(keys, parts, places, counts, text, length):
                groups.setdefault(key, []).append((data, n, part, start))
    return ((key, group) for key, group in groups.items() if len(group) > 1)


def comparing(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = spans.HitPacker(buckets)
        for rows in spans.by_block(batches):
            for _, local, _, parts, places, _, _ in rows:
                if local:
                    out.add(spans.undo(parts), spans.undo(places))
            for _, group in groups_of(rows, length):
                found = list(group_repeats(group, length))
                if found:
                    parts, starts, sizes = np.array(found, dtype=np.int64).T
                    out.add(parts, (starts << 32) | sizes)
            if out.held > 2_000_000:
                yield from out.packets()
        yield from out.packets()

    return run


REPEATS = "repeat binary, length int, part long, start long"


def listing(length: int):
    """Rows of the maximal repeats of each group: (repeat, length, part, start), one for each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in spans.by_block(batches):
            for _, group in groups_of(rows, length):
                places: dict[bytes, list] = {}
                count: dict[bytes, int] = {}
                for data, n, part, start in group:
                    places.setdefault(data, []).append((part, start))
                    count[data] = n
                runs = list(count.items())
                out = [(hashlib.md5(d).digest(), len(d), p, s) for d, at in places.items() if len(at) > 1 for p, s in at]
                for size, members in maximal_repeats(runs, length):
                    name = hashlib.md5(runs[members[0][0]][0][members[0][1] :][:size]).digest()
                    out += [(name, size, p, s + j) for r, j in members for p, s in places[runs[r][0]]]
                for i in range(0, len(out), 100_000):
                    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*out[i : i + 100_000]), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=["repeat", "length", "part", "start"])

    return run


def run_packets(runs: dict, blocks: int, length: int, every: bool = False) -> list[pa.RecordBatch]:
    """A task's runs by block, each once (``every``: with all its places); a run that stands twice in the task is known to repeat."""
    by: dict[int, list] = {}
    docs, places = [], []
    for (key, data), (n, *at) in runs.items():
        if len(at) > 1 and not every:
            docs += [d for d, _ in at]
            places += [(s << 32) | len(data) for _, s in at]
        if n is not None:
            by.setdefault(key % blocks, []).extend((key, n, *x, data) for x in (at if every else at[:1]))
    d, p = np.array(docs, dtype=np.int64), np.array(places, dtype=np.int64)
    rows = [spans.local_row(d[i : i + 4096], p[i : i + 4096], blocks) for i in range(0, len(d), 4096)]
    for block, found in by.items():
        keys, ns, ids, starts, data = zip(*found)
        rows.append(
            (
                block,
                False,
                np.array(keys, dtype=np.int64).tobytes(),
                spans.squeeze(spans.delta(np.array(ids, dtype=np.int64))),
                spans.squeeze(spans.delta(np.array(starts, dtype=np.int64))),
                spans.squeeze(np.array(ns, dtype=np.int64)),
                zstandard.ZstdCompressor(level=1).compress(b"".join(data)),
            )
        )
    return spans.packed_batches(rows, 100)


def unpack_runs(keys: bytes, docs: bytes, places: bytes, counts: bytes, text: bytes, length: int) -> Iterator[tuple]:
    data, at = zstandard.ZstdDecompressor().decompress(text), 0
    for key, doc, start, n in zip(np.frombuffer(keys, np.int64).tolist(), spans.undo(docs).tolist(), spans.undo(places).tolist(), spans.expand(counts, np.int64).tolist()):
        end = at + n + length - 1
        yield key, n, doc, start, data[at:end]
        at = end


def cut_as_dealt(rows: DataFrame) -> DataFrame:
    """``cut`` that keeps how the rows are dealt, which the session forgets where a plan may still change while it runs."""
    conf = rows.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(rows.select("*"))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def named(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))


def dedup(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, group_runs: int = GROUP_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    rows = named(docs)
    # Dealt by part and written once, by number, so that the joins know how it is dealt: no later step makes or moves packets again.
    by_part = cut_as_dealt(spans.packets(rows).repartition(tasks_of(text_bytes(rows)), "part"))
    marks = spans.gather(repeated_spans(rows, by_part, by_part, length, grams, group_runs)).withColumnRenamed("doc_id", "part")
    joined = by_part.join(marks, "part", "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, z, parts in zip(*[batch.column(c).to_pylist() for c in ("ids", "sizes", "z", "places")]):
                text, out = spans.packet_text(z), []
                raw, edges = np.frombuffer(text, dtype=np.uint8), spans.packet_starts(sizes).tolist()
                places = spans.all_places(parts)
                gone = spans.covered(places >> 32, places & 0xFFFFFFFF, len(raw))
                for doc_id, a, b in zip(ids, edges, edges[1:]):
                    mine = gone[a : b - 1]
                    removed = int(mine.sum())
                    kept = raw[a : b - 1][~mine].tobytes() if removed else text[a : b - 1]
                    n_spans = int((np.diff(mine.astype(np.int8), prepend=0) == 1).sum()) if removed else 0
                    out.append((doc_id, b - 1 - a, removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return joined.mapInArrow(releasing(keep), KEPT)


def repeats(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """repeat (digest of its bytes), length, doc_id, start: the maximal repeat groups, a row for each occurrence.

    Maximal within the runs of one anchor: a longer repeat is several groups
    whose occurrences overlap.
    """
    rows = named(docs)
    stored = spans.packets(rows)
    # Runs of one anchor share a whole gram; all levels but the last would be hot only beyond any bound.
    found = repeated_spans(rows, stored, stored, length, grams, 1 << 29, every=True)
    starts = stored.select("part", F.posexplode("ids").alias("k", "doc_id"), "sizes").select(
        "part", "doc_id", F.aggregate(F.slice("sizes", 1, F.col("k")), F.lit(0).cast("long"), lambda a, n: a + n + 1).alias("at"), F.get("sizes", F.col("k")).alias("n")
    )
    return (
        found.join(starts, "part")
        .where("start >= at and start < at + n")
        .select("repeat", "length", "doc_id", (F.col("start") - F.col("at")).alias("start"))
    )


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("kept")

"""Operator 4, BPE encoding and decoding with content-defined chunk reuse.

1. A rolling hash over the last bytes before white space cuts texts into chunks,
   so passages that documents share fall into the same chunks wherever they
   stand. Unbroken words longer than ``LONG_WORD`` are cut inside, too.
2. Packets of documents count the digests of their chunks in sketches (see
   ``spans``); added up, they tell each packet which of its chunks may stand
   elsewhere. Those are dealt to blocks by content, a packet sends one once, and
   a block encodes each different chunk once and answers every packet that has
   it. A chunk that a third of all documents have is one entry for each packet.
   All other chunks stand once in the corpus and are encoded where they are.
3. Joins are repaired: the pieces on both sides of each cut are encoded together
   and compared with their own encodings; while the result differs, the region
   that is encoded together grows, until it agrees exactly.
4. Ids of a document are put together, and decoded.

Joins at white space are checked with the words next to them, since pre-tokenizers
look no further there; joins inside a long word with all of both pieces. The
tokenizer file is a parameter and is only read, never copied or trained.

Words of new chunks are looked up in a table of words that the task encoded
before; it is bounded by ``WORDS`` and let go with its task, and only saves time.
Words of plain letters are taken to the merges directly, if that gives the
library's ids for the first words of the task (``Words``).

The packets are dealt out by part once and read by three steps of one plan, and made
again alike if an executor is lost; so ``docs`` has to be a table or a checkpoint,
not rows in changing order.

Defined results: null text is empty and gives no token. Every input row gives
one output row, repeated rows included, whatever its id; other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import releasing, text_bytes, texts, worker_cache
from .spans import expand, expand_planes, squeeze, squeeze_planes

#: A chunk ends where the rolling hash of the ``ROLL`` bytes before white space is 0 modulo ``CHUNK_WORDS``.
ROLL, CHUNK_WORDS = 8, 32
#: Unbroken words longer than this are cut at edges of their letter runs.
LONG_WORD = 4096
EDGE = re.compile(r"(?<=[^\W\d_])(?=[\W\d_])|(?<=[\W\d_])(?=[^\W\d_])")
#: What separates words, as ``bytes.split`` has it.
BLANK = b" \t\n\r\x0b\x0c"
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
#: Words that a task keeps, and characters of a chunk on average, for the size of the sketches.
WORDS, CHUNK_BYTES = 400_000, 200
#: Chunks that travel: their text, or the ids that answer it, one after the other, and their numbers in the packet.
SENT = "block long, part long, data binary, sizes binary, numbers binary"
NAMES, KINDS = ["block", "part", "data", "sizes", "numbers"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
ENCODED = "doc_id long, ids array<int>, decoded string"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file; the package that has it is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; kept in the worker, as it does not grow."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        return found

    return worker_cache(("tokenizer", path), make)


class Words:
    """Ids of words as packed int32, each word encoded once while the table has it."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.marks = dict(zip(".,;:!?", self.encode([m.encode() for m in ".,;:!?"])))
        self.letters: dict[int, str] | None = self.letter_table()
        #: Whether white space only separates: then words are encoded one by one, else chunks as they are.
        probes = [b"It's" + s + b"so1" for s in (b" ", b"\n", b"  ", b"\t \r\n", b"\x0b", b"\x0c")]
        one, two = self.encode([b"It's", b"so1"])
        self.apart = all(x == one + two for x in self.encode(probes))

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        plain = [p.decode("utf-8", "replace") for p in pieces]
        found = self.tokenizer.encode_batch_fast(plain, add_special_tokens=False) if plain else []
        return [array("i", e.ids).tobytes() for e in found]

    def letter_table(self) -> dict[int, str] | None:
        """What the tokenizer makes of each plain letter before the merges; None if that is not one piece."""
        normal, pieces = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        table = {}
        for c in filter(str.isalpha, map(chr, range(65, 256))):
            if not PLAIN.fullmatch(c):
                continue
            found = pieces.pre_tokenize_str(normal.normalize_str(c) if normal else c) if pieces else []
            if len(found) != 1:
                return None
            table[ord(c)] = found[0][0]
        return table

    def of_chunks(self, chunks: list[bytes]) -> list[bytes]:
        if not self.apart:
            return self.encode(chunks)
        split = [c.split() for c in chunks]
        flat, at, out = self.of([w for ws in split for w in ws]), 0, []
        for ws in split:
            out.append(b"".join(flat[at : at + len(ws)]))
            at += len(ws)
        return out

    def plain(self, letters: str, mark: str) -> bytes:
        piece = letters.translate(self.letters)
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = array("i", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()
        return ids + self.marks[mark] if mark else ids

    def of(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > WORDS // 2:  # those not used of late are let go
            self.older, self.known, self.pieces = self.known, {}, {}
        known, older = self.known, self.older
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        other = []
        for w in fresh:
            if w in older:
                known[w] = older[w]
            elif self.letters and (m := PLAIN.fullmatch(w.decode("utf-8", "replace"))):
                known[w] = self.plain(*m.groups())
            else:
                other.append(w)
        known.update(zip(other, self.encode(other)))
        if self.letters is not None and fresh and not older and len(known) < 5_000:
            # The first words of a task go both ways; one difference, and all words go to the library.
            if any(known[w] != ids for w, ids in zip(fresh, self.encode(fresh))):
                self.letters = None
                known.update(zip(fresh, self.encode(fresh)))
        return [known[w] for w in words]


def cut(text: bytes, sizes: list[int]) -> list[list[bytes]]:
    """Content-defined chunks of each text of a packet (each followed by a newline); put together they are the text."""
    raw, starts = np.frombuffer(text, dtype=np.uint8), spans.packet_starts(sizes)
    white = np.flatnonzero((raw == 32) | (raw == 10) | (raw == 13) | (raw == 9))
    inner = white[white - starts[np.searchsorted(starts, white, side="right") - 1] >= ROLL]
    rolled = np.zeros(len(inner), dtype=np.uint32)
    for k in range(1, ROLL + 1):
        rolled = rolled * np.uint32(0x01000193) ^ raw[inner - k]
    rolled ^= rolled >> np.uint32(15)
    more = [inner[rolled % np.uint32(CHUNK_WORDS) == 0]]
    bounds = np.concatenate([[-1], white])
    for k in np.flatnonzero(np.diff(bounds) > LONG_WORD + 1).tolist():
        more.append(np.array(cuts_of_word(text[bounds[k] + 1 : bounds[k + 1]]), dtype=np.int64) + bounds[k] + 1)
    ends = np.unique(np.concatenate([*more, starts]))
    ends = ends[~np.isin(ends, starts[1:] - 1)].tolist()  # a chunk does not begin with the newline behind its text
    out, k = [], 0
    for a, b in zip(starts.tolist(), (starts[1:] - 1).tolist()):
        mine = [a]
        while ends[k] <= a:
            k += 1
        while ends[k] < b:
            mine.append(ends[k])
            k += 1
        mine.append(b)
        out.append([text[x:y] for x, y in zip(mine, mine[1:]) if y > x])
    return out


def cuts_of_word(raw: bytes) -> list[int]:
    """Where a long word is cut: at edges of its letter runs."""
    word, at, last, out = raw.decode("utf-8", "replace"), 0, 0, []
    for m in EDGE.finditer(word):
        if m.start() - last >= LONG_WORD:
            at += len(word[last : m.start()].encode("utf-8"))
            last = m.start()
            out.append(at)
    return out


def edge(piece: bytes, last: bool) -> bytes:
    """What a join is checked with: the last or first word with its white space; all of a piece that is one word."""
    if last:
        words = piece.rsplit(None, 1)
        return piece[len(words[0]) :].lstrip(BLANK) if len(words) == 2 else piece
    words = piece.split(None, 1)
    return piece[: piece.index(words[0]) + len(words[0])] if len(words) == 2 else piece


def repaired(documents: list[list[bytes]], encoded: list[list[bytes]], words: Words) -> list[bytes]:
    """The ids of each document from the encodings of its pieces, joins repaired until they agree.

    All joins of a packet are looked at together; those of regions that have grown are looked at again.
    """
    todo = [[*pair] for pair in zip(documents, encoded)]
    open_ = [k for k, (text, _) in enumerate(todo) if len(text) > 1]
    while open_:
        sides = [(edge(a, True), edge(b, False)) for k in open_ for a, b in zip(todo[k][0], todo[k][0][1:])]
        flat = list(dict.fromkeys(x for pair in sides for x in pair))
        alone = dict(zip(flat, words.of_chunks(flat)))
        joins = list(dict.fromkeys(sides))
        right = {s: x == alone[s[0]] + alone[s[1]] for s, x in zip(joins, words.encode([a + b for a, b in joins]))}
        agree = iter([right[s] for s in sides])
        again = []
        for k in open_:
            text, ids = todo[k]
            regions, parts = [[text[0]]], [[ids[0]]]
            for piece, own in zip(text[1:], ids[1:]):
                if next(agree):
                    regions.append([piece])
                    parts.append([own])
                else:
                    regions[-1].append(piece)
                    parts[-1].append(own)
            if len(regions) < len(text):
                merged = [b"".join(r) for r in regions]
                again.append(k)
                todo[k] = [merged, [p[0] if len(p) == 1 else words.encode([t])[0] for p, t in zip(parts, merged)]]
        open_ = [k for k in again if len(todo[k][0]) > 1]
    return [b"".join(ids) for _, ids in todo]


def different(documents: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """The different chunks of a packet in order of first appearance, and a digest of each."""
    chunks = list(dict.fromkeys(c for text in documents for c in text))
    return chunks, np.frombuffer(b"".join([hashlib.blake2b(c, digest_size=8).digest() for c in chunks]), dtype=np.uint64)


def shared_levels(stored: DataFrame, blocks: int) -> DataFrame:
    """(part, answers): which chunks of each packet may stand in other packets, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sizes, z in zip(*[batch.column(c).to_pylist() for c in ("part", "sizes", "z")]):
                yield from spans.partition_sketch(part, 0, different(cut(spans.packet_text(z), sizes))[1], blocks)

    return spans.merged_levels(stored.mapInArrow(releasing(run), spans.SKETCH)).drop("hot")


def sent_chunks(chosen: DataFrame, sketch_blocks: int, blocks: int) -> DataFrame:
    """A packet's chunks that may stand elsewhere, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, sizes, z, answers in zip(*[batch.column(c).to_pylist() for c in ("part", "sizes", "z", "answers")]):
                chunks, digests = different(cut(spans.packet_text(z), sizes))
                numbers = np.flatnonzero(spans.estimated_levels(digests, sketch_blocks, answers, 0)) if chunks else np.empty(0, np.int64)
                block = (digests[numbers] % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                numbers, block = numbers[order], block[order]
                edges = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0, [True]])) if len(block) else [0]
                rows = []
                for a, b in zip(edges[:-1], edges[1:]):
                    mine = [chunks[k] for k in numbers[a:b]]
                    lengths = np.array([len(c) for c in mine], dtype=np.int32)
                    rows.append((int(block[a]), part, coder.compress(b"".join(mine)), squeeze(lengths), squeeze(numbers[a:b].astype(np.int32))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=NAMES)

    return chosen.mapInArrow(releasing(run), SENT)


def encoded_chunks(sent: DataFrame, path: str) -> DataFrame:
    """Each different chunk of a block encoded once, and (part, shared): the answers to each packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, reader = Words(path), zstandard.ZstdDecompressor()
        now, done = None, {}
        for batch in batches:
            out = []
            for block, part, data, sizes, numbers in zip(*[c.to_pylist() for c in batch.columns]):
                if block != now:
                    now, done = block, {}
                text, ends = reader.decompress(data), np.cumsum(expand(sizes, np.int32)).tolist()
                chunks = [text[a:b] for a, b in zip([0, *ends], ends)]
                fresh = [c for c in chunks if c not in done]
                done.update(zip(fresh, words.of_chunks(fresh)))
                answers = [done[c] for c in chunks]
                lengths = np.array([len(a) for a in answers], dtype=np.int32)
                out.append((block, part, squeeze_planes(np.frombuffer(b"".join(answers), np.int32)), squeeze(lengths), numbers))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], names=NAMES)

    answers = sent.repartition("block").sortWithinPartitions("block").mapInArrow(releasing(run), SENT)
    return answers.groupBy("part").agg(F.collect_list(F.struct("data", "sizes", "numbers")).alias("shared"))


def encoded_documents(chosen: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: all chunks of each packet put together, with the answers to those that others have, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        for batch in batches:
            for names, sizes, z, shared in zip(*[batch.column(c).to_pylist() for c in ("ids", "sizes", "z", "shared")]):
                documents = cut(spans.packet_text(z), sizes)
                chunks = list(dict.fromkeys(c for text in documents for c in text))
                known: dict[bytes, bytes] = {}
                for answer in shared or []:
                    data, ends = expand_planes(answer["data"], np.int32).tobytes(), np.cumsum(expand(answer["sizes"], np.int32)).tolist()
                    for k, a, b in zip(expand(answer["numbers"], np.int32).tolist(), [0, *ends], ends):
                        known[chunks[k]] = data[a:b]
                for i in range(0, len(chunks), 4_000):
                    fresh = [c for c in chunks[i : i + 4_000] if c not in known]
                    known.update(zip(fresh, words.of_chunks(fresh)))
                for i in range(0, len(names), 500):
                    few = documents[i : i + 500]
                    ids = repaired(few, [[known[c] for c in text] for text in few], words)
                    ids = [np.frombuffer(x, dtype=np.int32) for x in ids]
                    decoded = words.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
                    columns = [pa.array(names[i : i + 500], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    return chosen.mapInArrow(releasing(run), ENCODED)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded for each whole text."""
    path = path or tokenizer_path()
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = text_bytes(rows)
    sketch_blocks = spans.blocks_for(size // CHUNK_BYTES)
    # Dealt by part once: the steps read one exchange, so each asks for all its columns, and joins add no filter to it.
    by_part = spans.packets(rows).repartition("part")
    chosen = by_part.join(shared_levels(by_part, sketch_blocks), "part", "left")
    shared = encoded_chunks(sent_chunks(chosen, sketch_blocks, spans.buckets_for(size)), path)
    return encoded_documents(by_part.join(shared, "part", "left"), path)


def reuse(docs: DataFrame) -> DataFrame:
    """chunks, encoded: how many chunks the texts have, and how many different ones are encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, z in zip(*[batch.column(c).to_pylist() for c in ("sizes", "z")]):
                for text in cut(spans.packet_text(z), sizes):
                    yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(c).digest() for c in text], pa.binary())], names=["digest"])

    rows = spans.packets(texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(releasing(run), "digest binary")
    return rows.agg(F.count("digest").alias("chunks"), F.countDistinct("digest").alias("encoded"))


def query(docs: DataFrame) -> DataFrame:
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return encode(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

"""Operator 13, token-id files: ids of all documents in blocks of an adaptive range coder.

``write`` deals documents to ranges of ``doc_id`` (rows of one id are told apart
by a hash of the text and their place in the table, so a range ends inside a
frequent id, too), sorts each range and encodes it: one task turns texts into
ids, ends each document with ``end_id`` and packs about ``FRAME`` ids at a time
into a frame of blocks that the coder resets and checksums (``id_coder``). A
frame holds whole documents; it is one binary value in Parquet files, which every
file system of Spark can store. ``read`` decodes any frame alone, checks it, and
gives (doc_id, start, n_tokens, ids_crc32) and, if asked, the ids. Starts need the
number of ids of each range only, a row a task.

Ids are those of the tokenizers library for the file. It makes 1.7 MB of text a
second here, so where the file says that it is byte-level BPE whose merges stand
in order of their ids, tiktoken is built from that same file and takes its place;
texts with a special token's name, and all other files, go to the library.

Defined results: null text is empty, a document of the end id alone. Null ids come
after all others. Every input row gives one output row, repeated rows included;
other columns are ignored. An empty table gives an empty result. Files whose ids
do not fit 16 bits are refused.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import id_coder
from .common import checkpoint_dir, releasing, texts, worker_cache

#: Ids of a frame, about; texts that are taken from Arrow together.
FRAME, TOGETHER = 8_000_000, 256
# Fixed value: how byte-level BPE cuts texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FRAMES = "part int, first long, n_ids long, n_docs long, frame binary"
ROWS = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token with its id, if merging by smallest id is what the tokenizer file means; else None."""
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    odd = [spec["normalizer"], spec["truncation"], spec["padding"], model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix")]
    odd += [model.get("end_of_word_suffix"), model.get("ignore_merges"), model.get("byte_fallback"), cut.get("add_prefix_space")]
    if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or any(odd):
        return None
    letters, vocab = byte_letters(), model["vocab"]
    added = {a["content"] for a in spec["added_tokens"]}
    own = {t: i for t, i in vocab.items() if t not in added}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    single = [own.get(c, -1) for c in letters]
    whole = sorted(merged) == merged and len(set(merged)) == len(merged) and min(single) >= 0 and set(merged) | set(single) == set(own.values())
    return {bytes(letters[c] for c in t): i for t, i in own.items()} if whole and max(single) < min(merged, default=1 << 30) else None


class Texts:
    """Ids of texts as little-endian 16-bit values."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids of this tokenizer do not fit 16 bits")
        self.special = [a["content"] for a in spec["added_tokens"]]
        ranks = ranks_of(spec)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        out = array("H", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


def framed(ids: list[int | None], tokens: list[bytes]) -> tuple[bytes, int]:
    """A frame of whole documents, and the number of their ids."""
    sizes = np.array([len(t) // 2 for t in tokens], "<u4")
    keys = np.array([0 if i is None else i for i in ids], "<i8")
    missing = np.array([i is None for i in ids], np.uint8)
    side = zlib.compress(keys.tobytes() + sizes.tobytes() + missing.tobytes(), 6)
    head = struct.pack("<II", len(ids), len(side))
    return head + side + struct.pack("<I", zlib.crc32(head + side)) + id_coder.pack(np.frombuffer(b"".join(tokens), "<u2")), int(sizes.sum())


def unframed(frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, number of ids of each, all ids) of a frame; ValueError if it is damaged."""
    n, side = struct.unpack("<II", frame[:8])
    if zlib.crc32(frame[: 8 + side]) != struct.unpack("<I", frame[8 + side : 12 + side])[0]:
        raise ValueError("the list of documents of a frame is damaged")
    keys, sizes, missing = np.split(np.frombuffer(zlib.decompress(frame[8 : 8 + side]), np.uint8), [8 * n, 12 * n])
    ids = [None if m else k for k, m in zip(keys.view("<i8").tolist(), missing.tolist())]
    return ids, sizes.view("<u4").astype(np.int64), id_coder.unpack(frame[12 + side :])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Frames of the ids of (doc_id, text), in ascending order of doc_id over parts and frames, as Parquet at ``path``."""

    @releasing
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_cache(("id_files", tokenizer), lambda: Texts(tokenizer))
        part, end, first = TaskContext.get().partitionId(), np.array([end_id], "<u2").tobytes(), 0
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, first, ids, tokens
            frame, n = framed(ids, tokens)
            row = [[part], [first], [n], [len(ids)], [frame]]
            first, held, ids, tokens = first + n, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "first", "n_ids", "n_docs", "frame"])

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                for key, got in zip(some.column("doc_id").to_pylist(), map(coder.encode, some.column("text").to_pylist())):
                    ids.append(key)
                    tokens.append(got + end)
                    held += len(got) // 2 + 1
                    if held >= FRAME:
                        yield flush()
        if ids:
            yield flush()

    rows = texts(docs).select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), "h", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(pack, FRAMES).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), with ``with_ids`` also ids, of files that ``write`` made."""

    @releasing
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first = batch.column("part")[row].as_py(), batch.column("first")[row].as_py()
                keys, sizes, ids = unframed(batch.column("frame")[row].as_py())
                ends = np.cumsum(sizes)
                wide = ids.astype("<u4")
                raw, cuts = memoryview(wide.tobytes()), [0, *(4 * ends).tolist()]
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                out = [pa.array(np.full(len(keys), part, np.int32)), pa.array(keys, pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["part", "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    frames = spark.read.schema(FRAMES).parquet(path)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("offset"))
    rows = frames.select("part", "first", "frame").mapInArrow(decode, ROWS + (", ids array<int>" if with_ids else ""))
    joined = rows.join(F.broadcast(offsets), "part")
    return joined.select("doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def query(docs: DataFrame, end_id: int = 2) -> DataFrame:
    import public_tokenizers

    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id)
    return read(spark, path)

"""Operator 12, vector code compression: product quantisation with integer codebooks.

Vectors become whole numbers (``floor(SCALE * x)``) and are cut into ``parts``
equal parts. The codebook of a part position begins with that part of the vectors
of the smallest ids; in each round every part goes to its nearest entry and an
entry becomes the floored mean of its parts.

Tasks pack vectors into columnar blocks: for each dimension the values of all
vectors of the block lie together. Distances to all entries are added up dimension
by dimension; sums and counts of the entries are int64 tensors filled by
``np.add.at`` and merged by ``RDD.treeAggregate``, so what meets in one place is a
pair of tensors of parts x entries x dimensions, whatever the number of vectors.
Codebooks travel with the tasks. All is integer arithmetic, so the order of merging
changes nothing.

Defined results: rows whose vector is null, empty or holds a null or non-finite
component are dropped, and so are those with another number of dimensions than the
vector of the smallest id. If ``parts`` does not divide the dimensions, zeros are
put behind. Components beyond ``LARGEST`` count as that. Rows of one id are ordered
by their vector; null ids come after all others. Ties go to the lower index. Fewer
vectors than entries make fewer entries. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, releasing

SCALE = 256
#: Whole numbers are held within this, so that squares and sums fit 64 bits.
LARGEST = 1 << 24
#: Labels up to which their sums are broadcast; more are joined salted.
FEW_LABELS, SALTS = 100_000, 32


def kept(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, v, label) of the vectors that have only finite components."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size(v) > 0) & finite).select(F.col(id_col).alias("vec_id"), v.alias("v"), F.col(label).alias("label"))


def whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64)


def columns(values: np.ndarray, size: int, parts: int) -> np.ndarray:
    """parts x dimensions of a part x vectors, zeros put behind."""
    rows = values.reshape(-1, size)
    more = -size % parts
    if more:
        rows = np.hstack([rows, np.zeros((len(rows), more), rows.dtype)])
    return np.ascontiguousarray(rows.T).reshape(parts, (size + more) // parts, -1)


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part: block is parts x dims x vectors, book parts x entries x dims."""
    code = np.empty((block.shape[0], block.shape[2]), np.int64)
    error = np.empty_like(code)
    for p in range(block.shape[0]):
        distance = np.zeros((block.shape[2], book.shape[1]), np.int64)
        for d in range(block.shape[1]):
            off = block[p, d][:, None] - book[p, :, d][None, :]
            off *= off
            distance += off
        code[p] = distance.argmin(axis=1)
        error[p] = np.take_along_axis(distance, code[p][:, None], axis=1)[:, 0]
    return code, error


def add_block(total, block: np.ndarray, book: np.ndarray):
    """Sums and counts of the entries, with those of one more block."""
    sums, counts = total or (np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64))
    code, _ = nearest(block, book)
    for p in range(len(code)):
        np.add.at(sums[p], code[p], block[p].T)
        np.add.at(counts[p], code[p], 1)
    return sums, counts


def merge(a, b):
    if a is None or b is None:
        return a or b
    return a[0] + b[0], a[1] + b[1]


def matrices(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have ``size`` dimensions, their components one after the other)."""
    v = batch.column("v")
    right = np.flatnonzero(np.diff(v.offsets.to_numpy()) == size)
    return right, v.take(pa.array(right)).flatten().to_numpy()


def seeds(rows: DataFrame, entries: int) -> tuple[int, np.ndarray]:
    """(dimensions, vectors of the smallest ids): at most ``entries`` rows come to the driver."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).limit(1).select(F.size("v").alias("n")).collect()
    if not first:
        return 0, np.zeros((0, 0))
    found = rows.where(F.size("v") == first[0].n).orderBy(*order).limit(entries).select("v").collect()
    return first[0].n, np.array([r.v for r in found], np.float64)


def fit(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[int, np.ndarray | None]:
    """(dimensions, codebooks as parts x entries x dimensions of a part) from the rows of ``kept``."""
    size, first = seeds(rows, entries)
    if not size:
        return 0, None
    book = np.ascontiguousarray(columns(whole(first).ravel(), size, parts).transpose(0, 2, 1))

    @releasing
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, values = matrices(batch, size)
            if len(values):
                yield pa.RecordBatch.from_arrays([pa.array([columns(whole(values), size, parts).astype("<i4").tobytes()], pa.binary())], names=["block"])

    blocks = rows.select("v").mapInArrow(pack, "block binary").rdd
    width = book.shape[2]
    for _ in range(rounds):
        now = book
        found = blocks.treeAggregate(
            None, lambda total, row: add_block(total, np.frombuffer(row[0], "<i4").reshape(parts, width, -1).astype(np.int64), now), merge
        )
        sums, counts = found
        book = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], book)
    return size, book


def encode(rows: DataFrame, size: int, book: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part, and the squared distance."""
    parts = len(book)
    kind = dict(rows.dtypes)

    @releasing
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(book.shape[1])])
        for batch in batches:
            right, values = matrices(batch, size)
            if len(right):
                codes, error = nearest(columns(whole(values), size, parts), book)
                text = digits[codes.T].tolist()
                own = batch.take(pa.array(right))
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(map("".join, text), pa.string()), pa.array(error.sum(axis=0))], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(code, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def decode(codes: DataFrame, book: np.ndarray, code: str = "code") -> DataFrame:
    """``codes`` with the column vector: what the codes stand for, in the measure of the input."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in part]) for part in book])
    places = F.sequence(F.lit(0), F.lit(len(book) - 1))
    entry = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.transform(places, lambda p: F.get(F.get(table, p), entry(p)))))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the errors of all rows of a label; nulls are one label."""
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    if totals.count() <= FEW_LABELS:
        right = totals.withColumnRenamed("label", "other")
        return codes.join(F.broadcast(right), F.col("label").eqNullSafe(F.col("other"))).drop("other")
    right = totals.select(F.col("label").alias("other"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    left = codes.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return left.join(right, F.col("label").eqNullSafe(F.col("other")) & (F.col("own") == F.col("salt"))).drop("other", "own", "salt")


def query(vectors: DataFrame) -> DataFrame:
    rows = kept(vectors)
    size, book = fit(rows)
    if book is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false")
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    out = with_label_errors(cut(encode(rows, size, book)))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same in DuckDB, for vectors whose dimensions the parts divide."""
    space = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    assign = f"select vec_id, label, p, x, arg_min(e, {space} * {entries} + e) as e, min({space}) as d from part join {{book}} using (p) group by vec_id, label, p, x"
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} as materialized ({assign.format(book=f'c{k}')})")
        mean = "(s - ((s % n) + n) % n) // n"
        steps.append(
            f"""s{k} as (select p, e, i, sum(x[i]) as s, count(*) as n from a{k}, (select unnest(range(1, {{w}} + 1)) as i) group by p, e, i),
m{k} as (select p, e, list(cast({mean} as bigint) order by i) as c from s{k} group by p, e),
c{k + 1} as materialized (select p, e, coalesce(m{k}.c, c{k}.c) as c from c{k} left join m{k} using (p, e))"""
        )
    body = ",\n".join(steps).replace("{w}", "(select max(len(x)) from part)")
    last = f"c{rounds}"
    return f"""with kept as materialized (select vec_id, label, list_transform(embedding, lambda y: cast(floor({SCALE} * cast(y as double)) as bigint)) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
part as materialized (select vec_id, label, p, v[cast(p * len(v) // {parts} + 1 as bigint) : cast((p + 1) * len(v) // {parts} as bigint)] as x from kept, (select unnest(range({parts})) as p)),
c0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from part where vec_id in (select vec_id from kept order by vec_id limit {entries})),
{body},
final as materialized ({assign.format(book=last)}),
coded as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from final group by vec_id, label),
book as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from {last})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, book"""

"""Vector codes: vectors cut into parts, each part replaced by the index of an entry of a learned codebook.

Lloyd's rounds are kept up by differences. Every vector's previous assignment is persisted beside its integer
components in a table of the shared folder; the running sums and counts of the entries are integers. A round
reads the table, assigns all parts to the new codebook and writes the next table; then only the parts whose
assignment changed add to one entry's sum and take from another's. These contributions are added up within
each task, so that a task shuffles a row for an entry's component at most. What the driver holds is the
codebook: PARTS * ENTRIES sums, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import remove, shared_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def kept(vectors: DataFrame) -> DataFrame:
    """Rows with a vector of finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & ~bad)


def bound(width: int) -> int:
    """Largest absolute integer component for which the error of a whole vector stays within 62 bits."""
    return math.isqrt((1 << 60) // width)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component, a row for a vector, filled with zeros up to the width."""
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=np.int64)
    limit = bound(width)
    out[np.arange(width) < sizes[:, None]] = np.clip(np.floor(np.clip(flat, -1e300, 1e300) * SCALE), -limit, limit).astype(np.int64)
    return out


def nearest(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of every part (ties to the lower index) and the squared distances summed over the parts, both exact."""
    parts, _, d = books.shape
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(books).max(initial=0)))
    kind = np.float64 if 4 * d * most * most < 1 << 53 else np.int64
    code, error = np.empty((len(q), parts), dtype=np.uint8), np.zeros(len(q), dtype=np.int64)
    for p in range(parts):
        x, b = q[:, p * d : (p + 1) * d].astype(kind), books[p].astype(kind)
        if kind is np.float64:
            far = (x * x).sum(1)[:, None] - 2 * (x @ b.T) + (b * b).sum(1)
        else:
            far = np.stack([((x - e) ** 2).sum(1) for e in b], axis=1)
        code[:, p] = far.argmin(1)
        error += far[np.arange(len(q)), code[:, p]].astype(np.int64)
    return code, error


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _binary(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes], pa.binary())


def assign(state: DataFrame, books: np.ndarray, width: int, first: bool) -> DataFrame:
    """(vec_id, label, q, code, was): every vector's new code beside the one before, null in the first round."""
    kind = T.StructType([*(state.schema[c] for c in ("vec_id", "label")), *T.StructType.fromDDL("q array<int>, code binary, was binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = integers(b.column("embedding"), width) if first else b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * width), pa.array(q.ravel().astype(np.int32)))
            was = pa.nulls(len(q), pa.binary()) if first else b.column("code")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists, _binary(nearest(q, books)[0]), was], kind.names)

    return state.mapInArrow(run, kind)


def contributions(moved: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(slot, place, change): what the changed parts add to and take from the sums; place -1 is the count of a slot."""
    parts, entries, d = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, d + 1), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
            code, was = _codes(b.column("code")), b.column("was")
            had = None if was.null_count else _codes(was)  # of one round, so all are null or none
            for p in range(parts):
                x = np.hstack([np.ones((len(q), 1), dtype=np.int64), q[:, p * d : (p + 1) * d]])
                new = np.ones(len(q), bool) if had is None else code[:, p] != had[:, p]
                np.add.at(total, p * entries + code[new, p].astype(np.int64), x[new])
                if had is not None:
                    np.subtract.at(total, p * entries + had[new, p].astype(np.int64), x[new])
        slot, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(place.astype(np.int32) - 1), pa.array(total[slot, place])], ["slot", "place", "change"])

    return moved.select("q", "code", "was").mapInArrow(run, "slot int, place int, change long")


def finish(state: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(vec_id, label, code as hex digits, error) with the last codebook."""
    kind = T.StructType([*(state.schema[c] for c in ("vec_id", "label")), *T.StructType.fromDDL("code string, error long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code, error = nearest(b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64), books)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], kind.names)

    return state.select("vec_id", "label", "q").mapInArrow(run, kind)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for every kept row of vectors(vec_id, label, embedding).

    Rows whose vector is null or holds null or non-finite components are dropped. The codebook starts with the
    rows of the smallest ids (a null id after all others; rows that repeat an id by their components); with
    fewer rows it has fewer entries. Repeated rows are coded alike and each counts. Vectors narrower than the
    widest, or not a multiple of parts wide, count as filled with zeros; empty ones thus too. Integer components
    beyond bound(width), which is 2**27 at 64 components, count as that. Null labels are one label. Other
    columns are ignored. An empty table gives no rows."""
    spark, rows = vectors.sparkSession, kept(vectors)
    out = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    widest = rows.agg(F.max(F.size("embedding"))).first()[0]
    if widest is None:
        return spark.createDataFrame([], out)
    width = max(-(-widest // parts), 1) * parts
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    books = integers(pa.array([r[0] for r in start], pa.list_(pa.float64())), width).reshape(len(start), parts, -1).transpose(1, 0, 2)
    shape = books.shape
    total = [[0] * (shape[2] + 1) for _ in range(shape[0] * shape[1])]
    state, before = rows, None
    for r in range(rounds):
        path = shared_path(spark, "vector-codes")
        assign(state, books, width, r == 0).write.parquet(path)
        state = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
        moved = state.where("was is null or code <> was")
        for slot, place, change in contributions(moved, shape).groupBy("slot", "place").agg(F.sum(F.col("change").cast("decimal(38,0)"))).collect():
            total[slot][place + 1] += int(change)
        means = [[s // t[0] for s in t[1:]] if t[0] else None for t in total]
        books = np.array([old if m is None else m for m, old in zip(means, books.reshape(-1, shape[2]).tolist())], dtype=np.int64).reshape(shape)
    path = shared_path(spark, "vector-codes")
    finish(state, books, width).write.parquet(path)
    remove(spark, before)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    done = spark.read.parquet(path)
    sums = done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return done.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

"""Helpers that several training-data operators use: cutting lineage, size-checked joins, and hashing of text with numpy."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without an id take part under this one, so that joins treat them like any other.
NULL_ID = -(2**63)
#: Most rows of a list of ids (or of short records) that a join may broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: Bytes and rows of a batch that a task hands to its Python worker at once, (bounds of the session, see small_batches).
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000


def key(column: str | Column) -> Column:
    """The id as a non-null long."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("long"), F.lit(NULL_ID))


def own_id(column: str | Column = "key") -> Column:
    """What key() made, back to the nullable id."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != F.lit(NULL_ID), column)


def small_batches(spark: SparkSession) -> None:
    """Bounds what the session hands to Python workers at once: tasks hold several copies of a batch outside the heap, and an operator's
    result is computed by an action of the caller's, so the bounds stay set. Smaller ones stay as they are."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(name, None) or ""
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir or the context names it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not (path := spark.conf.get("spark.checkpoint.dir", None)):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that a lost executor costs no recomputation and lineage ends.

    spent are tables of earlier cuts that nothing reads any more once df is written; their files go.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    small_batches(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    drop(*spent)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut() wrote."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def join_checked(large: DataFrame, small: DataFrame, on: str, how: str, rows_limit: int = BROADCAST_ROWS) -> DataFrame:
    """A join that broadcasts `small`, ids or a few numbers a row, only if it was counted to be within `rows_limit`, and shuffles
    otherwise."""
    few = small.limit(rows_limit + 1).count() <= rows_limit
    return large.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece are within `most` bytes, unless one text alone is longer."""
    for batch in batches:
        sizes = np.nan_to_num(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Hands a process's free memory back, a worker's at a task's end: workers serve one stage after another, each with buffers of its own."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and where each row starts (one entry more than rows); null: empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of any slice of a byte array. A worker keeps the powers for texts of KEPT bytes, not longer ones."""

    base = 0x9E3779B97F4A7C55 | 1
    KEPT = 1 << 20
    kept: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def tables(cls, n: int) -> tuple[np.ndarray, ...]:
        """The powers of the base and of its inverse."""
        if n <= cls.KEPT and cls.kept is not None:
            return cls.kept
        out = []
        for b in (cls.base, pow(cls.base, -1, 2**64)):
            steps = np.full(max(n, cls.KEPT), b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        if n <= cls.KEPT:
            cls.kept = tuple(out)
        return tuple(out)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.powers, self.inverses = self.tables(n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverses[start]


#: The bytes 0x20 and 0x09-0x0D end words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


#: Words of up to so many bytes are hashed side by side, eight bytes at a time; longer ones singly.
_SIDE_BY_SIDE = 256
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice's bytes and length. Every eight bytes are mixed into what came before, so no structure of a text, as
    there is for sums of powers, makes two of them equal."""
    n = end - start
    h = mix(n.astype(np.uint64) ^ np.uint64(0x9AE16A3B2F90404F))
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero((n > 0) & (n <= _SIDE_BY_SIDE))
    for at in range(0, _SIDE_BY_SIDE, 8):
        live = live[n[live] > at]
        if not len(live):
            break
        part = eight[start[live] + at] & _FIRST_BYTES[np.minimum(n[live] - at, 8)]
        h[live] = mix((h[live] ^ part) + np.uint64(0xC3A5C85C97CB3127))
    for k in np.flatnonzero(n > _SIDE_BY_SIDE).tolist():
        digest = hashlib.blake2b(data[start[k] : end[k]], digest_size=8, person=b"words").digest()
        h[k] = np.frombuffer(digest, np.uint64)[0]
    return h


def words(column: pa.Array, also: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (lower-cased A-Z, cut at ASCII white space and the bytes in `also`), and where each row's start."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    if also:
        inside &= ~np.isin(np.arange(256), list(also))[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return slice_hashes(data, start, end), np.searchsorted(start, offsets)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 0, 3]: which entry each item is of, [0 0 2 2 2], and its place in it, [0 1 0 1 2]."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))

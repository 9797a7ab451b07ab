"""Shared plumbing: bounded Arrow batches, shared-folder checkpoints, vectorised word kernels."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one kernel call holds at most, unless a single row is longer.
SLICE_BYTES = 4 << 20
#: Rows (of some 100 bytes) that a lookup table may have to be broadcast; places of each row of a larger table.
LOOKUP_ROWS, SALTS = 50_000, 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one, but only if
    there are no executors on other machines, which couldn't read it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="turnmill-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, an action's shuffle files go when it ends; else they stay until the driver happens to collect its garbage. For steps
    that end in a checkpoint each, so that nobody reads those files again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stash(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large, thin table with a Parquet table in the shared folder, which takes a third of a checkpoint's
    room. It is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/turnmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(discard, spark, path)
    return spark.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and its JVM with it
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; read by Spark alone, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def looked_up(df: DataFrame, table: DataFrame, on: str, spread: str, how: str = "inner") -> DataFrame:
    """``df`` joined to a table with one row a key. The table is counted: a small one is broadcast, so that a key that holds a
    third of all rows stays spread over the tasks that read it; each row of a larger one goes to ``SALTS`` places."""
    if table.count() <= LOOKUP_ROWS:
        return df.join(F.broadcast(table), on, how)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [on, "__salt"], how).drop("__salt")


def slices(batch: pa.RecordBatch, text: str | None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text column of each slice has about ``limit`` bytes; a longer row stands alone."""
    if text is None or batch.num_rows < 2:
        yield batch
        return
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to


def map_arrow(df: DataFrame, fn: Callable, schema: str, text: str | None = None, init: Callable | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of about ``limit`` bytes; ``init()`` runs once a task and its result is the second argument of ``fn``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = init() if init else None
        for batch in batches:
            for part in slices(batch, text, limit):
                out = fn(part, state) if init else fn(part)
                if out is not None and out.num_rows:
                    yield out

    return apply(df, go, schema)


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and what they keep counts beside the JVM's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def apply(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver did, whatever their working folder."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    env = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return df.mapInArrow(go, schema)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with all rows of a key in one partition, sorted by key, for an ``apply`` that reads a key's rows together.

    Dealt by a hash of the keys instead of the keys: over a join on the same keys Spark would leave out a ``repartition`` on
    them, and adaptive execution, which knows of no need for the grouping above the join, then reads its shuffle by mapper or
    splits its large partitions, so that a key's rows end in several tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys, F.lit(1))).sortWithinPartitions(*keys)


# --------------------------------------------------------------------- words
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 20
_POWERS: list[np.ndarray] = []

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
#: White space and ASCII punctuation.
PUNCT = SPACE.copy()
PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n, kept for usual block sizes."""
    if not _POWERS or len(_POWERS[0]) < n:
        tables = []
        for p in (_P, _PINV):
            x = np.full(max(n, _BLOCK), p, U)
            x[0] = 1
            tables.append(np.multiply.accumulate(x))
        if n > 4 * _BLOCK:
            return tables[0], tables[1]
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that close inputs give unrelated outputs."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end (null: none) and each row's offsets."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """All maximal runs of non-separator bytes of a string column: hash, row, byte start and end (exclusive), in order."""

    __slots__ = ("doc", "end", "hash", "raw", "sep", "start", "text_off")

    def __init__(self, col: pa.Array, sep: np.ndarray = SPACE) -> None:
        self.raw, self.text_off = text_bytes(col)
        raw, off = self.raw, self.text_off
        self.sep = sep[raw]
        on = ~self.sep
        first, last = on.copy(), on.copy()
        if len(raw):
            first[1:] &= self.sep[:-1]
            last[:-1] &= self.sep[1:]
            cut = off[(off > 0) & (off < len(raw))]
            first[cut] = on[cut]
            last[cut - 1] = on[cut - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.zeros(len(self.start), U)
        at = 0
        while at < len(out):
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + _BLOCK, "right")))
            n = int(self.end[to - 1] - base)
            up, down = powers(n)
            each = (self.raw[base : base + n].astype(U) + U(1)) * up[:n]
            each[self.sep[base : base + n]] = 0
            begin = self.start[at:to] - base
            out[at:to] = np.add.reduceat(each, begin) * down[begin]
            at = to
        return mix(out)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows inside rows and the index of each one's first word."""
        if len(self.hash) < n:
            return np.zeros(0, U), np.zeros(0, np.int64)
        m = len(self.hash) - n + 1
        g = np.zeros(m, U)
        for j in range(n):
            g = g * U(0xD6E8FEB86659FD93) + self.hash[j : j + m]
        ok = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(g[ok]), ok


def signed(h: np.ndarray) -> np.ndarray:
    """Spark's BIGINT has no unsigned form."""
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive runs of ``values`` as list rows."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))

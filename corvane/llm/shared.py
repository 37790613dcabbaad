"""What the training-data operators share: durable intermediates, and vectorised word hashing over Arrow text.

Words are maximal runs of ASCII letters, digits and non-ASCII characters.  All
hashing works on UTF-8 bytes with numpy, in blocks of a few megabytes, so a
Python worker's memory follows the block and the longest document, not the batch.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
#: Smaller tables aren't worth spreading.
LEAST_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


# -- durable intermediates


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later reads survive the loss of any executor.

    Results that are computed later may still read the table, so it is deleted when the driver ends.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    system, where = _file_system(df.sparkSession, path)
    system.deleteOnExit(where)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._corvane_path = path
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_corvane_path", None)
    if path:
        system, where = _file_system(df.sparkSession, path)
        system.delete(where, True)
        system.cancelDeleteOnExit(where)


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of whole documents small: a worker holds several copies of a batch at once.

    Settings of the session that are stricter stay.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS or int(spark.conf.get(rows)) <= 0:
        spark.conf.set(rows, BATCH_ROWS)
    found = spark.conf.get(size).lower()
    if found.rstrip("b").isdigit() and int(found.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the tables they come from are too small for a scan to use them; larger ones stay as they are scanned."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if not LEAST_BYTES <= size < cores * split or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so extra columns of the input never clash; spread()."""
    small_batches(df.sparkSession)
    return spread(df).select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def release() -> None:
    """Give a worker's freed memory back: it lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches, which ends with release()."""

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


# -- text as bytes


def as_texts(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Large strings, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large-string array and its n + 1 offsets, without copying."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    view = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return view, offsets


def slices(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    _, offsets = byte_view(texts)
    start, n = 0, len(texts)
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


# -- word hashes

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 4096)
            made = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _runs(data: np.ndarray, bounds: np.ndarray, symbols: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; with symbols, runs of other visible characters count as well."""
    kind = WORD[data].view(np.uint8)
    if symbols:
        kind = kind + 2 * (~WORD[data] & ~SPACE[data]).view(np.uint8)
    change = np.empty(len(data), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[bounds[bounds < len(data)]] = True
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], len(data))
    keep = kind[edges] != 0
    return edges[keep], ends[keep]


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(data: np.ndarray, bounds: np.ndarray, symbols: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in data, in order; a word never crosses one of the bounds.

    Data longer than a block is cut at bytes that are no part of a word, so the
    memory for hashing stays bounded whatever the length of a document.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + BLOCK_BYTES)
        while end < n:
            window = np.flatnonzero(SPACE[data[max(at + 1, end - 4096) : end]])
            if len(window):
                end = max(at + 1, end - 4096) + int(window[-1])
                break
            end = min(n, end + 4096)
        block = data[at:end]
        lo, hi = np.searchsorted(bounds, [at, end])
        starts, ends = _runs(block, bounds[lo:hi] - at, symbols)
        found.append((_hash_block(block, starts, ends), starts + at, ends + at))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def hashed(texts: pa.Array, start: int, end: int, symbols: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of rows start..end, and the n + 1 positions at which each row's words begin."""
    data, offsets = byte_view(texts)
    base = int(offsets[start])
    bounds = offsets[start : end + 1] - base
    hashes, starts, _ = word_hashes(data[base : int(offsets[end])], bounds[:-1], symbols)
    return hashes, np.searchsorted(starts, bounds)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within each row, and where each row's grams begin.

    A row of fewer than k words, but one at least, has one gram of all its words.
    """
    n, counts = len(hashes), np.diff(first)
    h = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        h[: n - j] = h[: n - j] * np.uint64(_BASE) + hashes[j:]
    h = mix(h)
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
    take = np.arange(begin[-1]) - np.repeat(begin[:-1], number) + np.repeat(first[:-1], number)
    out = h[take]
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        value = 0
        for x in hashes[first[row] : first[row + 1]]:
            value = (value * _BASE + int(x)) & _MASK
        out[begin[row]] = mix(np.array([value ^ int(counts[row])], np.uint64))[0]
    return out, begin


def struct_of(fields: dict[str, pa.Array]) -> pa.Array:
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


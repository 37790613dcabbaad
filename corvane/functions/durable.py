"""Where rows lie: spread over the cores, written to the folder that all executors share, or in blocks there."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch of texts: a worker holds several copies of a batch at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches within those limits; stricter settings stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        found = spark.conf.get(name).lower().removesuffix("b")
        if found.lstrip("-").isdigit() and not 0 < int(found) <= most:
            spark.conf.set(name, most)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where the tables they come from are too small for a scan to use them; larger ones stay as they are scanned.

    They go to workers in small batches.
    """
    spark = rows.sparkSession
    small_batches(spark)
    cores = spark.sparkContext.defaultParallelism
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.repartition(cores) if size < cores * split else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return context.getCheckpointDir()


def _path(spark: SparkSession, name: str):
    """(file system, path) of a new folder there, which goes when the driver ends."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(where)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written there and read again: computed once, and no lost executor takes it away."""
    system, where = _path(df.sparkSession, name)
    df.write.parquet(where.toString())
    system.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(where.toString())


class Blocks:
    """Objects in files there, read one at a time by any task."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __iter__(self) -> Iterator[Any]:
        system, folder = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", self.path))
        for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path):
            if info.path.endswith(".parquet"):
                with system.open_input_file(info.path) as file:
                    for value in pq.read_table(file).column("block"):
                        yield pickle.loads(value.as_py())  # noqa: S301


def in_blocks(rows: DataFrame, key: str, parts: int, build: Callable[[pa.Table], Any]) -> Blocks:
    """The rows in ranges of a key, what is built of each range as a block."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(build(pa.Table.from_batches(held)))], pa.binary())})

    system, where = _path(rows.sparkSession, "blocks")
    rows.repartitionByRange(parts, key).sortWithinPartitions(key).mapInArrow(make, "block binary").write.parquet(where.toString())
    system.deleteOnExit(where)
    return Blocks(where.toString())

"""Tables that a plan writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..errors import VicinalError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one, as in tests, gets a folder of its own."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got is None:
        if not spark.sparkContext.master.startswith("local"):
            raise VicinalError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="vicinal-"))
        got = spark.sparkContext.getCheckpointDir()
    return got.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Sparse records are large rows: unless the session says otherwise, a batch that goes to Python has this many at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Memory that a task of a Python worker has freed goes back to the system, for the JVM and the other workers beside it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, from a table written now."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_sets(df: DataFrame, what: str, n_files: int) -> str:
    """The folder of a table written now in about so many files, for tasks that read it whole; see batches_of."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.repartition(max(1, n_files)).write.parquet(path)
    return path


def batches_of(folder: str, most: int) -> Iterator[pa.RecordBatch]:
    """All rows of a table, as a task reads them: at most so many at a time."""
    files, base = pafs.FileSystem.from_uri(folder)
    for one in sorted(i.path for i in files.get_file_info(pafs.FileSelector(base)) if i.path.endswith(".parquet")):
        with files.open_input_file(one) as source:
            yield from (b for b in pq.ParquetFile(source).iter_batches(most) if b.num_rows)

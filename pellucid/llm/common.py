"""Helpers shared by the training-data operators: input tables and shared intermediate storage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of its own below ``spark.checkpoint.dir``, as a full URI.

    Only a local session may lack the setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_base()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/pellucid-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


@cache
def _local_base() -> str:
    """A temporary folder of this process, removed as it ends."""
    path = tempfile.mkdtemp(prefix="pellucid-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, shared_dir(spark)
        self.n = 0

    def save(self, df: DataFrame, codec: str = "zstd", rows: int = 0) -> DataFrame:
        """rows: of a file at most, if they are large; 0: any number."""
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.option("compression", codec).option("maxRecordsPerFile", rows).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pellucid_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of which nothing that is still to run depends."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._pellucid_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans that nothing refers to, which it does as the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


_state: dict[object, Any] = {}


def process_state(key: object, make: Callable[[], Any]) -> Any:
    """A worker process's one large state, such as a vocabulary with its cache or a model.

    Processes outlive tasks: a task that asks for another key, or calls release(), frees what an earlier job left.
    """
    if key not in _state:
        release()
        _state[key] = make()
        trim()  # what making it took besides
    return _state[key]


def release() -> None:
    """Frees the process's state, and what earlier tasks left of free memory."""
    if _state:
        _state.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Gives the process's free memory back to the system where that can be asked for, as processes outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def sliced(batches: Iterable, rows: int = 500) -> Iterator:
    """Record batches of fewer rows, so that fewer texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_salt():
    """A well-mixed long for each row of a scan; equal rows get different values."""
    return F.xxhash64(F.monotonically_increasing_id())

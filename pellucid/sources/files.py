"""Folders of a query's own, and relations of whole files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, as a full URI; only a local session may lack the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_base()
    return make_folder(spark, f"{base}/pellucid-{uuid.uuid4().hex}")


def make_folder(spark: SparkSession, folder: str) -> str:
    """The folder, made if there is none, as a full URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs.makeQualified(path).toString()


@cache
def _local_base() -> str:
    """A temporary folder of this process, removed as it ends."""
    path = tempfile.mkdtemp(prefix="pellucid-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes each row (name, content) as a file of its own, by the tasks, and gives their number.

    A file has its name only once it is whole, and tasks that run again write the same files.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        for pdf in parts:
            for name, content in zip(pdf["name"], pdf["content"]):
                part = f"{base}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(bytes(content))
                fs.move(part, f"{base}/{name}")
            yield pdf[["name"]]

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(run, "name string").count()

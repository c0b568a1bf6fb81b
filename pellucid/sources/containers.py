"""Results in container files: ``df.write.format("containers").mode("append").save(folder)`` with columns name and content.

A task writes its rows one after the other to container files, and an index (name, file, offset, length) beside each. Only
what the commit lists is there: a commit is one small file, written once all tasks have succeeded, so readers see a write whole or not at
all, and files of tasks that failed or ran twice are never listed. An aborted write deletes its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes after which a task begins another container.
ROLL = 256 << 20
INDEX = "name string, file string, offset long, length long"


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, roll: int, columns: list[str]):
        self.folder, self.roll, self.columns = folder, roll, columns

    def write(self, iterator: Iterator[Any]) -> WriterCommitMessage:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        files: list[str] = []
        out, rows, at, total = None, [], 0, 0

        def close() -> None:
            out.close()
            table = pa.table({"name": [r[0] for r in rows], "file": [files[-1]] * len(rows), "offset": pa.array([r[1] for r in rows], pa.int64()), "length": pa.array([r[2] for r in rows], pa.int64())})
            pq.write_table(table.sort_by("name"), f"{base}/{files[-1]}.index", filesystem=fs)

        for row in iterator:
            if out is None or at >= self.roll:
                if out is not None:
                    close()
                files.append(f"container-{uuid.uuid4().hex}")
                out, rows, at = fs.open_output_stream(f"{base}/{files[-1]}"), [], 0
            data = bytes(row["content"] or b"")
            out.write(data)
            rows.append((row["name"], at, len(data)))
            at += len(data)
            total += 1
        if out is not None:
            close()
        return _Written(files, total)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{base}/_{name}") as f:
            f.write(json.dumps({"files": [x for m in messages if m for x in m.files], "rows": sum(m.rows for m in messages if m)}).encode())
        fs.move(f"{base}/_{name}", f"{base}/commit-{name}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(self.folder)
        for file in (x for m in messages if m for x in m.files):
            for path in (f"{base}/{file}", f"{base}/{file}.index"):
                fs.delete_file(path)


class Containers(DataSource):
    """Options: path, and roll (bytes of a container)."""

    @classmethod
    def name(cls) -> str:
        return "containers"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("containers are only appended to")
        return _Writer(self.options["path"], int(self.options.get("roll", ROLL)), schema.names)


def write(rows: DataFrame, folder: str, roll: int = ROLL) -> None:
    """Appends rows (name, content) to the folder's containers."""
    rows.sparkSession.dataSource.register(Containers)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("containers").mode("append").option("roll", roll).save(folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """name, file, offset, length of all that is committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    commits = [str(s.getPath()) for s in fs.listStatus(path) if s.getPath().getName().startswith("commit-")] if fs.exists(path) else []
    files = [x.file for x in spark.read.json(commits, schema="files array<string>").select(F.explode("files").alias("file")).collect()] if commits else []  # one name for each container
    return spark.read.schema(INDEX).parquet(*[f"{folder}/{f}.index" for f in files]) if files else spark.createDataFrame([], INDEX)


def fetch(found: DataFrame, folder: str) -> DataFrame:
    """name and content of index rows: each one range of its container."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        for pdf in parts:
            out = []
            for file, rows in pdf.sort_values(["file", "offset"]).groupby("file"):
                with fs.open_input_file(f"{base}/{file}") as f:
                    for r in rows.itertuples():
                        f.seek(r.offset)
                        out.append((r.name, f.read(r.length)))
            yield pd.DataFrame(out, columns=["name", "content"])

    return found.select("name", "file", "offset", "length").mapInPandas(run, "name string, content binary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """name and content of all results."""
    return fetch(index(spark, folder), folder)


def lookup(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """name and content of the results that are asked for; names: name."""
    return fetch(index(spark, folder).join(names.select("name").distinct(), "name", "left_semi"), folder)

"""Manifest files."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.functions import paths as p
from pellucid.operators import manifest
from pellucid.sources.images import same_uri

#: Bytes of a file in which its header is sought, and files whose headers are read at once.
HEADER, AT_ONCE = 1 << 16, 32


def paths_of(given: object) -> list[str]:
    """One path or several; blank ones among several go."""
    if given is None:
        return []
    if isinstance(given, str) or hasattr(given, "__fspath__"):
        return [str(given)]
    return [str(x) for x in given if str(x).strip()] if isinstance(given, Iterable) else []


def _files(spark: SparkSession, path: str) -> list[str]:
    """The file, or a folder's files by name, as full URIs."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(at) if s.isFile()]
    return sorted(x.toUri().toString() for x in found if not x.getName().startswith(("_", ".")) or len(found) == 1)


def _header(spark: SparkSession, uri: str) -> list[str]:
    """A file's first record, of which no more than its first bytes are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
    with_ = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        first = bytes(with_.readNBytes(HEADER))
    finally:
        with_.close()
    return next(csv.reader(io.StringIO(first.decode("utf-8-sig", "replace"), newline="")), [])


def _unique(names: list[str]) -> list[str]:
    """Column names; a repeated or empty one gets its place in the name."""
    return [x if x and x not in names[:i] else f"{x}_{i}" for i, x in enumerate(names)]


def read(spark: SparkSession, given: object, image_root: str | None = None, multiline: bool = True) -> DataFrame:
    """image_path, gt_label, dataset_name of all manifests, files or folders of them; of equal paths the last row of the last file.

    Files need image_path and gt_label; labels that are null or no number are errors. Files without rows are skipped, and an error if all are.
    Files of one header are one scan. A row's place is its file's place in the list, its split's place in the file and its own
    in the split, so files are read in any number of splits. Fields may be quoted over several lines, for which a file is read as one split;
    multiline=False is for files without such fields, and lets large ones be split. Headers are read by the driver, a small piece of each file.
    """
    given = paths_of(given)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        files = [(uri, place, given[place]) for place, found in enumerate(pool.map(lambda g: _files(spark, g), given)) for uri in found]
        headers = list(pool.map(lambda f: tuple(_unique(_header(spark, f[0]))), files))
    groups: dict[tuple[str, ...], list[int]] = {}
    for i, h in enumerate(headers):
        if missing := manifest.missing_columns(list(h)):
            raise ValueError(f"{files[i][2]} lacks columns: {', '.join(missing)}")
        groups.setdefault(h, []).append(i)
    out = None
    for names, members in groups.items():
        known = {files[i][0]: (i, PurePosixPath(files[i][2]).stem, str(PurePosixPath(files[i][2]).parent)) for i in members}  # the last place of a file that is given twice
        table = spark.createDataFrame([(_plain(uri), i, stem, folder) for uri, (i, stem, folder) in known.items()], "file string, file_ord long, stem string, folder string")
        raw = spark.read.schema(", ".join("`" + n.replace("`", "``") + "` string" for n in names)).option("header", True).option("multiLine", multiline).csv([_path(spark, u) for u in known])
        rows = raw.select(same_uri(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row_ord"), *[F.col("`" + n.replace("`", "``") + "`").alias(n) for n in (*manifest.REQUIRED, "dataset_name") if n in names])
        rows = manifest.with_dataset(rows.join(F.broadcast(table), "file"), F.col("stem"))  # as many rows as files are given
        rows = rows.select(p.resolve(F.col("image_path"), F.col("folder"), image_root).alias("image_path"), manifest.required_label(F.col("gt_label")).alias("gt_label"), "dataset_name", "file_ord", "split", "row_ord")
        out = rows if out is None else out.unionByName(rows)
    if out is None or out.select("file_ord").isEmpty():
        raise ValueError("no manifest has rows")
    return manifest.keep_last(out.filter("image_path <> ''"), "image_path", "file_ord", "split", "row_ord").select("image_path", "gt_label", "dataset_name")


def _plain(uri: str) -> str:
    return "file:/" + uri.split(":", 1)[1].lstrip("/") if uri.startswith("file:") else uri


def _path(spark: SparkSession, uri: str) -> str:
    """A URI as readers take it: not encoded."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()

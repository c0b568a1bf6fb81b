"""Manifests: image_path, gt_label, dataset_name; one row per path, later files win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("image_path", "gt_label")


def missing_columns(columns: list[str]) -> list[str]:
    return sorted(set(REQUIRED) - set(columns))


def label(value: Column) -> Column:
    """A whole number, cut towards zero; what isn't a number is an error, and null stays null."""
    return value.cast("double").cast("int")


def required_label(value: Column) -> Column:
    """A label that must be there."""
    return F.coalesce(label(value), F.raise_error(F.lit("gt_label can't be null")).cast("int"))


def with_dataset(df: DataFrame, stem: Column) -> DataFrame:
    """The file's stem as dataset_name where the file has no such column."""
    return df if "dataset_name" in df.columns else df.withColumn("dataset_name", stem)


def keep_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in the given order, nulls first, with all columns. Rows of one key are reduced before they are shuffled."""
    return _pick(df, key, F.max_by(F.struct(*df.columns), F.struct(*order)))


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order, nulls last."""
    return _pick(df, key, F.min_by(F.struct(*df.columns), F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])))


def _pick(df: DataFrame, key: str, row: Column) -> DataFrame:
    return df.groupBy(key).agg(row.alias("_row")).select("_row.*")


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of the files, with file_ord, the file's place in the list."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("file_ord", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out


def by_image(df: DataFrame, order: str) -> DataFrame:
    """One row per path: its label and dataset are those of the first row in order. Null paths go."""
    first = F.min(F.struct(order, "gt_label", "dataset_name")).alias("f")
    return df.filter("image_path is not null").groupBy("image_path").agg(first, F.count("*").alias("n")).select("image_path", "f.gt_label", "f.dataset_name", "n")


#: Paths of a label map's bucket, about.
IN_A_MAP = 10_000


def label_maps(df: DataFrame, buckets: int) -> DataFrame:
    """bucket, labels: all labels as bounded maps from path to label, one for each hash bucket; of equal paths the greatest label. Null paths go.

    buckets: as many as keep a map small, IN_A_MAP paths or so.
    """
    one = df.filter("image_path is not null").groupBy("image_path").agg(F.max("gt_label").alias("gt_label"))
    return one.groupBy(_bucket(F.col("image_path"), buckets).alias("bucket")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("image_path", "gt_label")))).alias("labels"))


def label_of(df: DataFrame, maps: DataFrame, buckets: int) -> DataFrame:
    """Adds label, the label of image_path in maps of so many buckets; null where there is none. A row meets its bucket's map only."""
    return df.withColumn("bucket", F.coalesce(_bucket(F.col("image_path"), buckets), F.lit(0))).join(maps, "bucket", "left").withColumn("label", F.try_element_at("labels", F.coalesce("image_path", F.lit("")))).drop("bucket", "labels")


def _bucket(path: Column, buckets: int) -> Column:
    return F.when(path.isNotNull(), F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int"))

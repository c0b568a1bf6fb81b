"""Verdicts, resuming, and the cache of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pellucid.functions import paths


def pending(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest rows without a result; done: result_id."""
    return manifest.withColumn("result_id", paths.result_id(F.col("image_path"))).join(done.select("result_id").distinct(), "result_id", "left_anti")


def savable(is_success: Column, response: Column) -> Column:
    """Has a response that isn't marked as failed; an unknown success passes."""
    return response.isNotNull() & ~is_success.eqNullSafe(F.lit(False))


def attach_labels(verdicts: DataFrame, manifest: DataFrame) -> DataFrame:
    return verdicts.join(manifest.select("image_path", "gt_label", "dataset_name"), "image_path")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The newest valid row of each key; at equal order, rows of new win. Versions of one key are reduced before they are shuffled."""
    columns = old.columns
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, "_new")).alias("_row")).select("_row.*")


def valid_profile(profile: Column) -> Column:
    """A map has the three keys that a profile needs; their values may be null."""
    out = F.lit(True)
    for k in ("observations", "detected_anomalies", "pred_label"):
        out &= F.map_contains_key(profile, F.lit(k))
    return out


def lookup(wanted: DataFrame, cache: DataFrame, keys: str = "keys") -> DataFrame:
    """Each wanted row (id, keys) with the profile of its first key that the cache (key, profile) has; null without one."""
    hits = wanted.select("id", F.posexplode(keys).alias("at", "key")).join(cache, "key")
    first = hits.groupBy("id").agg(F.min_by(F.struct("key", "profile"), "at").alias("hit"))
    return wanted.join(first, "id", "left").select("id", F.col("hit.key").alias("key"), F.col("hit.profile").alias("profile"))

"""The cache of profiles: a table in buckets of its keys, of which a save rewrites those that it touches and a lookup reads those that it needs.

Below the root lie folders ``save=<id>/bucket=<n>``, which are never changed, lists ``snapshot-<id>.json`` that say for each
bucket in which save it is, and empty files ``POINTER-<number>-<id>`` whose newest names the list that counts. Readers see the
state before a save or after it whole; a save that breaks off leaves the one before. Of saves at the same time, the one that first
claims the next number goes on and others begin again, so none loses the other's rows. Old saves are cleared by hand.

Rows whose image_path is null or blank are not kept. Of equal paths the highest version stays, at equal versions the newer save's.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.operators.results import upsert

PROFILE = "image_path string, observations string, detected_anomalies string, limitations string, pred_label int, version long"
#: Buckets of a new cache; a cache keeps its number.
BUCKETS = 256
POINTER = re.compile(r"POINTER-(\d{12})-([0-9a-f]{32})")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def newest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The number and id of the newest pointer; ties go to the greater name."""
    fs, p = _fs(spark, root)
    found = [POINTER.fullmatch(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
    return max(((int(m[1]), m[2]) for m in found if m), default=(0, None))


def _listed(spark: SparkSession, root: str, snapshot: str | None, buckets: int) -> tuple[int, dict[int, str]]:
    """The number of buckets, and the save that has each."""
    if snapshot is None:
        return buckets, {}
    known = json.loads("\n".join(r.value for r in spark.read.text(f"{root}/snapshot-{snapshot}.json").collect()))  # a row, of the buckets' number
    return known["buckets"], {int(k): v for k, v in known["saves"].items()}


def _rows(spark: SparkSession, root: str, saves: dict[int, str]) -> DataFrame:
    """The rows of those buckets, with their bucket."""
    ddl = f"{PROFILE}, save string, bucket int"
    if not saves:
        return spark.createDataFrame([], ddl).drop("save")
    folders = [f"{root}/save={s}/bucket={b}" for b, s in sorted(saves.items())]
    return spark.read.schema(ddl).option("basePath", root).parquet(*folders).drop("save")


def read(spark: SparkSession, root: str) -> DataFrame:
    """All profiles of the cache; none if there is no cache."""
    return _rows(spark, root, _listed(spark, root, newest(spark, root)[1], BUCKETS)[1]).drop("bucket")


def save(spark: SparkSession, root: str, new: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds profiles and gives the cache's state; only buckets that have a key of theirs are read and written."""
    valid = new.filter("image_path is not null and image_path <> ''")
    while True:
        n, old = newest(spark, root)
        count, saves = _listed(spark, root, old, buckets)
        keyed = valid.withColumn("bucket", bucket_of(F.col("image_path"), count))
        touched = [r.bucket for r in keyed.select("bucket").distinct().collect()]  # at most the buckets
        if not touched:
            return read(spark, root)
        name = uuid.uuid4().hex
        before = _rows(spark, root, {b: saves[b] for b in touched if b in saves})
        both = upsert(before, keyed, "image_path", "version")
        both.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/save={name}")
        listed = {"buckets": count, "saves": saves | {b: name for b in touched}}
        fs, at = _fs(spark, f"{root}/snapshot-{name}.json")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        if newest(spark, root)[0] == n:
            fs, at = _fs(spark, f"{root}/POINTER-{n + 1:012d}-{name}")
            fs.create(at, False).close()
            if newest(spark, root) == (n + 1, name):
                return read(spark, root)


def lookup(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """wanted: id, keys (an array; null, blank and repeated ones are looked up at most once). Returns id, key and profile (a row) of the first key
    that the cache has, or nulls. Buckets without a wanted key are pruned as the query runs."""
    count, saves = _listed(spark, root, newest(spark, root)[1], BUCKETS)
    keys = wanted.select("id", F.posexplode("keys").alias("at", "key")).filter("key <> ''").withColumn("bucket", bucket_of(F.col("key"), count))
    cache = _rows(spark, root, saves)
    # as many rows as there are buckets at most; the comparison tells the optimizer that they are few
    needed = F.broadcast(keys.select("bucket").distinct().filter(F.col("bucket") >= 0))
    near = cache.join(needed, "bucket", "left_semi").select(F.col("image_path").alias("key"), F.struct(*[c for c in cache.columns if c != "bucket"]).alias("profile"))
    hits = keys.join(near, "key")
    first = hits.groupBy("id").agg(F.min_by(F.struct("key", "profile"), "at").alias("hit"))
    return wanted.join(first, "id", "left").select("id", F.col("hit.key").alias("key"), F.col("hit.profile").alias("profile"))

"""Resampling of gray planes as sparse matrix products, and crops around the centre.

A plane is its rows: image_id, height, width, y, g (an array). Each pair of sizes has a table of weights (three-lobed Lanczos, widened when shrinking),
made by Spark from the sizes that occur. Along a row the weights are applied to the array; down the columns each row is
joined to the new rows that it adds to, and sums meet in the shuffle, so no task needs a whole image.

Rows whose array is null or shorter than the width, and images without a size, give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pellucid.operators import images

LOBES = 3


def _sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(F.pi() * x) / (F.pi() * x))


def weights(sizes: DataFrame) -> DataFrame:
    """sizes: size, to. Returns size, to, new, lo, w: the weights of the old samples from lo on in each new one."""
    scale = F.greatest(F.lit(1.0), F.col("size") / F.col("to"))
    rows = sizes.distinct().select("size", "to", scale.alias("scale"), F.explode(F.sequence(F.lit(0), F.col("to") - 1)).alias("new"))
    rows = rows.withColumn("centre", (F.col("new") + 0.5) * F.col("size") / F.col("to"))
    lo = F.greatest(F.lit(0), F.floor(F.col("centre") - LOBES * F.col("scale")))
    hi = F.least(F.col("size") - 1, F.ceil(F.col("centre") + LOBES * F.col("scale")))
    rows = rows.withColumns({"lo": lo.cast("int"), "hi": hi.cast("int")})

    def one(i: Column) -> Column:
        x = (i + 0.5 - F.col("centre")) / F.col("scale")
        return F.when(F.abs(x) < LOBES, _sinc(x) * _sinc(x / LOBES)).otherwise(0.0)

    rows = rows.withColumn("k", F.transform(F.sequence("lo", "hi"), one)).withColumn("sum", F.aggregate("k", F.lit(0.0), lambda a, x: a + x))
    return rows.select("size", "to", "new", "lo", F.transform("k", lambda k: k / F.col("sum")).alias("w"))


def resample(rows: DataFrame, new_width: Column, new_height: Column) -> DataFrame:
    """image_id, height, width, y, x, g: pixels of the planes at other sizes, which are columns of the rows' image."""
    r = rows.filter("g is not null and width > 0 and height > 0 and size(g) >= width").select("image_id", "y", "g", F.col("width").alias("w0"), F.col("height").alias("h0"), new_width.cast("int").alias("width"), new_height.cast("int").alias("height"))
    across = weights(r.select(F.col("w0").alias("size"), F.col("width").alias("to")))
    across = across.groupBy("size", "to").agg(F.array_sort(F.collect_list(F.struct("new", "lo", "w"))).alias("ws"))  # one width's weights
    r = r.join(across.withColumnsRenamed({"size": "w0", "to": "width"}), ["w0", "width"])

    def dot(p: Column) -> Column:
        part = F.zip_with(F.slice("g", p["lo"] + 1, F.size(p["w"])), p["w"], lambda v, w: v * w)
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x)

    r = r.withColumn("v", F.transform("ws", dot)).drop("ws", "g")
    down = weights(r.select(F.col("h0").alias("size"), F.col("height").alias("to"))).select(F.col("size").alias("h0"), F.col("to").alias("height"), "new", "lo", F.posexplode("w").alias("at", "w"))
    down = down.select("h0", "height", "new", (F.col("lo") + F.col("at")).alias("y"), "w")
    parts = r.join(down, ["h0", "height", "y"]).select("image_id", "height", "width", "new", "w", F.posexplode("v").alias("x", "v"))
    sums = parts.groupBy("image_id", "height", "width", F.col("new").alias("y"), "x").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    level = F.floor(F.round("v", 6) + 0.5)
    return sums.select("image_id", "height", "width", "y", "x", F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("int").alias("g"))


def within(rows: DataFrame, width: int | None, height: int | None) -> DataFrame:
    """Planes shrunk to the bounds, keeping their proportions; smaller ones stay."""
    size = images.resized(F.col("width"), F.col("height"), width, height)
    return resample(rows, F.greatest(size["width"], F.lit(1)), F.greatest(size["height"], F.lit(1)))


def centre_crop(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Planes scaled to cover the target, then cut around the centre."""
    scale = F.greatest(width / F.col("width"), height / F.col("height"))
    big = resample(rows, F.greatest(F.lit(width), F.bround(F.col("width") * scale)), F.greatest(F.lit(height), F.bround(F.col("height") * scale)))
    top, left = F.floor((F.col("height") - height) / 2), F.floor((F.col("width") - width) / 2)
    cut = big.filter((F.col("y") >= top) & (F.col("y") < top + height) & (F.col("x") >= left) & (F.col("x") < left + width))
    return cut.select("image_id", F.lit(height).alias("height"), F.lit(width).alias("width"), (F.col("y") - top).cast("int").alias("y"), (F.col("x") - left).cast("int").alias("x"), "g")

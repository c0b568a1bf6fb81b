"""Feature operators over gray planes and encoded images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pellucid.config import feature_settings
from pellucid.functions import kernels
from pellucid.operators.plugins import Registry, default_features

#: Bytes per pixel by mode name of image libraries; three where unknown.
CHANNELS = {"L": 1, "LA": 2, "P": 1, "PA": 2, "RGB": 3, "RGBA": 4, "CMYK": 4, "YCbCr": 3, "HSV": 3, "LAB": 3}


def _per_shape(values: pd.Series, heights: pd.Series, widths: pd.Series, kernel: Callable[[np.ndarray], np.ndarray]) -> list:
    """Runs a kernel on stacks of planes of one shape; nulls, and planes that don't fill their shape, give null."""
    out: list = [None] * len(values)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (v, h, w) in enumerate(zip(values, heights, widths)):
        if v is not None and h == h and w == w and h and w and len(v) == int(h) * int(w):
            groups.setdefault((int(h), int(w)), []).append(i)
    for (h, w), rows in groups.items():
        step = max(1, (1 << 22) // (h * w))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            got = kernel(np.stack([np.asarray(values.iloc[i]) for i in part]).reshape(-1, h, w))
            for i, x in zip(part, got):
                out[i] = x.tolist()
    return out


def features(plane: Column, height: Column, width: Column, kind: str, **options) -> Column:
    """An array of doubles: one feature group (lbp, glcm, edge, fft, dct, wavelet) of a plane."""
    kernel = kernels.KERNELS[kind]

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, h, w in parts:
            yield pd.Series(_per_shape(v, h, w, lambda g: kernel(g, **options)), dtype=object)

    return run(plane, height, width)


def laplacian(plane: Column, height: Column, width: Column) -> Column:
    """Variance of the Laplacian."""

    @F.pandas_udf("double")
    def run(v: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(_per_shape(v, h, w, kernels.laplacian_variance), dtype=float)

    return run(plane, height, width)


def kernel_options(settings: dict) -> dict[str, dict]:
    """What checked feature settings mean to each kernel."""
    return {
        "fft": {"bins": settings["radial_bins"]},
        "dct": {"block": settings["dct_block"], "most": settings["max_dct_blocks"]},
        "wavelet": {"levels": settings["wavelet_levels"]},
    }


def bundle(plane: Column, height: Column, width: Column, groups: tuple[str, ...] | None = None, settings: dict | None = None, registry: Registry | None = None, switches: dict[str, bool] | None = None) -> Column:
    """A struct of the chosen feature groups, computed in one pass; groups that are left out or switched off never run.

    settings: as config.feature_settings takes them; registry: extractors by name, the built-in ones if not given. A
    registered extractor takes a stack of planes and gives a row of numbers for each.
    """
    checked = feature_settings(settings)
    known = (registry or default_features()).enabled(switches)
    chosen = [g for g in groups or checked["groups"] if g in known or switches is None or switches.get(g, True)]
    if missing := [g for g in chosen if g not in known]:
        raise ValueError(f"no such feature groups: {', '.join(missing)}")
    if not chosen:
        raise ValueError("all feature groups are switched off")
    options = kernel_options(checked)
    run_of = {g: (known[g], options.get(g, {}) if known[g] is kernels.KERNELS.get(g) else {}) for g in chosen}

    @F.pandas_udf(", ".join(f"`{g}` array<double>" for g in chosen))
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for v, h, w in parts:
            yield pd.DataFrame({g: pd.Series(_per_shape(v, h, w, lambda x, k=k, o=o: k(x, **o)), dtype=object) for g, (k, o) in run_of.items()})

    return run(plane, height, width)


def bytes_per_pixel(mode: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv]), mode), F.lit(3))


def compression_ratio(width: Column, height: Column, channels: Column, file_size: Column) -> Column:
    return F.when(file_size > 0, F.round(width * height * channels / file_size, 4)).otherwise(F.lit(0.0))


def resized(width: Column, height: Column, max_width: int | None, max_height: int | None) -> Column:
    """New width, new height and ratio within bounds, keeping the proportions."""
    if max_width is None and max_height is None:
        return F.struct(width.alias("width"), height.alias("height"), F.lit(1.0).alias("ratio"))
    ratios = [F.lit(float(m)) / s for m, s in ((max_width, width), (max_height, height)) if m is not None]
    ratio = F.least(*ratios, F.lit(float("inf")))
    fits = F.lit(True)
    for m, s in ((max_width, width), (max_height, height)):
        if m is not None:
            fits &= s <= m
    return F.when(fits, F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"), F.lit(1.0).alias("ratio"))).otherwise(
        F.struct(F.floor(width * ratio).alias("width"), F.floor(height * ratio).alias("height"), ratio.alias("ratio"))
    )


def mask_union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def mask_apply(pixels: Column, mask: Column) -> Column:
    """Pixels where the mask is 255, else 0."""
    return F.zip_with(pixels, mask, lambda p, m: F.when(m == 255, p).otherwise(0))


def gray(pixels: DataFrame) -> DataFrame:
    """Adds g, the 8-bit luma of integer columns r, g, b."""
    return pixels.withColumn("luma", F.shiftright(F.col("r") * 19595 + F.col("g") * 38470 + F.col("b") * 7471 + 32768, 16))

"""Resampling by joins equals the dense product, and crops cut where they should."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pellucid.functions import kernels as k
from pellucid.operators import resample

SHAPES = [(20, 30), (64, 48), (7, 9), (1, 5), (33, 33), (8, 8)]


@pytest.fixture(scope="module")
def planes():
    r = np.random.default_rng(2)
    return {i: r.integers(0, 256, s).astype(np.uint8) for i, s in enumerate(SHAPES)}


@pytest.fixture(scope="module")
def rows(spark, planes):
    data = [(i, *g.shape, y, g[y].tolist()) for i, g in planes.items() for y in range(g.shape[0])] + [(9, 4, 4, 0, None), (8, 4, 4, 0, [1])]
    return spark.createDataFrame(data, "image_id long, height int, width int, y int, g array<int>").repartition(3)


def whole(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, np.full((r.height, r.width), -1))[r.y, r.x] = r.g
    return out


def near(a, b):
    assert a.shape == b.shape and np.abs(a.astype(int) - b.astype(int)).max() <= 1 and (a != b).mean() < 0.01


@pytest.mark.parametrize("size", [(7, 5), (40, 61)])
def test_sizes(rows, planes, size):
    got = whole(resample.resample(rows, F.lit(size[0]), F.lit(size[1])))
    assert set(got) == set(planes)
    for i, g in planes.items():
        near(got[i], k.resize(g, *size))


def test_within_bounds(rows, planes):
    got = whole(resample.within(rows, 24, 16))
    for i, g in planes.items():
        h, w = g.shape
        ratio = min(24 / w, 16 / h, 1)
        near(got[i], k.resize(g, int(w * ratio), int(h * ratio)) if ratio < 1 else g)
        assert ratio < 1 or (got[i] == g).all()


def test_centre_crop(rows, planes):
    got = whole(resample.centre_crop(rows, 16, 12))
    for i, g in planes.items():
        near(got[i], k.centre_crop(g, 16, 12))


def test_halves_after_six_decimals(spark):
    """A sample of 137.4999997 is a half after six decimals: the kernel rounds it as the join does."""
    g = np.array([
        142, 117, 140, 129, 138, 144, 126, 140, 114, 137, 123, 113, 121, 137, 130, 95, 158, 124, 90, 142, 128, 114, 122, 113, 148, 120, 129, 113, 136, 156, 109, 131,
        141, 139, 114, 126, 140, 138, 111, 152, 129, 120, 132, 148, 110, 128, 111, 103, 135, 130, 107, 131, 147, 148, 127, 127, 158, 140, 155, 120, 169, 122, 129, 139,
    ], np.uint8).reshape(8, 8)
    rows = spark.createDataFrame([(0, 8, 8, y, g[y].tolist()) for y in range(8)], "image_id long, height int, width int, y int, g array<int>")
    assert (whole(resample.centre_crop(rows, 6, 5))[0] == k.centre_crop(g, 6, 5)).all() and k.resize(g, 6, 6)[0, 4] == 138

"""Pixels with neighbours from a table function."""

from pyspark.sql import functions as F

from pellucid.operators import pixels


def test_pixels_and_neighbours(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6]), (2, None), (3, [1, 2, 3, 4]), (4, [])], "id long, p array<int>")
    got = pixels.rows(df, "p", 3, [(0, 1), (-1, -1)])
    assert got.columns == ["id", "p", "y", "x", "g", "n0", "n1"]
    assert sorted((r.id, r.y, r.x, r.g, r.n0, r.n1) for r in got.collect()) == [(1, 0, 0, 1, 2, None), (1, 0, 1, 2, 3, None), (1, 0, 2, 3, None, None), (1, 1, 0, 4, 5, None), (1, 1, 1, 5, 6, 1), (1, 1, 2, 6, None, 2)]
    pairs = pixels.pairs(got, ["id"], [F.lit("right"), F.lit("back")])
    assert sorted((r.name, r.g, r.neighbour) for r in pairs.collect()) == [("back", 5, 1), ("back", 6, 2), ("right", 1, 2), ("right", 2, 3), ("right", 4, 5), ("right", 5, 6)]
    assert pixels.rows(df, "p", 2).columns == ["id", "p", "y", "x", "g"] and pixels.rows(df, "p", 2).count() == 10

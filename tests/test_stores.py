"""Image headers read by range, and results in containers."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pellucid.plans.runs import image_file
from pellucid.sources import containers, headers


def parsed(data, log=None):
    def read(at, n):
        if log is not None:
            log.append((at, n))
        return data[at : at + n]

    return headers.header(read)


def test_headers_of_all_formats():
    g = np.arange(40 * 24, dtype=np.uint8).reshape(24, 40)
    for kind, name, mode in (("png", "PNG", "L"), ("bmp", "BMP", "P"), ("jpg", "JPEG", "RGB"), ("tiff", "TIFF", "L"), ("webp", "WEBP", "RGBA")):
        log = []
        assert parsed(image_file(kind, g), log) == {"format": name, "width": 40, "height": 24, "mode": mode, "error": None}
        assert sum(n for _, n in log) < 300
    lossless = b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + (99 | 49 << 14 | 1 << 28).to_bytes(4, "little") + bytes(9)
    lossy = b"RIFF\0\0\0\0WEBPVP8 " + bytes(7) + b"\x9d\x01\x2a" + (300).to_bytes(2, "little") + (200).to_bytes(2, "little")
    assert [parsed(x)["width"] for x in (lossless, lossy)] == [100, 300] and parsed(lossless)["mode"] == "RGBA"


def test_damaged_headers_are_errors_not_crashes():
    g = np.zeros((16, 16), np.uint8)
    r = np.random.default_rng(1)
    for kind in ("png", "bmp", "jpg", "tiff", "webp"):
        whole = image_file(kind, g)
        for n in range(0, min(len(whole), 200)):
            h = parsed(whole[:n])
            assert h["error"] or (h["width"], h["height"]) == (16, 16)
        for _ in range(300):
            data = bytearray(whole)
            for at in r.integers(0, min(len(data), 160), 4):
                data[at] = r.integers(0, 256)
            h = parsed(bytes(data))
            assert (h["error"] is None) == (h["width"] is not None)


def test_a_filter_on_suffix_is_planned(spark, tmp_path):
    g = np.zeros((8, 8), np.uint8)
    for i in range(30):
        (tmp_path / f"a{i}.png").write_bytes(image_file("png", g))
        (tmp_path / f"b{i}.BMP").write_bytes(image_file("bmp", g))
    (tmp_path / "n.txt").write_text("no image")
    (tmp_path / "empty.jpg").write_bytes(b"")
    headers.register(spark)
    df = spark.read.format("image_headers").option("files", 7).load(f"file://{tmp_path}")
    assert df.count() == 61 and df.rdd.getNumPartitions() == 9
    some = df.filter("suffix = 'bmp'")
    assert some.count() == 30 and some.rdd.getNumPartitions() == 5
    assert df.filter(F.col("suffix").isin("png", "jpg")).count() == 31
    assert [r.error for r in df.filter("suffix = 'jpg'").collect()] == ["not an image of a known format"]
    assert df.filter(F.endswith("path", F.lit(".PNG"))).count() == 0


def test_containers_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    rows = spark.range(400).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"), F.encode(F.repeat(F.col("id").cast("string"), (F.col("id") % 9).cast("int")), "UTF-8").alias("content"))
    assert containers.read(spark, folder).count() == 0
    containers.write(rows.filter("substring(name, 2) < '5'").repartition(3), folder, 300)
    containers.write(rows.filter("substring(name, 2) >= '5'").repartition(2), folder)
    got = {r.name: bytes(r.content) for r in containers.read(spark, folder).collect()}
    assert got == {f"r{i}": str(i).encode() * (i % 9) for i in range(400)}
    assert containers.index(spark, folder).select("file").distinct().count() > 5
    asked = spark.createDataFrame([("r7",), ("r7",), ("none",), ("r399",)], "name string")
    assert {r.name: bytes(r.content) for r in containers.lookup(spark, folder, asked).collect()} == {"r7": b"7777777", "r399": b"399399399"}
    at = {r.name: r for r in containers.index(spark, folder).collect()}
    for file in {r.file for r in at.values()}:  # a lookup of one reads its range alone
        size = os.path.getsize(f"{tmp_path}/c/{file}")
        keep = [(r.offset, r.length) for r in at.values() if r.file == file and r.name in ("r7", "r399")]
        with open(f"{tmp_path}/c/{file}", "r+b") as f:
            data = bytearray(b"#" * size)
            old = f.read()
            for o, n in keep:
                data[o : o + n] = old[o : o + n]
            f.seek(0)
            f.write(data)
    assert {r.name: bytes(r.content) for r in containers.lookup(spark, folder, asked).collect()} == {"r7": b"7777777", "r399": b"399399399"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    good = spark.createDataFrame([("a", b"1"), ("b", b"2")], "name string, content binary")
    containers.write(good, folder)
    before = sorted(os.listdir(tmp_path / "c"))
    bad = spark.range(50).repartition(4).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception):
        containers.write(bad, folder)
    assert {r.name for r in containers.read(spark, folder).collect()} == {"a", "b"}
    listed = {f for c in os.listdir(tmp_path / "c") if c.startswith("commit-") for f in json.load(open(tmp_path / "c" / c))["files"]}
    assert all(f in before for f in listed) and sorted(x for x in os.listdir(tmp_path / "c") if x.startswith("commit-")) == [x for x in before if x.startswith("commit-")]

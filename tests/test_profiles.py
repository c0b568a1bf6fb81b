"""The cache in buckets: what saves write, what lookups read, and saves that meet or break off."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pellucid.sources import profiles

row = lambda p, o, v=1: (p, o, "", "", 1, v)


def frame(spark, rows):
    return spark.createDataFrame(rows, profiles.PROFILE)


def state(df):
    return {r.image_path: r.observations for r in df.collect()}


def size(root, save=None):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet") and (save is None or f"save={save}" in d))


def test_states(spark, tmp_path):
    root = str(tmp_path / "cache")
    assert profiles.read(spark, root).count() == 0
    profiles.save(spark, root, frame(spark, [row("a", "old"), row("b", "b"), row("", "bad"), row(None, "bad"), row("a", "older", 0)]), 8)
    got = profiles.save(spark, root, frame(spark, [row("a", "new"), row("b", "stale", 0)]))
    assert state(got) == {"a": "new", "b": "b"}
    assert state(profiles.save(spark, root, frame(spark, []))) == {"a": "new", "b": "b"}


def test_a_save_writes_the_buckets_of_its_keys(spark, tmp_path):
    root = str(tmp_path / "cache")
    profiles.save(spark, root, frame(spark, [row(f"k{i}", "x" * 50 + str(i)) for i in range(6400)]), 64)
    whole = size(root)
    small = frame(spark, [row("k7", "changed", 2)])
    got = profiles.save(spark, root, small)
    name = profiles.newest(spark, root)[1]
    assert len([d for d in os.listdir(f"{root}/save={name}") if d.startswith("bucket=")]) == 1
    assert 0 < size(root, name) < whole / 30
    want = state(got)
    assert want["k7"] == "changed" and len(want) == 6400
    assert state(profiles.save(spark, root, small)) == want  # a replay
    listed = json.load(open(f"{root}/snapshot-{profiles.newest(spark, root)[1]}.json"))
    assert listed["buckets"] == 64 and len(listed["saves"]) == 64


def test_a_lookup_reads_the_buckets_of_its_keys(spark, tmp_path):
    root = str(tmp_path / "cache")
    profiles.save(spark, root, frame(spark, [row(f"k{i}", f"o{i}") for i in range(2000)]), 64)
    rows = [(1, ["nope", "k5", "k6"]), (2, [None, "", "k5"]), (3, ["k9", "k9"]), (4, ["nope"]), (5, []), (6, None)]
    wanted = spark.createDataFrame(rows, "id long, keys array<string>")
    got = profiles.lookup(spark, root, wanted)
    assert "dynamicpruning" in got._jdf.queryExecution().toString()
    need = {r.b for r in spark.createDataFrame([("nope",), ("k5",), ("k6",), ("k9",)], "k string").select(profiles.bucket_of(F.col("k"), 64).alias("b")).collect()}
    harmed = 0
    for d, _, files in os.walk(root):  # what is not needed can't be read any more
        if "bucket=" in d and int(d.rsplit("=", 1)[1]) not in need:
            for f in files:
                if f.endswith(".parquet"):
                    (lambda p: open(p, "wb").write(b"x" * os.path.getsize(p)))(os.path.join(d, f))
                    harmed += 1
                elif f.endswith(".crc"):
                    os.remove(os.path.join(d, f))
    assert harmed >= 64 - len(need)
    assert {r.id: (r.key, r.profile and r.profile.observations) for r in got.collect()} == {1: ("k5", "o5"), 2: ("k5", "o5"), 3: ("k9", "o9"), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_lookups_lose_no_key(spark, tmp_path):
    root = str(tmp_path / "cache")
    profiles.save(spark, root, frame(spark, [row(f"k{i}", f"o{i}") for i in range(0, 900, 2)]), 16)
    wanted = spark.range(900).select("id", F.array(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit("k0")).alias("keys"))
    got = {r.id: r.profile.observations for r in profiles.lookup(spark, root, wanted).collect()}
    assert got == {i: f"o{i}" if i % 2 == 0 else "o0" for i in range(900)}


def test_a_save_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "cache")
    one = lambda p: frame(spark, [row(p, p)])
    profiles.save(spark, root, one("a"), 4)
    reader = profiles.read(spark, root)
    with monkeypatch.context() as m:
        m.setattr(profiles, "upsert", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            profiles.save(spark, root, one("b"))
    assert set(state(profiles.read(spark, root))) == {"a"}
    real, other = profiles.upsert, []

    def meanwhile(*a):
        if not other:  # another save comes first
            other.append(1)
            profiles.save(spark, root, one("c"))
        return real(*a)

    monkeypatch.setattr(profiles, "upsert", meanwhile)
    assert set(state(profiles.save(spark, root, one("d")))) == {"a", "c", "d"}
    assert set(state(reader)) == {"a"}

import datetime as dt
import os
import random
import time
from contextlib import contextmanager

from pyspark.sql import functions as F

from pellucid.operators import stages
from pellucid.sources import profiles
from pellucid.streaming import streams


def test_stage_states_and_profiles(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, 0, "human", "q", None), (1, 1, "ai", "update stage to: done", None), (2, 1, "ai", "hm", None)]
    ddl = "conv_id long, seq long, role string, content string, reasoning string"
    spark.createDataFrame(rows, ddl).write.json(str(src))
    out = streams.stage_states(spark.readStream.schema(ddl).json(str(src)))
    q = out.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.conv_id: (r.stage, r.unparsed) for r in spark.table("states").collect()} == {1: ("DONE", 0), 2: ("INITIAL", 1)}

    spark.createDataFrame([("a", "o", "", "", 1, 5)], profiles.PROFILE).write.json(str(tmp_path / "p"))
    streams.upsert_profiles(spark.readStream.schema(profiles.PROFILE).json(str(tmp_path / "p")), str(tmp_path / "cache"), str(tmp_path / "pc")).awaitTermination(120)
    assert profiles.read(spark, str(tmp_path / "cache")).count() == 1


def test_manifest_stream_and_rates(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("image_path,gt_label,dataset_name\nx,1.0,d\n")
    q = streams.manifests(spark, str(tmp_path / "m")).writeStream.format("memory").queryName("m").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("m").first().gt_label == 1


@contextmanager
def rocksdb(spark):
    """RocksDB as state store, and batches for new rows only, as timers would ask for batches without end."""
    keys = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        streams.use_rocksdb(spark)
        spark.conf.set(keys[1], "false")
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_shuffled_and_repeated_messages_give_the_batch_answer(spark, tmp_path):
    r = random.Random(3)
    marks = ["", "update stage to: done", "update stage to: initial", "update stage to: evidence_adjudication"]
    rows = [(c, s, r.choice(["human", "ai", "ai", "tool"]), r.choice(marks), None) for c in range(12) for s in range(r.randrange(3, 15))]
    ddl = "conv_id long, seq long, role string, content string, reasoning string"
    given = rows + r.sample(rows, 20)
    r.shuffle(given)
    src = tmp_path / "shuffled"
    for i in range(4):
        spark.createDataFrame(given[i::4], ddl).coalesce(1).write.mode("append").json(str(src))
    with rocksdb(spark):
        run(streams.stage_trail(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(src)), 6), "trail", tmp_path)
    got = sorted((x.conv_id, x.seq, x.stage, x.unparsed) for x in spark.table("trail").collect())
    batch = spark.createDataFrame(rows, ddl).filter("role = 'ai'").select("conv_id", "seq", stages.marker(F.col("content"), F.col("reasoning")).alias("found"), (F.col("seq") + 1).alias("n"))
    assert got == sorted((x.conv_id, x.seq, x.stage, x.unparsed) for x in stages.trail(batch, 6, 4).collect())


def test_calls_meet_within_the_interval(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    starts = [("a", 1, "llm", at(0)), ("b", 1, "llm", at(5)), ("c", 2, "tool", at(10)), ("d", 2, "tool", at(500))]
    ends = [("a", at(3)), ("b", at(90)), ("c", at(9)), ("d", at(501)), ("x", at(2))]
    spark.createDataFrame(starts, "call_id string, session_id long, kind string, ts timestamp").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame(ends, "call_id string, ts timestamp").write.parquet(str(tmp_path / "e"))
    read = lambda p, ddl: spark.readStream.schema(ddl).parquet(str(tmp_path / p))
    run(streams.call_times(read("s", "call_id string, session_id long, kind string, ts timestamp"), read("e", "call_id string, ts timestamp")), "calls", tmp_path)
    assert {x.call_id: x.seconds for x in spark.table("calls").collect()} == {"a": 180.0, "d": 60.0}


def test_late_rows_leave_closed_windows_alone(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    ddl = "ts timestamp, kind string, duration double"
    src = tmp_path / "rates"
    for i, rows in enumerate([[(at(1), "llm", 1.0), (at(2), "error_llm", 0.0)], [(at(200), "llm", 2.0)], [(at(201), "llm", 1.0)], [(at(3), "llm", 9.0), (at(203), "llm", 4.0)], [(at(400), "llm", 1.0)]]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(src))
        for f in src.glob("*.parquet"):
            if not f.name.startswith("n"):
                f.rename(src / f"n{i}.parquet")
                os.utime(src / f"n{i}.parquet", (1_700_000_000 + i * 10,) * 2)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(src))
    run(streams.error_rates(stream), "rates", tmp_path)
    got = {(x.start, x.kind): (x.calls, x.seconds) for x in spark.table("rates").collect()}
    assert got == {(at(0), "llm"): (1, 1.0), (at(0), "error_llm"): (1, 0.0), (at(200), "llm"): (3, 7.0)}


def test_silent_conversations_are_forgotten(spark, tmp_path):
    ddl = "conv_id long, seq long, role string, content string, reasoning string"
    src, out = tmp_path / "quiet", tmp_path / "out"
    found = []
    with rocksdb(spark):
        for rows in ([(1, 0, "ai", "update stage to: done", None), (3, 5, "ai", "early", None)], [(2, 0, "ai", "hm", None)], [(1, 0, "ai", "hm", None)]):
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(str(src))
            trail = streams.stage_trail(spark.readStream.schema(ddl).json(str(src)), 20, 1)
            trail.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "qc")).trigger(availableNow=True).start().awaitTermination(120)
            found.append({(x.conv_id, x.stage) for x in spark.read.parquet(str(out)).collect()})
            time.sleep(2)
    assert found[0] == {(1, "DONE")}
    assert {(1, "EXPIRED"), (3, "EXPIRED"), (2, "INITIAL")} <= found[1]
    assert (1, "INITIAL") in found[2]  # nothing was left of its stage

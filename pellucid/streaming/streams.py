"""Streaming extensions: manifests that arrive as files, stages kept per image, windowed telemetry."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pellucid.operators import stages
from pellucid.sources import profiles

MANIFEST = "image_path string, gt_label string, dataset_name string"


def manifests(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of manifest files as they arrive."""
    rows = spark.readStream.schema(MANIFEST).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return rows.withColumn("gt_label", F.col("gt_label").cast("double").cast("int"))


def stage_states(messages: DataFrame, cap: int = 20) -> DataFrame:
    """The stage of every conversation after each batch of its messages.

    messages: conv_id, seq, role, content, reasoning. State is a stage and two counters for each conversation.
    """
    found = messages.withColumn("found", F.when(F.col("role") == "ai", stages.marker(F.col("content"), F.col("reasoning"))))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, seen, unparsed = state.get if state.exists else ("INITIAL", 0, 0)
        for pdf in parts:
            for role, name in pdf.sort_values("seq")[["role", "found"]].itertuples(index=False):
                seen += 1
                if role != "ai" or stage == "MAX_ITERATIONS":
                    continue
                if isinstance(name, str):
                    stage = name
                else:
                    unparsed += 1
                if (seen + unparsed) // 2 >= cap:
                    stage = "MAX_ITERATIONS"
        state.update((stage, seen, unparsed))
        yield pd.DataFrame([(key[0], stage, seen, unparsed)], columns=["conv_id", "stage", "messages", "unparsed"])

    return found.groupBy("conv_id").applyInPandasWithState(fold, "conv_id long, stage string, messages long, unparsed long", "stage string, messages long, unparsed long", "update", GroupStateTimeout.NoTimeout)


class _Trail(StatefulProcessor):
    """Keeps the replies of a conversation that wait for earlier messages, and the state up to the first gap."""

    def __init__(self, cap: int, expire_s: int):
        self.cap, self.expire_ms = cap, expire_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.expire_ms
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, role string, found string", ttl)
        self.state = handle.getValueState("state", "next long, stage string, unparsed long", ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        nxt, stage, bad = self.state.get() if self.state.exists() else (0, "INITIAL", 0)
        here = {int(s): (r, f) for s, r, f in self.waiting.get()} if self.waiting.exists() else {}
        for pdf in rows:
            for s, r, f in pdf[["seq", "role", "found"]].itertuples(index=False):
                if s >= nxt:  # what was folded before is a repeat
                    here.setdefault(int(s), (r, f if isinstance(f, str) else None))
        out = []
        while nxt in here:
            role, found = here.pop(nxt)
            nxt += 1
            if role == "ai":
                bad += found is None
                if stage != "MAX_ITERATIONS":
                    stage = "MAX_ITERATIONS" if (nxt + bad) // 2 >= self.cap else found or stage
                out.append((key[0], nxt - 1, stage, bad))
        self.state.update((nxt, stage, bad))
        if here:
            self.waiting.put([(s, *here[s]) for s in sorted(here)])
        else:
            self.waiting.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        yield pd.DataFrame(out, columns=["conv_id", "seq", "stage", "unparsed"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A conversation that has been silent is forgotten."""
        self.state.clear()
        self.waiting.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "seq": [-1], "stage": ["EXPIRED"], "unparsed": [0]})

    def close(self) -> None:
        pass


def stage_trail(messages: DataFrame, cap: int = 20, expire_s: int = 86_400) -> DataFrame:
    """The stage after every reply, whatever order its conversation's messages (seq from 0, without gaps in the end) come in, and once if they are repeated.

    A reply waits until all messages before it are there. A conversation without a message for ``expire_s`` seconds is
    forgotten and gives a row of stage EXPIRED. Needs the RocksDB state store, which use_rocksdb() sets. Timers ask for batches without end, so a
    query that is to stop by itself runs without batches of no rows (spark.sql.streaming.noDataMicroBatches.enabled).
    """
    rows = messages.select("conv_id", "seq", "role", F.when(F.col("role") == "ai", stages.marker(F.col("content"), F.col("reasoning"))).alias("found"))
    return rows.groupBy("conv_id").transformWithStateInPandas(_Trail(cap, expire_s), "conv_id long, seq long, stage string, unparsed long", "Append", "ProcessingTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def call_times(starts: DataFrame, ends: DataFrame, late: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """Calls whose start and end (call_id, ts) have both come: call_id, session_id, kind, started and seconds.

    An end belongs to a start of its id up to ``longest`` before it; state of either side goes once the watermark says that its
    partner can't come any more.
    """
    s = starts.select("call_id", "session_id", "kind", F.col("ts").alias("started")).withWatermark("started", late)
    e = ends.select(F.col("call_id").alias("_id"), F.col("ts").alias("_ended")).withWatermark("_ended", late)
    near = (F.col("_ended") >= F.col("started")) & (F.col("_ended") <= F.col("started") + F.expr(f"interval {longest}"))
    both = s.join(e, (F.col("call_id") == F.col("_id")) & near)
    return both.select("call_id", "session_id", "kind", "started", (F.col("_ended").cast("double") - F.col("started").cast("double")).alias("seconds"))


def error_rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Calls and errors by time window; events later than ``late`` are left out of windows that have closed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind")
    return w.agg(F.count("*").alias("calls"), F.sum("duration").alias("seconds")).select("window.start", "window.end", "kind", "calls", "seconds")


def upsert_profiles(rows: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Adds each batch of profiles to the cache, rewriting the buckets of its keys; a batch that is replayed changes nothing."""

    def add(batch: DataFrame, _: int) -> None:
        profiles.save(batch.sparkSession, root, batch)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

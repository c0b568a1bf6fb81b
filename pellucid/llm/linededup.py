"""Reversible line dedup: cuckoo filters by shard, backed by exact tables of reference counts.

A line's key is the line without blanks at its ends and with A-Z in lower case. The table of references counts the documents of
each key exactly. Documents are inserted and deleted in batches: a batch's signed counts are summed before they meet the
table. Keys that reach the threshold enter the cuckoo filter of their shard, and keys that fall below it leave it, so that deleting
what was inserted restores the state before. Texts are cleaned in one scan against the filters; keys of the table that a
filter takes for others are listed with it, so that the scan is exact. Filters too large to be sent to every task are met by
the distinct keys of the documents instead, shard by shard, and what passes is joined to the table.

A state is a numbered folder that counts once its filters are written; a save that breaks off leaves the one before.

Nulls, ties, repeats: a null text is one empty line, whose key is empty and never counted. A document is a row: repeated rows count
repeatedly, a line that a document repeats counts once. Ids play no part but in the result. An empty table gives an empty result.
A text is handled whole, with its lines in memory. Keys are told apart by 128 bits of XXH64. Frequent lines are counted within each task before they are shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.llm.common import sliced

BLANK = b" \t\n\x0b\x0c\r"
#: Documents that share a line until it goes.
LEAST = 10
#: Shards of the filters at first, and keys in a shard's filter until there are twice as many shards.
SHARDS, CROWDED = 16, 1 << 20
#: Slots of a bucket, moves until a filter grows, share of slots that are filled at most.
SLOTS, MOVES, FULL = 4, 500, 0.9
#: Bytes of filters and of keys listed with them that are sent to every task at most.
BROADCAST = 64 << 20
#: Bytes of a listed key in a task's memory.
LISTED = 128
#: The seed with which Spark hashes a string that follows the integer 1.
SECOND = xxhash.xxh64_intdigest(struct.pack("<i", 1), 42)
FILTER = "shard int, n long, slots binary"


def keys_of(text: bytes) -> list[bytes]:
    """Every line's key."""
    return [line.strip(BLANK).lower() for line in text.split(b"\n")]


def hashes(keys: list[bytes]) -> np.ndarray:
    """(key, 2) 64-bit hashes."""
    digest = xxhash.xxh64_intdigest
    return np.stack([np.fromiter((digest(k, seed) for k in keys), np.uint64, len(keys)) for seed in (42, SECOND)], axis=1)


def _shard(h1: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h1, 40), F.lit(shards)).cast("int")


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints in buckets of four; a key's two buckets differ by a hash of its fingerprint.

    Only keys that were added may be removed. It grows when it is full: ``add`` is then False, and a larger one has to be filled.
    """

    def __init__(self, keys: int, slots: bytes | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * FULL)))))
        self.table = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy() if slots else np.zeros((buckets, SLOTS), np.uint16)

    @staticmethod
    def _print(h2: np.ndarray) -> np.ndarray:
        return (h2 % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _jump(self, prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(8)) & np.uint64(len(self.table) - 1)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        prints = self._print(h[:, 1])
        first = h[:, 0] & np.uint64(len(self.table) - 1)
        return prints, first.astype(np.int64), (first ^ self._jump(prints)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(h)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def add(self, h: np.ndarray) -> bool:
        for f, a, b in zip(*self.places(h)):
            if not self._put(f, int(a)) and not self._put(f, int(b)) and not self._push(f, int(b)):
                return False
        return True

    def _put(self, f: np.uint16, at: int) -> bool:
        free = np.flatnonzero(self.table[at] == 0)
        if len(free):
            self.table[at, free[0]] = f
        return bool(len(free))

    def _push(self, f: np.uint16, at: int) -> bool:
        for move in range(MOVES):
            slot = move * 7 % SLOTS
            f, self.table[at, slot] = self.table[at, slot], f
            at ^= int(self._jump(np.array([f]))[0])
            if self._put(f, at):
                return True
        return False

    def remove(self, h: np.ndarray) -> None:
        for f, a, b in zip(*self.places(h)):
            at = a if (self.table[a] == f).any() else b
            self.table[at, np.flatnonzero(self.table[at] == f)[0]] = 0


def filled(h: np.ndarray) -> Cuckoo:
    """A filter of all keys, as large as it takes."""
    size = len(h)
    while not (out := Cuckoo(size)).add(h):
        size = max(2 * size, 64)
    return out


def counted(docs: DataFrame, least: int = 1) -> DataFrame:
    """h1, h2: a row for each document and distinct key of at least so many code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            parts = [{k for k in keys_of(t.encode()) if len(k) >= least and (least < 2 or len(k.decode()) >= least)} for t in batch.column(0).to_pylist() if t]
            h = hashes([k for p in parts for k in p]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1])], ["h1", "h2"])

    return docs.select("text").mapInArrow(run, "h1 long, h2 long")


class LineIndex:
    """The references and filters below a folder.

    threshold: documents that share a key until its lines go; least: code points of a key at least.
    """

    def __init__(self, spark: SparkSession, root: str, threshold: int = LEAST, least: int = 1, broadcast: int = BROADCAST):
        self.spark, self.root, self.threshold, self.least, self.broadcast = spark, root, threshold, least, broadcast

    def version(self) -> int:
        """The number of the newest whole state; 0 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [int(x.getPath().getName()[1:]) for x in fs.listStatus(path)] if fs.exists(path) else []
        whole = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{n}/filters/_SUCCESS"))]
        return max(whole, default=0)

    def references(self) -> DataFrame:
        """h1, h2, n, was: documents of each key now and in the state before; keys of which no document is left since then have n = 0."""
        n, ddl = self.version(), "h1 long, h2 long, n long, was long"
        return self.spark.read.schema(ddl).parquet(f"{self.root}/v{n}/references") if n else self.spark.createDataFrame([], ddl)

    def filters(self) -> DataFrame:
        n = self.version()
        return self.spark.read.schema(FILTER).parquet(f"{self.root}/v{n}/filters") if n else self.spark.createDataFrame([], FILTER)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Counts documents in."""
        return self._change(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Counts documents out that were inserted before."""
        return self._change(docs, -1)

    def _change(self, docs: DataFrame, sign: int) -> LineIndex:
        at = f"{self.root}/v{self.version() + 1}"
        old = self.references().filter("n > 0").select("h1", "h2", "n", F.lit(0).cast("long").alias("d"))
        new = counted(docs, self.least).groupBy("h1", "h2").agg((sign * F.count("*")).alias("d")).select("h1", "h2", F.lit(0).cast("long").alias("n"), "d")
        both = old.unionByName(new).groupBy("h1", "h2").agg(F.sum("n").alias("was"), F.sum("d").alias("d"))
        both = both.select("h1", "h2", (F.col("was") + F.col("d")).alias("n"), "was")
        both.write.mode("overwrite").parquet(f"{at}/references")
        saved = self.spark.read.parquet(f"{at}/references")
        if sign < 0 and not saved.filter("n < 0").isEmpty():
            raise ValueError("documents are deleted that were not inserted")
        hot = saved.filter(f"n >= {self.threshold} or was >= {self.threshold}")
        kept, before = hot.filter(f"n >= {self.threshold}").count(), self.filters()
        shards = before.agg(F.max("shard") + 1).first()[0] or 0
        wanted = max(shards, SHARDS)
        while kept > wanted * CROWDED:
            wanted *= 2
        threshold, fresh = self.threshold, wanted != shards

        def update(key: tuple, rows: pd.DataFrame, was: pd.DataFrame) -> pd.DataFrame:
            h, stays = rows[["h1", "h2"]].to_numpy(np.int64).view(np.uint64), (rows["n"] >= threshold).to_numpy()
            there = (rows["was"] >= threshold).to_numpy()
            f = None
            if not fresh and len(was):
                f = Cuckoo(0, was["slots"].iloc[0])
                f.remove(h[there & ~stays])
                f = f if f.add(h[stays & ~there]) else None
            f = f or filled(h[stays])
            return pd.DataFrame({"shard": [key[0]], "n": [int(stays.sum())], "slots": [f.table.tobytes()]})

        # every shard has a row, so that their number can be told from the table
        by = hot.withColumn("shard", _shard(F.col("h1"), wanted)).groupBy("shard")
        some = before.filter(F.lit(not fresh)).groupBy("shard").cogroup(by)
        made = some.applyInPandas(lambda key, was, rows: update(key, rows, was), FILTER)
        last = self.spark.range(wanted).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("n"), F.lit(Cuckoo(0).table.tobytes()).alias("slots"))
        made.unionByName(last).groupBy("shard").agg(F.max_by("n", F.struct("n", F.length("slots"))).alias("n"), F.max_by("slots", F.struct("n", F.length("slots"))).alias("slots")).write.mode("overwrite").parquet(f"{at}/filters")
        return self

    def clean(self, docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """columns, n_lines, n_dropped and kept (the lines that stay) of documents of the index."""
        filters = self.filters()
        size = filters.agg(F.sum(F.length("slots"))).first()[0] or 0
        if size <= self.broadcast:
            tables = {r["shard"]: r["slots"] for r in filters.collect()}
            wrong = self._taken(self.references().filter(f"n > 0 and n < {self.threshold}"), tables)
            if size + LISTED * wrong.count() <= self.broadcast:
                return self._scan(docs, columns, tables, [tuple(r) for r in wrong.collect()])
        return self._routed(docs, columns)

    @staticmethod
    def _probe(tables: dict[int, bytes], h: np.ndarray, opened: dict[int, Cuckoo]) -> np.ndarray:
        shard = (h[:, 0] >> np.uint64(40)).astype(np.int64) % max(1, len(tables))
        out = np.zeros(len(h), bool)
        for s in np.unique(shard):
            if s in tables:
                if s not in opened:
                    opened[s] = Cuckoo(0, tables[s])
                mine = np.flatnonzero(shard == s)
                out[mine] = opened[s].has(h[mine])
        return out

    def _taken(self, keys: DataFrame, tables: dict[int, bytes]) -> DataFrame:
        """The keys that the filters have."""
        given, probe = self.spark.sparkContext.broadcast(tables), self._probe

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened: dict[int, Cuckoo] = {}
            for b in batches:
                h = np.stack([c.to_numpy() for c in b.columns], axis=1).view(np.uint64)
                yield b.filter(pa.array(probe(given.value, h, opened)))

        return keys.select("h1", "h2").mapInArrow(run, "h1 long, h2 long")

    def _scan(self, docs: DataFrame, columns: tuple[str, ...], tables: dict[int, bytes], wrong: list[tuple[int, int]]) -> DataFrame:
        given, probe = self.spark.sparkContext.broadcast((tables, frozenset(wrong))), self._probe
        least, n = self.least, len(columns)
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_lines long, n_dropped long, kept string"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened: dict[int, Cuckoo] = {}
            tables, wrong = given.value
            for batch in sliced(batches):
                lines, keys = [], []
                for t in batch.column(n).to_pylist():
                    data = (t or "").encode()
                    lines.append(data.split(b"\n"))
                    keys.append(keys_of(data))
                distinct = list({k for ks in keys for k in ks if len(k) >= least and (least < 2 or len(k.decode()) >= least)})
                h = hashes(distinct)
                signed = h.view(np.int64)
                gone = {distinct[i] for i in np.flatnonzero(probe(tables, h, opened)) if (int(signed[i, 0]), int(signed[i, 1])) not in wrong}
                kept = [[x for x, k in zip(ls, ks) if k not in gone] for ls, ks in zip(lines, keys)]
                counts = [pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) - len(y) for x, y in zip(lines, kept)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *counts, pa.array([b"\n".join(x).decode() for x in kept], pa.string())], [*columns, "n_lines", "n_dropped", "kept"])

        return docs.select(*columns, "text").mapInArrow(run, schema)

    def _routed(self, docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        """The filters see the distinct keys of the documents, shard by shard; the keys that they have are joined to the table, and their lines to the texts."""
        spark, shards = self.spark, self.filters().count()
        text = F.coalesce("text", F.lit(""))
        key = lambda line: F.translate(F.trim(line, F.lit(BLANK.decode())), ascii_uppercase, ascii_lowercase)
        pair = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
        th = F.unhex(F.sha2(text, 256))
        lines = docs.select(th.alias("th"), F.explode(F.array_distinct(F.transform(F.split(text, "\n"), key))).alias("key")).filter(F.length("key") >= self.least)
        lines = lines.select("th", pair(F.col("key")).alias("k")).select("th", "k.*")

        def met(key: tuple, f: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            h = rows[["h1", "h2"]].to_numpy(np.int64)
            return rows[["h1", "h2"]][Cuckoo(0, f["slots"].iloc[0]).has(h.view(np.uint64))] if len(f) and len(rows) else rows[["h1", "h2"]][:0]

        distinct = lines.select("h1", "h2").distinct().withColumn("shard", _shard(F.col("h1"), max(1, shards)))
        passed = self.filters().groupBy("shard").cogroup(distinct.groupBy("shard")).applyInPandas(met, "h1 long, h2 long")
        gone = passed.join(self.references().filter(f"n >= {self.threshold}").select("h1", "h2"), ["h1", "h2"], "left_semi")
        by_text = lines.join(gone, ["h1", "h2"]).distinct().groupBy("th").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
        whole = docs.select(*columns, text.alias("_text"), th.alias("th")).join(by_text, "th", "left")
        split = F.split("_text", "\n")
        stay = F.filter(split, lambda x: F.col("gone").isNull() | (F.length(key(x)) < self.least) | ~F.array_contains("gone", pair(key(x))))
        return whole.select(*columns, F.size(split).cast("long").alias("n_lines"), stay.alias("stay")).select(*columns, "n_lines", (F.col("n_lines") - F.size("stay")).alias("n_dropped"), F.array_join("stay", "\n").alias("kept"))

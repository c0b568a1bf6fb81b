"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' ids. In every window of ``length`` ids a queue with weight p
is owed p * length ids on top of what it was owed before; it is served whole ids, and the rest stays its
deficit for the next window. Serving in the order in which the queues' deficits reach half an id keeps
every queue within a few ids of its due after every window and fills every window but the last. A
queue that runs out leaves its share to the others in proportion.

The deficits after w windows follow from w alone (``served``), so that each task enters the schedule
anywhere with the exact deficits that all earlier windows and partitions carry over, and
no state passes between tasks. A queue's documents are in the order of the partitions that hold them; only
counts per partition and source are summed across tasks, never rows.

Nulls, ties, repeats: a null text is empty and a null source is a queue of its own. Every document has the
end id, so none has length zero. Repeated rows are packed repeatedly. An empty table gives no piece. One
document may span any number of windows.
"""

from __future__ import annotations

import zlib
from collections import Counter, OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm.common import Scratch, release, sliced, trim
from pellucid.llm.encoding import binary_column, chunks, encoder

#: Windows whose schedule is computed at once, and bytes of such blocks that a task keeps (one block at least).
BLOCK, KEPT_BYTES = 256, 32 << 20
#: Queues at most. If there are more sources, they share queues by hash, in each of which they follow one another.
MAX_QUEUES = 1024


def served(windows: np.ndarray, sizes: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Ids served of each queue (columns) before each window (rows)."""
    goal = np.minimum(windows.astype(np.int64) * length, sizes.sum())
    rate = weights / weights.sum()

    def count(t: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(t[:, None] * rate + 0.5), sizes).astype(np.int64)

    lo, hi = np.zeros(len(goal)), np.full(len(goal), float((sizes / rate).max() + 1))
    hi = np.minimum(hi, np.maximum(goal / rate.min(), goal) + 1.0 / rate.min()) if len(sizes) else hi
    for _ in range(80):
        mid = (lo + hi) / 2
        over = count(mid).sum(1) > goal
        lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
        if np.all(hi - lo <= np.spacing(hi)):
            break
    out = count(lo)
    for i, left in enumerate(goal - out.sum(1)):  # ids due at the same moment: in the order of the queues
        while left > 0:
            open_ = np.flatnonzero(out[i] < sizes)
            first = open_[np.argsort((out[i][open_] + 0.5) / rate[open_], kind="stable")][:left]
            out[i][first] += 1
            left -= len(first)
    return out


class Schedule:
    """Blocks of windows of one packing, computed as they are needed."""

    def __init__(self, sizes: np.ndarray, weights: np.ndarray, length: int):
        self.sizes, self.weights, self.length = sizes, weights, length
        self.windows = -(-int(sizes.sum()) // length)
        self.blocks: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids served before each of the block's windows and the next, and each queue's offset in each window."""
        if b not in self.blocks:
            before = served(np.arange(b * BLOCK, (b + 1) * BLOCK + 1), self.sizes, self.weights, self.length)
            share = np.diff(before, axis=0)
            self.blocks[b] = before, np.cumsum(share, axis=1) - share
            while len(self.blocks) > 1 and len(self.blocks) * 2 * before.nbytes > KEPT_BYTES:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(b)
        return self.blocks[b]

    def window_of(self, q: int, position: int) -> int:
        """The window that has the queue's id at a position."""
        lo, hi = 0, max(1, -(-self.windows // BLOCK)) - 1
        b = min(hi, int(position / max(1, self.sizes[q]) * self.windows) // BLOCK) if np.array_equal(self.sizes, self.weights) else (lo + hi) // 2
        while True:
            before = self.block(b)[0][:, q]
            if position < before[0]:
                hi = b - 1
            elif position >= before[-1]:
                lo = b + 1
            else:
                return b * BLOCK + int(np.searchsorted(before, position, "right")) - 1
            b = min(max(b, lo), hi) if np.array_equal(self.sizes, self.weights) else (lo + hi) // 2

    def cut(self, q: int, position: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents of one queue that begin at these positions and have n ids each: document, start,
        length, window and offset."""
        end = position + n
        b0, b1 = self.window_of(q, int(position.min())) // BLOCK, self.window_of(q, int(end.max()) - 1) // BLOCK
        parts = [self.block(b) for b in range(b0, b1 + 1)]
        before = np.concatenate([*(p[0][:-1, q] for p in parts), parts[-1][0][-1:, q]])
        offset = np.concatenate([p[1][:, q] for p in parts])
        first, last = (np.searchsorted(before, x, "right") - 1 for x in (position, end - 1))
        count = last - first + 1
        doc = np.repeat(np.arange(len(n)), count)
        w = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start, stop = np.maximum(before[w], position[doc]), np.minimum(before[w + 1], end[doc])
        keep = stop > start
        doc, w, start, stop = doc[keep], w[keep], start[keep], stop[keep]
        return doc, start - position[doc], stop - start, b0 * BLOCK + w, offset[w] + start - before[w]


def _encode(vocabulary: str, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, total = TaskContext.get().partitionId(), encoder(vocabulary), Counter()
        for batch in sliced(batches, 2000):
            texts, sources = batch.column("text").to_pylist(), batch.column("source").to_pylist()
            for lo, hi in chunks(texts):
                ids, counts = enc.encode(texts[lo:hi], end)
                at = []
                for s, n in zip(sources[lo:hi], counts.tolist()):
                    at.append(total[s])
                    total[s] += n
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                    "source": pa.array(sources[lo:hi], pa.string()),
                    "part": pa.array(np.full(len(at), part, np.int32)),
                    "at": pa.array(at, pa.int64()),
                    "n": pa.array(counts),
                    "ids": binary_column(ids, counts),
                })
        trim()

    return run


def _cut(sizes: list[int], weights: list[float], length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # the encoder, which is of no more use
        plan = Schedule(np.array(sizes, np.int64), np.array(weights, np.float64), length)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                queue, position, n = (batch.column(c).to_numpy() for c in ("queue", "position", "n"))
                ids = batch.column("ids")
                wide = np.int64 if pa.types.is_large_binary(ids.type) else np.int32
                begin = np.frombuffer(ids.buffers()[1], wide)[ids.offset : ids.offset + len(ids)].astype(np.int64)
                data = memoryview(ids.buffers()[2])
                for q in np.unique(queue):
                    rows = np.flatnonzero(queue == q)
                    doc, start, size, w, offset = plan.cut(int(q), position[rows], n[rows])
                    doc = rows[doc]
                    at = begin[doc] + 4 * start
                    crc = [zlib.crc32(data[i:j]) for i, j in zip(at.tolist(), (at + 4 * size).tolist())]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, size, crc, n[doc], w, offset))], names=names)

    return run


def pack(docs: DataFrame, vocabulary: str, end: int, scratch: Scratch, length: int = 1024, weights: dict | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids.

    weights: target share of each source's ids; by default the source's share of all ids, at which all
    queues last to the end. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Every sequence but the last is full.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    ids = scratch.save(rows.mapInArrow(_encode(vocabulary, end), "doc_id long, source string, part int, at long, n long, ids binary"))
    sums = scratch.save(ids.groupBy("part", "source").agg(F.sum("n").alias("n")))
    many = sums.select("source").distinct().limit(MAX_QUEUES + 1).count() > MAX_QUEUES
    key = F.pmod(F.xxhash64("source"), F.lit(MAX_QUEUES)).cast("string") if many else F.col("source")
    before = Window.partitionBy("key").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.save(sums.withColumn("key", key).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    if weights is not None:
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "name string, weight double")
        share = sums.groupBy("key", "source").agg(F.sum("n").alias("n"))
        share = share.join(given, share["source"].eqNullSafe(given["name"]), "left").select("key", "n", F.coalesce("weight", F.lit(0.0)).alias("due"))
    else:
        share = sums.select("key", "n", F.col("n").cast("double").alias("due"))
    totals = share.groupBy("key").agg(F.sum("n").alias("n"), F.sum("due").alias("due")).orderBy(F.col("key").asc_nulls_last()).collect()  # MAX_QUEUES rows at most
    sizes, due = [r.n for r in totals], [max(r.due, 1e-9) for r in totals]
    queues = spark.createDataFrame([(r.key, q) for q, r in enumerate(totals)], "key string, queue int")
    bases = scratch.save(sums.join(queues, sums["key"].eqNullSafe(queues["key"])).select(F.col("part").alias("p"), F.col("source").alias("s"), "base", "queue"))
    # bases has a row for each partition and source: Spark broadcasts it only below its size threshold.
    placed = ids.join(bases, (ids["part"] == bases["p"]) & ids["source"].eqNullSafe(bases["s"]))
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("at")).alias("position"), "n", "ids")
    return placed.mapInArrow(_cut(sizes, due, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

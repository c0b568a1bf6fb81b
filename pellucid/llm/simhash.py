"""SimHash near-duplicates: 64-bit fingerprints, linked at few differing bits.

Distances to reference fingerprints alone do not narrow a search among 64-bit codes (they all lie near
32), so rows first meet on bit blocks: with ``bits`` differences, fingerprints cut into more blocks than
that agree on the rest, and every such choice of blocks is a join key. Every pair that meets is then put
through the pivot distance table: it is discarded if the distances to any reference fingerprint differ by more than
the limit, and survivors are verified bit by bit.

Equal fingerprints are one node. Large groups of near copies never form all their pairs: for some rounds each
row is only compared with one centre of each block, components are contracted, and blocks within one
component are done. Only rows of different components that still share a block are compared pairwise, so
that no link is lost. A block with more than CROWD rows is first split, as often as LEVELS, by the bits that needn't agree, in
``bits + 1`` groups of which rows that are linked agree on one at least. Tables of rows, fingerprints and keys grow with the input and are joined by shuffle: stored, they seem small
enough to broadcast long after the driver's memory can't hold them.

Nulls, ties, repeats: a null text has no word; texts without words have fingerprint zero and are linked like
any others. Documents without id keep their row; a component's id is its least id, null if none has one.
Repeated rows stay rows. An empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm.common import Scratch, release, sliced, trim
from pellucid.llm.graph import components

SEED, WORDS, BITS = 42, 4, 4
#: Bit blocks; those beyond BITS must agree. More blocks give longer keys, and more of them: 6 suit up to
#: about 10**9 different fingerprints, 7 or 8 more. Any number gives the same links.
BLOCKS = 6
#: Reference fingerprints, and rounds of comparing with centres.
PIVOTS, ROUNDS = 16, 3
#: Rows that share a key without being split further, and times that a key is split at most.
CROWD, LEVELS = 64, 3
SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined, k = b" ".join(words), min(WORDS, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, len(starts), SLICE):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[lo : lo + SLICE], ends[lo : lo + SLICE])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in sliced(batches):
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])
    trim()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text, which tells rows of one id apart) and fp (the fingerprint as a signed long)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_table(fp: Column) -> list[Column]:
    """Distances to the reference fingerprints, eight to a long."""
    out = []
    for base in range(0, PIVOTS, 8):
        row = F.lit(0).cast("long")
        for j in range(8):
            pivot = F.lit(_signed(xxhash.xxh64_intdigest(f"pivot {base + j}"))).cast("long")
            row = row.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(pivot)).cast("long"), 8 * j))
        out.append(row.alias(f"d{base // 8}"))
    return out


def _apart(a: str, b: str, bits: int) -> Column:
    """The pivot table's test of two aliased tables' rows: no coordinate differs by more than the bits."""
    tests = []
    for c in range(PIVOTS // 8):
        for j in range(8):
            x, y = (F.shiftright(F.col(f"{t}.d{c}"), 8 * j).bitwiseAND(F.lit(127)) for t in (a, b))
            tests.append(F.abs(x - y) <= bits)
    return reduce(operator.and_, tests)


def _near(a: str, b: str, bits: int) -> Column:
    """The pivot table's test, which discards most pairs that merely share a block, then the exact one."""
    return _apart(a, b, bits) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= bits)


def _choices(bits: int, blocks: int) -> list[int]:
    """The bits of every choice of blocks that may agree."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen) for chosen in combinations(range(blocks), blocks - bits)]


def _keyed(nodes: DataFrame, bits: int, blocks: int) -> DataFrame:
    """A row for each node and choice of blocks that may agree."""
    keys = F.array(*[F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for n, m in enumerate(_choices(bits, blocks))])
    return nodes.select("fp", "lab", *pivot_table(F.col("fp")), F.posexplode(keys).alias("choice", "key"))


def _split(rows: DataFrame, bits: int, blocks: int, level: int) -> DataFrame:
    """Rows of crowded keys under finer ones: the bits that needn't agree are dealt to ``bits + 1`` groups, of which linked rows
    agree on one at least; each level deals them in another way."""
    size = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select(F.col("key").alias("crowded"))
    masks = []
    for chosen in _choices(bits, blocks):
        rest = [i for i in range(64) if not chosen >> i & 1]
        group = (lambda i: i * (bits + 1) // len(rest), lambda i: i % (bits + 1), lambda i: (i // (bits + 1) + i) % (bits + 1))[level]
        masks.append([_signed(sum(1 << b for i, b in enumerate(rest) if group(i) == g)) for g in range(bits + 1)])
    of = F.element_at(F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in masks]), F.col("choice") + 1)
    finer = F.transform(of, lambda m: F.xxhash64("key", F.lit(level), m, F.col("fp").bitwiseAND(m)))
    both = rows.join(size.hint("merge"), rows["key"] == size["crowded"], "left")
    return both.withColumn("key", F.explode(F.when(F.col("crowded").isNull(), F.array("key")).otherwise(finer))).drop("crowded")


def clusters(nodes: DataFrame, scratch: Scratch, bits: int = BITS, blocks: int = BLOCKS, rounds: int = ROUNDS) -> DataFrame:
    """nodes: distinct fp. Returns fp and lab: the least fingerprint that is reachable, for those that have a link."""
    if blocks <= bits:
        raise ValueError("blocks must outnumber bits")
    found = None

    def labelled() -> DataFrame:
        if found is None:
            return nodes.select("fp", F.col("fp").alias("lab"))
        old = found.select(F.col("fp").alias("f"), F.col("lab").alias("l"))
        return nodes.join(old.hint("merge"), nodes["fp"] == old["f"], "left").select("fp", F.coalesce("l", "fp").alias("lab"))

    def merge(edges: DataFrame) -> DataFrame:
        roots = components(edges, scratch)
        if found is None:
            return scratch.save(roots.select(F.col("node").alias("fp"), F.col("root").alias("lab")))
        old = labelled()
        return scratch.save(old.join(roots.hint("merge"), old["lab"] == roots["node"], "left").select("fp", F.coalesce("root", "lab").alias("lab")))

    for r in range(rounds + 1):
        keyed = _keyed(labelled(), bits, blocks)
        mixed = keyed.groupBy("key").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.min(F.struct(F.xxhash64(F.lit(r), "fp").alias("o"), "fp", "lab", "d0", "d1")).alias("c")).filter("lo <> hi")
        if r < rounds:
            row, other, apart = keyed, mixed.select("key", "c.fp", "c.lab", "c.d0", "c.d1"), F.col("row.lab") != F.col("other.lab")
        else:
            rows = scratch.save(keyed.join(mixed.select("key").hint("merge"), "key", "left_semi"))
            for level in range(LEVELS):
                if rows.groupBy("key").count().filter(F.col("count") > CROWD).isEmpty():
                    break
                rows = scratch.save(_split(rows, bits, blocks, level))
            row = other = rows
            apart = F.col("row.lab") < F.col("other.lab")
        pair = row.alias("row").join(other.alias("other").hint("merge"), (F.col("row.key") == F.col("other.key")) & apart & _near("row", "other", bits))
        found = merge(pair.select(F.col("row.lab").alias("a"), F.col("other.lab").alias("b")))
    return found


def near_duplicates(docs: DataFrame, scratch: Scratch, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, th, fp and component_id (the least doc_id reachable) of every row."""
    rows = scratch.save(fingerprints(docs))
    nodes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = clusters(nodes.select("fp"), scratch, bits, blocks)
    of = labels.select(F.col("fp").alias("f"), "lab")
    members = nodes.join(of.hint("merge"), nodes["fp"] == of["f"], "left").select("fp", "least", F.coalesce("lab", "fp").alias("lab"))
    ids = scratch.save(members.groupBy("lab").agg(F.min("least").alias("component_id")))
    named = members.join(ids.withColumnRenamed("lab", "l").hint("merge"), members["lab"] == F.col("l"))
    named = scratch.save(named.select(F.col("fp").alias("f"), "component_id"))
    return rows.join(named.hint("merge"), rows["fp"] == named["f"]).select("doc_id", "th", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The row with the least id of every group of near duplicates, with all its columns; one of repeated rows."""
    groups = near_duplicates(docs, scratch)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "fp")).alias("first")
    hashed = groups.withColumn("group", F.coalesce("component_id", "fp")).withColumn("no_id", F.col("component_id").isNull())
    kept = scratch.save(hashed.groupBy("no_id", "group").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.th").alias("kept_th")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_th"))
    rows = rows.join(kept.hint("merge"), rows["row_id"].eqNullSafe(kept["kept_id"]) & (rows["row_th"] == kept["kept_th"]), "left_semi")
    one = Window.partitionBy("row_id", "row_th").orderBy("row_th")
    return rows.withColumn("n", F.row_number().over(one)).filter("n = 1").select("row.*")

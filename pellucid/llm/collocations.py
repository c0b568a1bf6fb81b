"""Collocations: frequent phrases by compressed position bitmaps, scored by their weakest cut.

The words of each language are laid out on shards of 65,536 positions, with an empty position between pieces. A word's
bitmap in a shard is compressed: a sorted list of 16-bit positions, or a bit for each position where the word has more than 4,096. Phrases
grow as in SPAM: the bitmap of a phrase's ends, shifted by one place, and the next word's bitmap give the longer phrase's ends by
AND, and its occurrences by popcount; the empty positions stop a phrase at its piece's end. Depth first, a shard keeps one bitmap for
each word of the phrase at hand. A table of neighbours that are frequent over all shards (the co-occurrence map of CM-SPAM) says which words may follow which.
Popcounts are summed over shards. At work, a bitmap is a set of positions up to 4,096 of them, and bits beyond. Frequent words and neighbours are sent to every task
while they are at most a million words and eight million neighbours, and joined to the shards otherwise.

A shard goes on where the last one of its task ended: it begins with that one's last four positions, which count only as the beginnings of phrases.

Nulls, ties, repeats: a null text is empty, a null language is ``und``, ids play no part, repeated rows count repeatedly. Ties of scores go by
count, then by the phrase's bytes. An empty table gives an empty result. Texts of any length are cut into slices between words. A language
with any share of the rows is many shards; rows of a word's or phrase's counts are summed within tasks before they are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm.common import Scratch, free_shuffles

#: Positions of a shard and those at which a list becomes a row of bits; words of a phrase at most.
PLACES, DENSE, LONGEST = 1 << 16, 4096, 5
#: Neighbours that are merged within a task.
TOGETHER = 1 << 21
#: Buckets of neighbours at least; beyond, one for fifty shards, which have a million neighbours or so.
BUCKETS = 64
#: Phrases whose counts a task holds before it sends them.
PHRASES = 1_000_000
#: Occurrences of a candidate at least; percentage of its occurrences that a longer one needs to replace it; rows of a language's result.
LEAST, SHARE, TOP = 100, 100, 2000
#: Bytes of text that are cut into words at once; words that wait for their languages' shards to fill.
SLICE, WAITING = 1 << 18, 1 << 21
#: Frequent words that are sent to every task at most, each some 150 bytes there, and frequent neighbours, of 8 bytes each.
BROADCAST, BROADCAST_PAIRS = 1_000_000, 8_000_000
#: Shards of a stored file: a reader's columns, and a writer's, hold a file's rows at once, of some 400 KB each.
ROWS = 64
#: Ranges in which a language's candidates are ranked before they meet.
RANGES = 64

_END = b"\xff"  # no byte of UTF-8
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _END * 10 + b" ")
_SHARD = "lang string, shard long, first int, words array<string>, counts array<long>, cards array<int>, maps binary"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in slices, with _END between pieces."""
    at = 0
    while at < len(text):
        to = min(len(text), at + SLICE)
        if to < len(text):  # back to a blank, or on to the next one
            cut = max(text.rfind(b, at, to) for b in (b" ", b"\n", b".", b","))
            while cut < 0 and to < len(text) and text[to] not in b" \n.,":
                to += 1
            to = cut + 1 if cut >= 0 else to
        yield text[at:to].lower().translate(_MARKS).replace(_END, b" \xff ").split()
        at = to


def bitmap(places: np.ndarray) -> bytes:
    """A sorted list of positions, compressed."""
    if len(places) <= DENSE:
        return places.astype("<u2").tobytes()
    return np.packbits(np.bincount(places, minlength=PLACES).astype(bool), bitorder="little").tobytes()


def size_of(cards: np.ndarray) -> np.ndarray:
    """Bytes of bitmaps of so many positions."""
    return np.where(cards <= DENSE, 2 * cards, PLACES // 8)


def places(data: memoryview, cards: np.ndarray) -> np.ndarray:
    """The positions of all bitmaps, one after the other."""
    if (cards <= DENSE).all():
        return np.frombuffer(data, "<u2").astype(np.int64)
    ends = np.cumsum(size_of(cards))
    one = lambda i: data[ends[i] - size_of(cards[i]) : ends[i]]
    return np.concatenate([np.frombuffer(one(i), "<u2").astype(np.int64) if c <= DENSE else np.flatnonzero(np.unpackbits(np.frombuffer(one(i), np.uint8), bitorder="little")) for i, c in enumerate(cards)])


def bits_of(at: np.ndarray) -> np.ndarray:
    """Positions as 1,024 words of 64 bits."""
    return np.packbits(np.bincount(at, minlength=PLACES).astype(bool), bitorder="little").view(np.uint64)


class Bitmap:
    """A word's bitmap as a shard works on it: its positions as a list and a set, and as bits once a phrase with many ends meets it."""

    def __init__(self, at: np.ndarray):
        self.at, self.sparse, self._bits = at, set(at.tolist()), None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = bits_of(self.at)
        return self._bits


def shifted(ends: set | np.ndarray) -> set | np.ndarray:
    """The places after a phrase's ends; few ends are a set, many are bits."""
    if isinstance(ends, set):
        return {e + 1 for e in ends}
    moved = ends << np.uint64(1)
    moved[1:] |= ends[:-1] >> np.uint64(63)
    return moved


def both(moved: set | np.ndarray, word: Bitmap) -> set | np.ndarray:
    """Those of the places that a word has."""
    if isinstance(moved, set):
        return moved & word.sparse
    if len(word.at) <= DENSE:
        return set(word.at[(moved[word.at >> 6] >> (word.at & 63).astype(np.uint64)) & np.uint64(1) == 1].tolist())
    common = moved & word.bits
    if np.bitwise_count(common).sum() > DENSE:
        return common
    return set(np.flatnonzero(np.unpackbits(common.view(np.uint8), bitorder="little")).tolist())


def popcount(m: set | np.ndarray, first: int) -> int:
    """Positions from ``first`` on."""
    if isinstance(m, set):
        return len(m) - sum(e in m for e in range(first)) if first else len(m)
    return int(np.bitwise_count(m).sum()) - (int(m[0]) & ((1 << first) - 1)).bit_count()


class _Layout:
    """Lays words out on shards, language by language."""

    def __init__(self, task: int):
        self.task, self.made = task, 0
        self.waiting: dict[str, list] = {}
        self.first: dict[str, int] = {}
        self.words = 0

    def add(self, lang: str, words: list[bytes]) -> Iterator[tuple]:
        buffer = self.waiting.setdefault(lang, [])
        buffer += words
        self.words += len(words)
        while len(buffer) >= PLACES:
            yield self._shard(lang, buffer[:PLACES])
            del buffer[: PLACES - (LONGEST - 1)]
            self.words -= PLACES - (LONGEST - 1)
            self.first[lang] = LONGEST - 1
        if self.words > WAITING:
            yield from self.rest()

    def rest(self) -> Iterator[tuple]:
        for lang, buffer in self.waiting.items():
            if len(buffer) > self.first.get(lang, 0):
                yield self._shard(lang, buffer)
        self.waiting, self.first, self.words = {}, {}, 0

    def _shard(self, lang: str, words: list[bytes]) -> tuple:
        first, self.made = self.first.get(lang, 0), self.made + 1
        coded = pa.array(words, pa.binary()).dictionary_encode()
        ids, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        order = np.argsort(ids, kind="stable")
        cards = np.bincount(ids, minlength=len(known))
        counts = np.bincount(ids[first:], minlength=len(known))
        ends = np.cumsum(cards)
        keep = [i for i, w in enumerate(known) if w != _END]
        maps = b"".join(bitmap(order[ends[i] - cards[i] : ends[i]]) for i in keep)
        return lang, self.task << 32 | self.made, first, [known[i].decode() for i in keep], counts[keep], cards[keep], maps


def shards(docs: DataFrame) -> DataFrame:
    """A row for each shard: its words, how often each is there without the overlap, and their bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = _Layout(TaskContext.get().partitionId())
        schema = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("first", pa.int32()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("cards", pa.list_(pa.int32())), ("maps", pa.binary())])

        def batch(row: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                data, lang = (text.as_py() or "").encode(), lang.as_py() or "und"
                for words in words_of(data):
                    for row in layout.add(lang, words):
                        yield batch(row)
                if data:
                    for row in layout.add(lang, [_END]):
                        yield batch(row)
        for row in layout.rest():
            yield batch(row)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, _SHARD)


def _few(df: DataFrame, most: int | None = None) -> bool:
    """Whether a stored table may be sent to every task."""
    most = BROADCAST if most is None else most
    return df.limit(most + 1).count() <= most


def _map_rows(df: DataFrame, make: Callable[[Iterator[dict]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """make gets the rows of a task as scalars by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return make({name: b.column(k)[i] for k, name in enumerate(b.schema.names)} for b in batches for i in range(b.num_rows))

    return df.mapInArrow(run, ddl)


_KEPT = "lang string, shard long, first int, words array<string>, ids array<long>, cards array<int>, maps binary"


def _cut_down(row: dict, ids: np.ndarray) -> pa.RecordBatch:
    """A shard with those words only that have an id (not -1)."""
    cards = row["cards"].values.to_numpy()
    keep = np.flatnonzero(ids >= 0)
    data = np.frombuffer(row["maps"].as_buffer(), np.uint8)[np.repeat(ids >= 0, size_of(cards))]
    one = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(keep)], pa.int32()), a.cast(t))
    return pa.RecordBatch.from_arrays(
        [pa.array([row[c].as_py()], t) for c, t in (("lang", pa.string()), ("shard", pa.int64()), ("first", pa.int32()))]
        + [one(row["words"].values.take(pa.array(keep)), pa.string()), one(pa.array(ids[keep]), pa.int64()), one(pa.array(cards[keep]), pa.int32()), pa.array([data.tobytes()], pa.binary())],
        [f.split()[0] for f in _KEPT.split(", ")],
    )


def _with_known(laid: DataFrame, known: DataFrame) -> DataFrame:
    """Shards with their frequent words only, and those words' ids."""
    if _few(known):
        table = known.toPandas()
        given = laid.sparkSession.sparkContext.broadcast({lang: dict(zip(g["word"], g["word_id"])) for lang, g in table.groupby("lang")})

        def look_up(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                ids = given.value.get(r["lang"].as_py(), {})
                yield _cut_down(r, np.array([ids.get(w, -1) for w in r["words"].values.to_numpy(zero_copy_only=False).tolist()], np.int64))

        return _map_rows(laid, look_up, _KEPT)

    def placed(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            ids = np.full(len(r["words"]), -1, np.int64)
            ids[r["known"].values.field("at").to_numpy()] = r["known"].values.field("word_id").to_numpy()
            yield _cut_down(r, ids)

    local = laid.select("lang", "shard", F.posexplode("words").alias("at", "word")).join(known.select("lang", "word", "word_id"), ["lang", "word"])
    lists = local.groupBy("shard").agg(F.collect_list(F.struct("at", "word_id")).alias("known"))  # of one shard's words
    return _map_rows(laid.join(lists, "shard").select("lang", "shard", "first", "words", "cards", "maps", "known"), placed, _KEPT)


def _laid_out(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's ids and cards, and the word at each place (-1: none)."""
    ids, cards = row["ids"].values.to_numpy(), row["cards"].values.to_numpy()
    owner = np.full(PLACES + 1, -1, np.int64)
    if len(ids):
        owner[places(memoryview(row["maps"].as_buffer()), cards)] = np.repeat(np.arange(len(ids)), cards)
    return ids, cards, owner


def _neighbours(owner: np.ndarray, words: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct neighbours with their counts, without those whose second word is in the overlap."""
    a, b = owner[:-2], owner[1:-1]
    met = (a >= 0) & (b >= 0)
    met[: max(0, first - 1)] = False
    codes, n = np.unique(a[met] * words + b[met], return_counts=True)
    return codes // max(1, words), codes % max(1, words), n


def _pairs(rows: Iterator[dict], overlap: bool = False) -> Iterator[pa.RecordBatch]:
    """overlap: with those in the overlap, with which phrases begin that end behind it."""
    for row in rows:
        ids, _, owner = _laid_out(row)
        a, b, n = _neighbours(owner, len(ids), 0 if overlap else row["first"].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row["shard"].as_py())), pa.array(ids[a]), pa.array(ids[b]), pa.array(n)], ["shard", "a", "b", "n"])


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their counts."""
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[starts], np.add.reduceat(n, starts) if len(code) else n


def _frequent_pairs(kept: DataFrame, words: int, buckets: int, least: int) -> DataFrame:
    """a, b of the frequent neighbours, for dense ids below ``words``.

    Tasks sum their shards' neighbours and send them as compressed runs of sorted codes, one for each bucket, which take a third of
    rows' bytes; a bucket's runs are merged.
    """

    def local(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            code, n = _summed(codes, counts)
            codes.clear()
            counts.clear()
            of = code % buckets
            order = np.argsort(of, kind="stable")
            code, n, found = code[order], n[order], np.unique(of)
            cuts = np.searchsorted(of[order], found[1:])
            pack = zstandard.ZstdCompressor(level=3).compress
            runs = [(pack(np.diff(c, prepend=0).astype("<u8").tobytes()), pack(k.astype("<u4").tobytes())) for c, k in zip(np.split(code, cuts), np.split(n, cuts))] if len(code) else []
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([c for c, _ in runs], pa.binary()), pa.array([k for _, k in runs], pa.binary())], ["bucket", "codes", "counts"])

        for row in rows:
            ids, _, owner = _laid_out(row)
            a, b, n = _neighbours(owner, len(ids), row["first"].as_py())
            codes.append(ids[a] * words + ids[b])
            counts.append(n)
            if sum(map(len, codes)) > TOGETHER:
                yield flush()
        if codes:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        code, n = _summed([np.cumsum(np.frombuffer(unpack(c), "<u8").astype(np.int64)) for c in pdf["codes"]], [np.frombuffer(unpack(k), "<u4").astype(np.int64) for k in pdf["counts"]])
        code = code[n >= least]
        return pd.DataFrame({"a": code // words, "b": code % words})

    runs = _map_rows(kept.select("shard", "first", "ids", "cards", "maps"), local, "bucket long, codes binary, counts binary")
    return runs.groupBy("bucket").applyInPandas(merge, "a long, b long")


def _grown(row: dict, after: dict[int, set[int]], ids: np.ndarray, cards: np.ndarray, owner: np.ndarray, total: dict[str, int]) -> None:
    """Adds to total the counts of all phrases of a shard whose neighbours are frequent; after: the words that may follow a word."""
    words, first = row["words"].values.to_numpy(zero_copy_only=False).tolist(), row["first"].as_py()
    needed = set(after).union(*after.values()) if after else set()
    ends, at = np.cumsum(cards), places(memoryview(row["maps"].as_buffer()), cards) if len(ids) else None
    maps = {w: Bitmap(at[ends[w] - cards[w] : ends[w]]) for w in needed}
    stands = owner.tolist()

    def grow(name: str, size: int, last: int, ends: set | np.ndarray) -> None:
        may = after.get(last)
        if not may:
            return
        moved = shifted(ends)
        if isinstance(moved, set):  # of the words that may follow, those that stand at one of the next places
            may = may & {stands[e] for e in moved}
        for w in may:
            longer = both(moved, maps[w])
            if len(longer):
                phrase = f"{name} {words[w]}"
                if n := popcount(longer, first):
                    total[phrase] = total.get(phrase, 0) + n
                if size + 1 < LONGEST:
                    grow(phrase, size + 1, w, longer)

    for w in after:
        grow(words[w], 1, w, maps[w].sparse if len(maps[w].at) <= DENSE else maps[w].bits)


def _phrases(kept: DataFrame, near: DataFrame | None, mine: DataFrame | None, buckets: int, least: int) -> DataFrame:
    """lang, phrase, size, f of frequent phrases; the frequent neighbours come as one table for all tasks, or as a list for each shard.

    Tasks sum popcounts over their shards and send them as compressed runs of sorted phrases, one for each bucket, as they send neighbours.
    """
    columns = ["lang", "shard", "first", "words", "ids", "cards", "maps"]
    whole = near is not None
    if whole:
        codes = near.select((F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("code")).toPandas()["code"].to_numpy(np.int64)
        given = kept.sparkSession.sparkContext.broadcast(np.sort(codes))

    def runs(lang: str, total: dict[str, int]) -> pa.RecordBatch:
        pack, parts = zstandard.ZstdCompressor(level=3).compress, {}
        for phrase in sorted(total):
            parts.setdefault(zlib.crc32(phrase.encode()) % buckets, []).append(phrase)
        made = [(pack("\n".join(p).encode()), pack(np.array([total[x] for x in p], "<u4").tobytes())) for p in parts.values()]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(parts), pa.string()), pa.array(list(parts), pa.int64()), pa.array([c for c, _ in made], pa.binary()), pa.array([n for _, n in made], pa.binary())], ["lang", "bucket", "phrases", "counts"])

    def make(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, dict[str, int]] = {}
        for row in rows:
            ids, cards, owner = _laid_out(row)
            if whole:
                a, b, _ = _neighbours(owner, len(ids), 0)
                code, all_ = ids[a] << 32 | ids[b], given.value
                there = all_[np.minimum(np.searchsorted(all_, code), len(all_) - 1)] == code if len(all_) else np.zeros(len(code), bool)
                a, b = a[there], b[there]
            else:
                order, pairs = np.argsort(ids), row["pairs"].values
                a, b = (order[np.searchsorted(ids[order], pairs.field(c).to_numpy())] for c in ("a", "b"))
            after: dict[int, set[int]] = {}
            for x, y in zip(a.tolist(), b.tolist()):
                after.setdefault(x, set()).add(y)
            _grown(row, after, ids, cards, owner, totals.setdefault(row["lang"].as_py(), {}))
            if sum(map(len, totals.values())) > PHRASES:
                yield from (runs(*t) for t in totals.items())
                totals = {}
        yield from (runs(*t) for t in totals.items())

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        names = [pc.split_pattern(pa.array([unpack(x)], pa.large_binary()).cast(pa.large_string()), "\n").flatten() for x in pdf["phrases"]]
        counts = [pa.array(np.frombuffer(unpack(x), "<u4").astype(np.int64)) for x in pdf["counts"]]
        total = pa.table([pa.chunked_array(names), pa.chunked_array(counts)], ["phrase", "n"]).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
        total = total.filter(pc.field("n_sum") >= least)
        found = total["phrase"].to_pylist()
        rows = zip([pdf["lang"].iloc[0]] * len(found), found, [p.count(" ") + 1 for p in found], total["n_sum"].to_pylist())
        return pd.DataFrame(list(rows), columns=["lang", "phrase", "size", "f"], dtype=object)

    sent = _map_rows(kept.select(*columns) if whole else kept.join(mine, "shard").select(*columns, "pairs"), make, "lang string, bucket long, phrases binary, counts binary")
    return sent.groupBy("lang", "bucket").applyInPandas(merge, "lang string, phrase string, size int, f long")


def frequent(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to LONGEST words with f >= least; (lang, total) words of each language."""
    laid = scratch.save(shards(docs), rows=ROWS)
    single = laid.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    counted = scratch.save(single)
    totals = scratch.save(counted.groupBy("lang").agg(F.sum("f").alias("total")))
    known = scratch.save(_numbered(counted.filter(f"f >= {least}")))
    scratch.drop(counted)
    free_shuffles(laid.sparkSession)
    kept = scratch.save(_with_known(laid, known), rows=ROWS)
    scratch.drop(laid)
    small, buckets = _few(known), max(BUCKETS, kept.count() // 50)
    if small:
        counts = _frequent_pairs(kept, max(1, known.count()), buckets, least)
    else:
        counts = _map_rows(kept.select("shard", "first", "ids", "cards", "maps"), _pairs, "shard long, a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).filter(f"n >= {least}").select("a", "b")
    near = scratch.save(counts)
    free_shuffles(laid.sparkSession)
    if small and _few(near, BROADCAST_PAIRS):
        longer = _phrases(kept, near, None, buckets, least)
    else:
        local = _map_rows(kept.select("shard", "first", "ids", "cards", "maps"), partial(_pairs, overlap=True), "shard long, a long, b long, n long")
        longer = _phrases(kept, None, local.join(near, ["a", "b"], "left_semi").groupBy("shard").agg(F.collect_list(F.struct("a", "b")).alias("pairs")), buckets, least)
    out = scratch.save(known.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f").unionByName(longer))
    scratch.drop(kept)
    return out, totals


def _numbered(words: DataFrame) -> DataFrame:
    """Adds word_id: unlike numbers, and small ones where there are few words; to be stored, so that they stay."""
    few = words.limit(BROADCAST + 1).count() <= BROADCAST
    return words.coalesce(1).withColumn("word_id", F.monotonically_increasing_id()) if few else words.withColumn("word_id", F.monotonically_increasing_id())


def _joined(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, scratch: Scratch, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by their lowest-scoring cut.

    Scores are whole numbers of a decimal division, exact for languages of up to 10^16 words.
    """
    f, totals = frequent(docs, scratch, least)
    words = F.split("phrase", " ", -1)
    found = f.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _joined(words, i, n))))
    covered = found.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = found.join(covered, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {share} * a").drop("longer")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), _joined(words, 1, k).alias("head"), _joined(words, k + 1, F.col("size") - k).alias("rest")))
    cut = alone.select("lang", "phrase", "a", F.inline(cuts))
    cut = cut.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals.withColumnRenamed("total", "n"), "lang")
    score = F.expr("cast(1000 * cast(a as decimal(16, 0)) as decimal(19, 0)) * cast(n as decimal(18, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANGES))
    first = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

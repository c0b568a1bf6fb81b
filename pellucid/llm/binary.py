"""Token-id files: one independent zstandard frame per document and a trailing seek table.

File layout (the public seekable zstandard format): document frames; a skippable frame with the
document index (doc_id, or 0 without one, first frame, and whether there is a doc_id, of each document, as little-endian int64, itself
zstandard-compressed); a skippable frame with the seek table, whose entries are compressed size,
decompressed size and the low 32 bits of the frame's XXH64, and whose footer is the frame count, a
descriptor byte and the magic number. A reader fetches the tail, then only the frames that it wants.

Files are written under names of their own and count only once the manifest, a table that Spark
commits, lists them; a retried or speculative task leaves at most an unlisted file.

Nulls, ties, repeats: a null text is an empty one; every document has its end id, so none has length
zero. Rows are in ascending doc_id order, rows without id first, equal ids by text hash; repeated rows are
written repeatedly. An empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm.common import Scratch, row_salt, sliced
from pellucid.llm.encoding import chunks, encoder, little_endian

#: Fixed values of the seekable format: magic numbers of the skippable frames and of the footer.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUM_FLAG = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Decompressed bytes of a frame at most; longer documents take several frames.
FRAME_BYTES = 1 << 28
#: Bytes of frames after which a task begins another file, and documents of a result batch.
ROLL, ROWS = 1 << 30, 10_000


class FrameWriter:
    """Writes documents' bytes to a stream as frames, then the index and the seek table."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.codec = sink, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries, self.docs = bytearray(), []
        self.frames = self.written = 0

    def add(self, doc_id: int | None, data: bytes | memoryview) -> None:
        """Documents come in ascending order of their ids, those without one first."""
        self.docs.append((doc_id or 0, self.frames, doc_id is not None))
        for at in range(0, max(1, len(data)), FRAME_BYTES):
            part = data[at : at + FRAME_BYTES]
            packed = self.codec.compress(part)
            self.sink.write(packed)
            self.entries += struct.pack("<III", len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF)
            self.frames += 1
            self.written += len(packed)

    def close(self) -> None:
        index = self.codec.compress(np.array(self.docs, "<i8").tobytes())
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        footer = struct.pack("<IBI", self.frames, CHECKSUM_FLAG, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(self.entries) + len(footer)) + bytes(self.entries) + footer)


class FrameReader:
    """Random access to the documents of one file; decompresses only the frames asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        table = self._at(size - 9 - 12 * frames - 8, 8 + 12 * frames)
        if struct.unpack("<II", table[:8]) != (SEEK_MAGIC, 12 * frames + 9):
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(table, "<u4", offset=8).reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        magic, length = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index")
        self.codec = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.codec.decompress(self._at(int(self.starts[-1]) + 8, length)), "<i8").reshape(-1, 3)
        self.first = np.append(self.docs[:, 1], frames)

    def _at(self, begin: int, n: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(n)

    def document(self, k: int) -> bytes:
        """The bytes of the k-th document, checked against the frames' checksums."""
        parts = []
        for f in range(self.first[k], self.first[k + 1]):
            part = self.codec.decompress(self._at(int(self.starts[f]), int(self.table[f, 0])))
            if len(part) != self.table[f, 1] or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.table[f, 2]:
                raise ValueError(f"frame {f} is damaged")
            parts.append(part)
        return b"".join(parts)

    def find(self, doc_id: int) -> list[bytes]:
        """Every document with that id."""
        lone = len(self.docs) - int(self.docs[:, 2].sum())  # they come first
        lo, hi = (lone + np.searchsorted(self.docs[lone:, 0], doc_id, side) for side in ("left", "right"))
        return [self.document(k) for k in range(lo, hi)]


def open_folder(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def _write(uri: str, vocabulary: str, end: int, roll: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, writer = TaskContext.get().partitionId(), encoder(vocabulary), None
        store, path = open_folder(uri)
        name, piece, tokens = "", 0, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            writer.sink.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "file": [name], "docs": pa.array([len(writer.docs)], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

        for batch in sliced(batches, 2000):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for lo, hi in chunks(texts):
                if writer is not None and writer.written >= roll:
                    yield closed()
                    writer, piece = None, piece + 1
                if writer is None:
                    store.create_dir(path, recursive=True)
                    name, tokens = f"{part:06d}-{piece:06d}-{uuid.uuid4().hex}.ids.zst", 0
                    writer = FrameWriter(store.open_output_stream(f"{path}/{name}", compression=None))
                flat, counts = enc.encode(texts[lo:hi], end)
                data, at = memoryview(little_endian(flat)), 0
                for doc_id, n in zip(ids[lo:hi], counts.tolist()):
                    writer.add(doc_id, data[4 * at : 4 * (at + n)])
                    at += n
                tokens += at
        if writer is not None:
            yield closed()

    return run


def write_ids(docs: DataFrame, vocabulary: str, end: int, scratch: Scratch, roll: int = ROLL) -> tuple[str, DataFrame]:
    """Writes the ids of (doc_id, text) rows, each followed by the end id, in ascending doc_id order.

    Returns the files' folder and the manifest: part, piece, file, docs, tokens, start (ids in the files before). A task begins another file
    once one holds ``roll`` bytes.
    """
    uri = f"{scratch.base}/ids"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("salt", row_salt())
    rows = rows.repartitionByRange("doc_id", "h", "salt").sortWithinPartitions("doc_id", "h", "salt").select("doc_id", "text")
    manifest = scratch.save(rows.mapInArrow(_write(uri, vocabulary, end, roll), "part int, piece int, file string, docs long, tokens long"))
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return uri, manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _read(uri: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(uri)
        for batch in batches:
            for name, at in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(f"{path}/{name}") as source:
                    reader, rows = FrameReader(source), []
                    for k, (doc_id, _, known) in enumerate(reader.docs.tolist()):
                        data = reader.document(k)
                        rows.append((doc_id if known else None, at, len(data) // 4, zlib.crc32(data)))
                        at += len(data) // 4
                        if len(rows) == ROWS:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return run


def read_ids(uri: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, as the files hold them."""
    return manifest.select("file", "start").repartition(max(1, manifest.count())).mapInArrow(_read(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Image headers as a Spark data source: ``spark.read.format("image_headers").load(folder)``.

A row for each image file of a folder: its size, mode and format, of which only the header's bytes are read. Planning lists the folder once,
leaves out what a filter on suffix or the end of path rules out, and deals the files out to partitions. A file whose header is
damaged, or of another format than its suffix says it could be, is a row with an error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith

from pellucid.sources.images import SUFFIXES

SCHEMA = "path string, suffix string, length long, format string, width int, height int, mode string, error string"
#: Files of a partition.
FILES = 2000
#: Segments of a JPEG and entries of a TIFF directory that are looked at; beyond lies damage.
SEGMENTS, ENTRIES = 500, 4096

Read = Callable[[int, int], bytes]


def _need(read: Read, at: int, n: int) -> bytes:
    got = read(at, n)
    if len(got) < n:
        raise ValueError("the header ends too early")
    return got


def _png(read: Read) -> tuple[int, int, str]:
    w, h, depth, colour = struct.unpack(">IIBB", _need(read, 16, 10))
    if read(12, 4) != b"IHDR":
        raise ValueError("no header chunk")
    gray = {1: "1", 16: "I;16"}.get(depth, "L")
    mode = {0: gray, 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(colour)
    if mode is None:
        raise ValueError("unknown colour type")
    return w, h, mode


def _jpeg(read: Read) -> tuple[int, int, str]:
    at = 2
    for _ in range(SEGMENTS):
        mark, kind = _need(read, at, 2)
        if mark != 0xFF:
            raise ValueError("no marker where one must be")
        if kind == 0xFF:  # fill
            at += 1
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w, parts = struct.unpack(">HHB", _need(read, at + 5, 5))
            if parts not in (1, 3, 4):
                raise ValueError("unknown number of components")
            return w, h, {1: "L", 3: "RGB", 4: "CMYK"}[parts]
        if kind in (0xD9, 0xDA):
            break
        at += 2 + (0 if kind == 0x01 or 0xD0 <= kind <= 0xD7 else struct.unpack(">H", _need(read, at + 2, 2))[0])
    raise ValueError("no frame header")


def _bmp(read: Read) -> tuple[int, int, str]:
    (size,) = struct.unpack("<I", _need(read, 14, 4))
    if size == 12:
        w, h, _, bits = struct.unpack("<HHHH", _need(read, 18, 8))
    else:
        w, h, _, bits = struct.unpack("<iiHH", _need(read, 18, 12))
    mode = {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGBA"}.get(bits)
    if mode is None:
        raise ValueError("unknown depth")
    return w, abs(h), mode


def _tiff(read: Read) -> tuple[int, int, str]:
    end = "<" if read(0, 2) == b"II" else ">"
    (at,) = struct.unpack(end + "I", _need(read, 4, 4))
    (n,) = struct.unpack(end + "H", _need(read, at, 2))
    found: dict[int, int] = {}
    entries = _need(read, at + 2, 12 * min(n, ENTRIES))
    for i in range(0, len(entries), 12):
        tag, kind, count = struct.unpack(end + "HHI", entries[i : i + 8])
        if tag in (256, 257, 258, 262, 277) and kind in (3, 4):
            form = end + ("H" if kind == 3 else "I")
            inside = struct.calcsize(form) * count <= 4
            place = entries[i + 8 : i + 12]
            found[tag] = struct.unpack(form, (place if inside else _need(read, struct.unpack(end + "I", place)[0], 4))[: struct.calcsize(form)])[0]
    parts, photo = found.get(277, 1), found.get(262, 1)
    mode = {0: "L", 1: "L", 2: "RGB" if parts == 3 else "RGBA", 3: "P", 5: "CMYK", 6: "YCbCr"}.get(photo, "unknown")
    mode = "LA" if mode == "L" and parts == 2 else "1" if mode == "L" and found.get(258) == 1 else mode
    return found[256], found[257], mode


def _webp(read: Read) -> tuple[int, int, str]:
    head = _need(read, 0, 30)
    kind = head[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little"), "RGBA" if head[20] & 0x10 else "RGB"
    if kind == b"VP8L" and head[20] == 0x2F:
        bits = int.from_bytes(head[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "RGBA" if bits >> 28 & 1 else "RGB"
    if kind == b"VP8 " and head[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", head[26:30])
        return w & 0x3FFF, h & 0x3FFF, "RGB"
    raise ValueError("unknown kind of frame")


def header(read: Read) -> dict[str, Any]:
    """format, width, height, mode and error; read(offset, n) gives bytes of the file."""
    first = read(0, 12)
    kinds = ((b"\x89PNG\r\n\x1a\n", "PNG", _png), (b"\xff\xd8\xff", "JPEG", _jpeg), (b"BM", "BMP", _bmp), (b"II*\0", "TIFF", _tiff), (b"MM\0*", "TIFF", _tiff))
    name, parse = next(((n, p) for magic, n, p in kinds if first.startswith(magic)), ("WEBP", _webp) if first[:4] == b"RIFF" and first[8:] == b"WEBP" else (None, None))
    out = {"format": name, "width": None, "height": None, "mode": None, "error": None}
    try:
        if parse is None:
            raise ValueError("not an image of a known format")
        w, h, mode = parse(read)
        if w <= 0 or h <= 0:
            raise ValueError("an image without pixels")
        return out | {"width": w, "height": h, "mode": mode}
    except (ValueError, KeyError, struct.error) as e:
        return out | {"error": "no size in the directory" if isinstance(e, KeyError) else str(e)}


class _Some(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, folder: str, per: int):
        self.folder, self.per = folder, per
        self.ends: list[tuple[str, ...]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("suffix",):
                self.ends.append((f".{f.value}",))
            elif isinstance(f, In) and f.attribute == ("suffix",):
                self.ends.append(tuple(f".{v}" for v in f.value))
            elif isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.ends.append((f.value,))
            yield f  # Spark checks rows as well, as suffixes are in lower case

    def _listed(self) -> list[tuple[str, int]]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, base = FileSystem.from_uri(self.folder)
        files = [(f.path, f.size) for f in fs.get_file_info(FileSelector(base)) if f.type == FileType.File and f.path.lower().endswith(SUFFIXES)]
        keep = lambda p: all(p.endswith(e) or p.lower().endswith(tuple(x.lower() for x in e)) for e in self.ends)
        return sorted(f for f in files if keep(f[0]))

    def partitions(self) -> list[InputPartition]:
        files = self._listed()
        return [_Some(files[i : i + self.per]) for i in range(0, len(files), self.per)] or [_Some([])]

    def read(self, partition: _Some) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(self.folder)
        for path, length in partition.files:
            try:
                with fs.open_input_file(path) as f:

                    def read(at: int, n: int) -> bytes:
                        if at >= length:
                            return b""
                        f.seek(at)
                        return f.read(n)

                    h = header(read)
            except OSError as e:
                h = dict.fromkeys(("format", "width", "height", "mode")) | {"error": f"cannot be opened: {type(e).__name__}"}
            yield path, path.rsplit(".", 1)[1].lower(), length, h["format"], h["width"], h["height"], h["mode"], h["error"]


class ImageHeaders(DataSource):
    """Options: path, and files (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("files", FILES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageHeaders)

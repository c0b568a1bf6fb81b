"""Image folders, decoding, and PNG encoding of planes."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of images, in lower or upper case.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff")
NAMES = "{" + ",".join(f"*{s},*{s.upper()}" for s in SUFFIXES) + "}"
#: Splits of small files that one task reads, if there are enough of them: Spark counts 4 MB for opening a file, so a split has 32 at most.
SPLITS = 32


def same_uri(c: Column) -> Column:
    """Both file sources' way of writing local URIs."""
    return F.regexp_replace(c, "^file:/+", "file:/")


def _gathered(files: DataFrame) -> DataFrame:
    """The files in fewer tasks, but several for each core, as a task costs more than the small files of a split."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(4 * cores, files.rdd.getNumPartitions() // SPLITS))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of a folder's images, not of folders below; no file is opened. Spark leaves out files without a byte."""
    return _gathered(spark.read.format("binaryFile").option("pathGlobFilter", NAMES).option("recursiveFileLookup", False).load(folder).select("path", "length"))


def decode(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, channels, data (blue, green, red bytes) and error of a folder's images, of all that `list_images`
    lists; formats that the JVM cannot read, and damaged files, have an error instead of pixels."""
    i = _gathered(spark.read.format("image").option("pathGlobFilter", NAMES).load(folder).select("image.*"))
    bad = F.col("width") < 0
    ok = lambda c: F.when(~bad, F.col(c))
    return i.select(same_uri(F.col("origin")).alias("path"), ok("height").alias("height"), ok("width").alias("width"), ok("nChannels").alias("channels"), ok("data").alias("data"), F.when(bad, "cannot be decoded").alias("error"))


def luma_plane(data: Column, channels: Column) -> Column:
    """The gray plane, row by row, of decoded bytes."""
    from pellucid.functions.kernels import luma

    @F.pandas_udf("array<int>")
    def run(d: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for b, c in zip(d, n):
            if b is None:
                out.append(None)
                continue
            px = np.frombuffer(b, np.uint8).reshape(-1, int(c))
            out.append(luma(px[:, 2::-1]).tolist() if c >= 3 else px[:, 0].tolist())
        return pd.Series(out, dtype=object)

    return run(data, channels)


def png(plane: np.ndarray, level: int = -1) -> bytes:
    """An 8-bit gray PNG of rows of bytes."""
    h, w = plane.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + r.tobytes() for r in plane.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The plane of an 8-bit gray PNG, whose rows may use any filter."""
    at, body, shape = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            w, h, depth, colour = struct.unpack(">IIBB", part[:10])
            if (depth, colour) != (8, 0):
                raise ValueError("not an 8-bit gray image")
            shape = h, w
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    h, w = shape
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w + 1)
    out = np.zeros((h, w), np.uint8)
    for y in range(h):
        f, line = int(raw[y, 0]), raw[y, 1:]
        up = out[y - 1] if y else np.zeros(w, np.uint8)
        if f == 0:
            out[y] = line
        elif f == 1:
            out[y] = np.cumsum(line, dtype=np.uint64) & 255
        elif f == 2:
            out[y] = line + up
        else:  # each pixel needs the one before it
            row, above, left, corner = [], up.tolist(), 0, 0
            for x, b in zip(line.tolist(), above):
                if f == 3:
                    add = left + b >> 1
                else:
                    guess = left + b - corner
                    add = min((abs(guess - left), 0, left), (abs(guess - b), 1, b), (abs(guess - corner), 2, corner))[2]
                left, corner = x + add & 255, b
                row.append(left)
            out[y] = row
    return out


def encode(plane: Column, height: Column, width: Column, crop: tuple[int, int] | None = None) -> Column:
    """Base64 PNG of a gray plane, if wanted scaled and cut to (width, height) around the centre."""
    from pellucid.functions.kernels import centre_crop

    @F.pandas_udf("string")
    def run(v: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for x, a, b in zip(v, h, w):
            if x is None:
                out.append(None)
                continue
            g = np.asarray(x, np.uint8).reshape(int(a), int(b))
            out.append(base64.b64encode(png(centre_crop(g, *crop) if crop else g)).decode())
        return pd.Series(out, dtype=object)

    return run(plane, height, width)

"""Features of large gray planes by tiles with halos: no task holds a whole image.

A plane is a row for each strip of at least ``rows`` rows. Kernels that look at neighbours get a strip with the rows
above and below it that they need, which the strips beside it send; each strip gives partial sums, which Spark adds up
by image. Hysteresis of edges goes across strips: a strip keeps the connected parts that touch its borders, with what they
would add, and neighbouring strips are joined two by two, until a part touches no border; it then counts if any of its
pixels is strong. What is kept of a block of strips is as wide as the image, however high it is.

Strips that don't hold rows * width bytes are errors. A table without strips gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pellucid.functions import kernels as k

#: Rows of a strip at least: a multiple of a cosine block, and room for the wavelet's halo after two levels.
ROWS = 64
#: Strips that a task has as Python objects at once.
AT_ONCE = 32
STRIP = "image_id long, height int, width int, strip int, strips int, y0 int, data binary"
_SIZE = "image_id long, height int, width int, strip int, strips int, y0 int"


def _place(y, height, rows: int):
    """The strip of a row, and the number of strips: the last one takes what would not fill one of its own."""
    strips = F.greatest(F.floor(height / rows), F.lit(1))
    return F.least(F.floor(y / rows), strips - 1).cast("int"), strips.cast("int")


def assemble(blocks: DataFrame, rows: int = ROWS) -> DataFrame:
    """Strips of blocks: image_id, height, width, top, left, side, data (side * side bytes); places without a block are 0.

    A block's rows must be those of one strip, so sides divide ``rows``.
    """
    strip, strips = _place(F.col("top"), F.col("height"), rows)
    by = blocks.select("image_id", "height", "width", strip.alias("strip"), strips.alias("strips"), F.struct("top", "left", "side", "data").alias("b"))
    by = by.groupBy("image_id", "height", "width", "strip", "strips").agg(F.collect_list("b").alias("blocks"))  # those of one strip

    def one(r: dict) -> dict:
        y0 = r["strip"] * rows
        n = r["height"] - y0 if r["strip"] == r["strips"] - 1 else rows
        out = np.zeros((n, r["width"]), np.uint8)
        for b in r["blocks"]:
            px = np.frombuffer(b["data"], np.uint8).reshape(b["side"], b["side"])
            y, x = b["top"] - y0, b["left"]
            place = out[y : y + b["side"], x : x + b["side"]]
            place[:] = px[: place.shape[0], : place.shape[1]]
        return {c: r[c] for c in ("image_id", "height", "width", "strip", "strips")} | {"y0": y0, "data": out.tobytes()}

    return _mapped(by, one, STRIP)


def cut(planes: DataFrame, rows: int = ROWS) -> DataFrame:
    """Strips of whole planes: image_id, height, width, data (height * width bytes), cut by Spark."""
    _, strips = _place(F.lit(0), F.col("height"), rows)
    each = planes.select("image_id", "height", "width", "data", strips.alias("strips"), F.explode(F.sequence(F.lit(0), strips - 1)).alias("strip"))
    n = F.when(F.col("strip") == F.col("strips") - 1, F.col("height") - F.col("strip") * rows).otherwise(rows)
    return each.select("image_id", "height", "width", "strip", "strips", (F.col("strip") * rows).cast("int").alias("y0"), F.substring("data", F.col("strip") * rows * F.col("width") + 1, n * F.col("width")).alias("data"))


def with_halos(strips: DataFrame, above: int, below: int, item: int = 1) -> DataFrame:
    """Adds ``above`` and ``below``: the bytes of that many rows of the strips beside, empty at the image's borders. item: bytes of a pixel."""
    others = [c for c in strips.columns if c not in ("image_id", "strip", "data")]
    none = F.lit(None)
    row = item * F.col("width")
    blank = [none.alias(c) for c in others]
    sent = [F.struct("strip", F.lit(0).alias("kind"), F.col("data").alias("bytes"), *others)]
    if above:
        sent.append(F.struct((F.col("strip") + 1).alias("strip"), F.lit(1).alias("kind"), F.substring("data", F.length("data") - above * row + 1, above * row).alias("bytes"), *blank))
    if below:
        sent.append(F.struct((F.col("strip") - 1).alias("strip"), F.lit(2).alias("kind"), F.substring("data", F.lit(1), below * row).alias("bytes"), *blank))
    all_ = strips.select("image_id", "strips", F.explode(F.array(*sent)).alias("s")).filter("s.strip >= 0 and s.strip < strips")
    pick = lambda kind, c: F.first(F.when(F.col("s.kind") == kind, F.col(f"s.{c}")), ignorenulls=True)
    return all_.groupBy("image_id", F.col("s.strip").alias("strip")).agg(*[pick(0, c).alias(c) for c in others], pick(0, "bytes").alias("data"), pick(1, "bytes").alias("above"), pick(2, "bytes").alias("below"))


def _rows(data: bytes | None, width: int, dtype) -> np.ndarray:
    return np.frombuffer(data or b"", dtype).reshape(-1, width)


def _mapped(df: DataFrame, make: Callable[[dict], dict], ddl: str) -> DataFrame:
    """make gives a row for each row; AT_ONCE rows at most are Python objects at once, however many a batch has."""
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, AT_ONCE) for batch in batches for at in range(0, batch.num_rows, AT_ONCE)):
            made = [make(r) for r in part.to_pylist()]
            yield pa.RecordBatch.from_pydict({c: [m[c] for m in made] for c in names}, schema=_arrow(ddl))

    return df.mapInArrow(run, ddl)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in ddl.split(", ")])


# --- local binary patterns


def lbp(strips: DataFrame, points: int = 24, radius: int = 3) -> DataFrame:
    """image_id, bins: shares of points + 2 uniform patterns."""
    edge = radius + 1

    def codes(r: dict) -> dict:
        w, own = r["width"], _rows(r["data"], r["width"], np.uint8)
        up, down = (_rows(r[c], w, np.uint8) for c in ("above", "below"))
        img = np.zeros((1, len(own) + 2 * edge, w + 2 * edge))
        img[0, edge : edge + len(own), edge : edge + w] = own
        img[0, edge - len(up) : edge, edge : edge + w] = up
        img[0, edge + len(own) : edge + len(own) + len(down), edge : edge + w] = down
        return {"image_id": r["image_id"], "counts": np.bincount(k.lbp_codes(img, points, radius).ravel(), minlength=points + 2).tolist()}

    parts = _mapped(with_halos(strips, edge, edge), codes, "image_id long, counts array<long>")
    summed = parts.groupBy("image_id").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(points + 2)]).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return summed.select("image_id", F.transform("counts", lambda c: c / (total + k.EPS)).alias("bins"))


# --- cosine blocks


def chosen_blocks(total: int, most: int) -> np.ndarray:
    """The blocks of an image that are looked at: all, or a fixed sample."""
    return np.arange(total) if total <= most else np.random.default_rng(k.SEED).choice(total, size=most, replace=False)


def dct(strips: DataFrame, block: int = 8, most: int = k.BLOCKS) -> DataFrame:
    """image_id and the nine cosine statistics, over the coefficients of at most ``most`` blocks of an image; strips' rows are a multiple of a block's."""
    basis, split = k.dct_matrix(block), min(10, block * block)

    def coefficients(r: dict) -> dict:
        h, w = r["height"], r["width"]
        own = _rows(r["data"], w, np.uint8).astype(np.float64)
        pad = ((0, -len(own) % block), (0, -w % block))
        p = np.pad(own, pad, mode="reflect" if min(h, w) > 1 else "edge")
        across = p.shape[1] // block
        first, n = r["y0"] // block * across, p.shape[0] // block * across
        wanted = chosen_blocks(-(-h // block) * across, most)
        mine = wanted[(wanted >= first) & (wanted < first + n)] - first
        blocks = p.reshape(-1, block, across, block).transpose(0, 2, 1, 3).reshape(n, block, block)[mine]
        return {"image_id": r["image_id"], "c": (basis @ blocks @ basis.T).ravel()}

    c = F.col("c")
    rows = _mapped(strips, coefficients, "image_id long, c array<double>").select("image_id", F.posexplode("c").alias("i", "c")).withColumn("i", F.col("i") % (block * block))
    low, high = F.col("i").between(1, split - 1), F.col("i") >= split
    energy = F.sum(c * c) + k.EPS
    zero = F.lit(0.0)
    return rows.groupBy("image_id").agg(
        F.avg("c").alias("mean"),
        F.stddev_pop("c").alias("std"),
        F.median("c").alias("median"),
        F.avg(F.when(F.abs("c") < 1e-6, 1.0).otherwise(0.0)).alias("zeros"),
        F.avg(F.when(F.col("i") == 0, F.abs("c"))).alias("dc"),
        F.coalesce(F.avg(F.when(low, F.abs("c"))), zero).alias("low"),
        F.coalesce(F.avg(F.when(high, F.abs("c"))), zero).alias("high"),
        (F.coalesce(F.sum(F.when(low, c * c)), zero) / energy).alias("low_share"),
        (F.coalesce(F.sum(F.when(high, c * c)), zero) / energy).alias("high_share"),
    )


# --- wavelet bands


def wavelet(strips: DataFrame, levels: int = 3) -> DataFrame:
    """image_id, level (1 is the finest), band (aa of the last level alone; ad, da, dd), mean, std, energy, and mean and std of the bands' shares of energy.

    A level halves the strips; strips of ROWS rows have room for three levels, more need higher ones.
    """
    taps, reach = {"a": k.DB4, "d": k.HIGH}, len(k.DB4) - 1

    def analysed(r: dict) -> dict:
        out = {c: r[c] for c in ("image_id", "height", "width", "strip", "strips", "y0", "level", "left", "data", "stats")}
        if not r["left"]:
            return out
        w, own = r["width"], _rows(r["data"], r["width"], np.float64)
        up = _rows(r["above"], w, np.float64) if r["strip"] else np.pad(own, ((reach, 0), (0, 0)), mode="symmetric")[:reach]
        last = r["strip"] == r["strips"] - 1
        ext = np.concatenate([up, np.pad(own, ((0, reach), (0, 0)), mode="symmetric") if last else own])
        y0 = r["y0"]
        starts = np.arange(1 - y0 % 2, len(own) + (reach if last else 0), 2)
        stats, level = list(r["stats"]), r["level"] + 1
        for x, t in taps.items():
            line = np.lib.stride_tricks.sliding_window_view(k.analyse(ext, t), reach + 1, axis=0)[starts]
            for y, u in taps.items():
                band = line @ u[::-1]
                if x + y == "aa":
                    out["data"] = band.tobytes()
                if x + y != "aa" or r["left"] == 1:
                    stats += [float(level), float("aa ad da dd".split().index(x + y)), float(band.size), band.sum(), (band**2).sum()]
        return out | {"height": (r["height"] + reach) // 2, "width": (w + reach) // 2, "y0": y0 // 2, "level": level, "left": r["left"] - 1, "stats": stats}

    ddl = _SIZE + ", level int, left int, data binary, stats array<double>"
    doubles = _mapped(strips, lambda r: r | {"level": 0, "left": k.wavelet_levels(r["height"], r["width"], levels), "data": _rows(r["data"], r["width"], np.uint8).astype(np.float64).tobytes(), "stats": []}, ddl)
    for _ in range(levels):
        doubles = _mapped(with_halos(doubles, reach, 0, 8), analysed, ddl)
    at = lambda i: F.col("stats")[F.col("j") * 5 + i]
    parts = doubles.select("image_id", "stats", F.explode(F.sequence(F.lit(0), (F.size("stats") / 5 - 1).cast("int"))).alias("j"))
    name = F.element_at(F.array(*[F.lit(b) for b in ("aa", "ad", "da", "dd")]), at(1).cast("int") + 1)
    bands = parts.groupBy("image_id", at(0).cast("int").alias("level"), name.alias("band")).agg(F.sum(at(2)).alias("n"), F.sum(at(3)).alias("s"), F.sum(at(4)).alias("energy"))
    of = Window.partitionBy("image_id")  # the bands of one image
    share = F.col("energy") / (F.sum("energy").over(of) + k.EPS)
    mean = F.col("s") / F.col("n")
    bands = bands.select("image_id", "level", "band", mean.alias("mean"), F.sqrt(F.greatest(F.col("energy") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), "energy", share.alias("share"))
    return bands.withColumns({"share_mean": F.avg("share").over(of), "share_std": F.stddev_pop("share").over(of)}).drop("share")


# --- edges


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's connected part."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _near(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of labels (-1: none) of a row and the row below that touch, diagonals included."""
    w = upper.shape[-1]
    found = []
    for shift in (-1, 0, 1):
        a, b = upper[..., max(0, -shift) : w - max(0, shift)].ravel(), lower[..., max(0, shift) : w - max(0, -shift)].ravel()
        both = (a >= 0) & (b >= 0)
        found.append((a[both], b[both]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _settled(label: np.ndarray, strong: np.ndarray, counts: np.ndarray, top: np.ndarray, bottom: np.ndarray, total: np.ndarray) -> dict:
    """Parts by label joined; those that touch neither border count now or never."""
    kinds, place = np.unique(label, return_inverse=True)
    s, c = np.zeros(len(kinds), bool), np.zeros((len(kinds), 9), np.int64)
    np.logical_or.at(s, place, strong)
    np.add.at(c, place, counts)
    to = lambda row: np.where(row >= 0, place[np.maximum(row, 0)], -1) if len(place) else row
    top, bottom = to(top), to(bottom)
    open_ = np.union1d(top[top >= 0], bottom[bottom >= 0]).astype(np.int64)
    inner = np.ones(len(kinds), bool)
    inner[open_] = False
    total = total + c[inner & s].sum(0)
    number = np.full(len(kinds) + 1, -1)
    number[open_] = np.arange(len(open_))
    return {"total": total.tolist(), "top": number[top].tolist(), "bottom": number[bottom].tolist(), "strong": s[open_].tolist(), "counts": c[open_].ravel().tolist()}


_BLOCK = "image_id long, height int, width int, strips int, block int, total array<long>, top array<int>, bottom array<int>, strong array<boolean>, counts array<long>"


def _edges_of(r: dict, low: float, high: float) -> dict:
    """What a strip has of edges: sums of parts inside, and the parts that touch the strips beside."""
    w, own = r["width"], _rows(r["data"], r["width"], np.uint8)
    up, down = (_rows(r[c], w, np.uint8) for c in ("above", "below"))
    g = np.concatenate([up, own, down])[None].astype(np.int64)
    mine = slice(len(up), len(up) + len(own))
    dx, dy = k.sobel(g, "edge")
    mag = np.zeros((1, len(own) + 2, w + 2))
    lo, hi = 1 if len(up) else 0, 1 if len(down) else 0
    mag[0, 1 - lo : 1 + len(own) + hi, 1:-1] = (np.abs(dx) + np.abs(dy))[0, len(up) - lo : len(up) + len(own) + hi]
    thin = k.thinned(mag, dx[:, mine], dy[:, mine], low)[0]
    sx, sy = k.sobel(g)
    direction = np.clip(np.searchsorted(np.linspace(-np.pi, np.pi, 9), np.arctan2(sy[0, mine], sx[0, mine])[thin], side="right") - 1, 0, 7)
    n = int(thin.sum())
    label = np.full(thin.shape, -1)
    label[thin] = np.arange(n)
    a, b = _near(label[:-1], label[1:])
    side = (label[:, :-1] >= 0) & (label[:, 1:] >= 0)
    root = _union(n, np.concatenate([a, label[:, :-1][side]]), np.concatenate([b, label[:, 1:][side]]))
    counts = np.zeros((n, 9), np.int64)
    counts[:, 0] = 1
    counts[np.arange(n), 1 + direction] = 1
    strong = (mag[0, 1:-1, 1:-1] > high)[thin]
    none = np.full(w, -1)
    made = _settled(root, strong, counts, label[0] if r["strip"] else none, label[-1] if r["strip"] < r["strips"] - 1 else none, np.zeros(9, np.int64))
    return {c: r[c] for c in ("image_id", "height", "width", "strips")} | {"block": r["strip"]} | made


def _merged(upper: pd.Series, lower: pd.Series) -> dict:
    """Two blocks of strips as one."""
    n = len(upper["strong"])
    arrays = {c: [np.asarray(x[c], np.int64) for x in (upper, lower)] for c in ("top", "bottom", "total", "counts")}
    shift = lambda row: np.where(row >= 0, row + n, -1)
    a, b = _near(arrays["bottom"][0], shift(arrays["top"][1]))
    root = _union(n + len(lower["strong"]), a, b)
    strong = np.concatenate([np.asarray(upper["strong"], bool), np.asarray(lower["strong"], bool)])
    return _settled(root, strong, np.concatenate(arrays["counts"]).reshape(-1, 9), arrays["top"][0], shift(arrays["bottom"][1]), arrays["total"][0] + arrays["total"][1])


def edges(strips: DataFrame, low: float = 50, high: float = 150) -> DataFrame:
    """image_id, density (share of edge pixels) and directions (shares of eight gradient directions there)."""
    blocks = _mapped(with_halos(strips, 2, 2), lambda r: _edges_of(r, low, high), _BLOCK)
    most = strips.agg(F.max("strips")).first()[0] or 1

    def pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        one = rows.iloc[[0]].assign(block=key[1])
        if len(rows) == 2:
            made = _merged(rows.iloc[0], rows.iloc[1])
            one = one.assign(**{c: [v] for c, v in made.items()})
        return one

    while most > 1:
        blocks, most = blocks.groupBy("image_id", F.floor(F.col("block") / 2).alias("_pair")).applyInPandas(pair, _BLOCK), -(-most // 2)
    # a block that is the whole image touches nothing, so all is summed
    n = F.aggregate(F.slice("total", 2, 8), F.lit(0).cast("long"), lambda a, x: a + x)
    return blocks.select("image_id", (F.col("total")[0] / (F.col("height").cast("double") * F.col("width"))).alias("density"), F.transform(F.slice("total", 2, 8), lambda c: c / (n + k.EPS)).alias("directions"))

"""Language identification by a convolutional network over bytes, trained in numpy.

Texts are cut into windows of WINDOW bytes. Each window passes through filters of several widths, the
maximum over positions and a softmax; a document's score is the mean of its windows' probabilities, each
weighted by its bytes. All windows of every text count.

Fitting takes a bounded sample: about ``per_lang`` labelled documents of each language by a hash of id
and text, and at most ``windows`` windows of each, spread over the whole text; of all languages ``most`` windows,
shared out evenly (one of each at least). Every language that a document is labelled with is learned.

Nulls, ties, repeats: a text that is null or has no letter is ``und`` with score 0, and so is every text if
nothing was learned. A document without id is not held out and not learned from. Ties go to the
language that comes first. Repeated rows get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm.common import process_state

WINDOW, DIM, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
UNKNOWN = "und"
#: Windows that are multiplied at once.
TILE = 32


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What byte pairs add to every filter, and what the last byte adds to filters of width three."""
        p = [np.einsum("bd,kdf->kbf", self.embed, w) for w in self.filters]
        pairs = [p[0][0][:, None] + p[0][1][None], p[1][0][:, None] + p[1][1][None], p[2][0][:, None] + p[2][1][None], p[2][2][:, None] + p[2][3][None]]
        return np.ascontiguousarray(np.concatenate(pairs, 2).reshape(65536, -1), np.float32), np.ascontiguousarray(p[1][2], np.float32)

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Of each language, for windows of bytes (rows)."""
        pair_table, last = tables or self.tables()
        out = np.empty((len(x), len(self.langs)))
        n = FILTERS
        for lo in range(0, len(x), TILE):
            b = x[lo : lo + TILE]
            g = pair_table[b[:, :-1].astype(np.int32) << 8 | b[:, 1:]]
            convs = [g[:, :, :n], g[:, :-1, n : 2 * n] + last[b[:, 2:]], g[:, :-2, 2 * n : 3 * n] + g[:, 2:, 3 * n :]]
            top = np.concatenate([np.maximum(_highest(c) + v, 0) for c, v in zip(convs, self.bias)], 1)
            z = top @ self.out + self.out_bias
            e = np.exp(z - z.max(1, keepdims=True))
            out[lo : lo + TILE] = e / e.sum(1, keepdims=True)
        return out


def _highest(c: np.ndarray) -> np.ndarray:
    """The maximum over positions, by halves."""
    while c.shape[1] > 1:
        half = -(-c.shape[1] // 2)
        c = np.maximum(c[:, :half], c[:, -half:])
    return c[:, 0]


def windows(data: bytes) -> np.ndarray:
    """All windows of a text; the last is filled with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 7, least_steps: int = 400) -> Model:
    """Adam on the cross entropy; each pass shortens one window in four, as texts may be short.

    Small samples take more passes, for least_steps batches in all.
    """
    epochs = max(epochs, -(-least_steps // -(-len(x) // batch)))
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.5, (256, DIM))] + [rng.normal(0, (2 / (k * DIM)) ** 0.5, (k, DIM, FILTERS)) for k in WIDTHS] + [np.zeros(FILTERS) for _ in WIDTHS]
    p += [rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))), np.zeros(len(langs))]
    p = [a.astype(np.float32) for a in p]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    nk = len(WIDTHS)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            b = x[at].copy()
            for i in np.flatnonzero(rng.random(len(b)) < 0.25):
                b[i, int(rng.integers(16, WINDOW)) :] = 0
            e = p[0][b]
            tops, where = [], []
            for k, w, c in zip(WIDTHS, p[1 : 1 + nk], p[1 + nk : 1 + 2 * nk]):
                cols = np.concatenate([e[:, j : WINDOW - k + 1 + j] for j in range(k)], 2)
                conv = cols @ w.reshape(-1, FILTERS) + c
                where.append(conv.argmax(1))
                tops.append(np.take_along_axis(conv, where[-1][:, None], 1)[:, 0])
            top = np.concatenate(tops, 1)
            act = np.maximum(top, 0)
            z = act @ p[-2] + p[-1]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(at)), y[at]] -= 1
            q /= len(at)
            grads = [np.zeros_like(a) for a in p]
            grads[-2], grads[-1] = act.T @ q, q.sum(0)
            back = (q @ p[-2].T) * (top > 0)
            rows = np.arange(len(at))[:, None]
            for i, k in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[1 + nk + i] = g.sum(0)
                for j in range(k):
                    seen = b[rows, where[i] + j]
                    grads[1 + i][j] = np.einsum("nfd,nf->df", p[0][seen], g)
                    np.add.at(grads[0], seen, g[:, :, None] * p[1 + i][j].T[None])
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = (p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(langs, p[0], p[1 : 1 + nk], p[1 + nk : 1 + 2 * nk], p[-2], p[-1])


def _sampled(most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, order, data = [], [], []
            for t, name, h in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "h"))):
                w = windows(t.encode("utf-8", "surrogatepass"))
                pick = sorted({int(i) for i in np.linspace(0, len(w) - 1, min(most, len(w)))})
                lang += [name] * len(pick)
                order += [h] * len(pick)
                data += [w[i].tobytes() for i in pick]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(order, pa.int64()), pa.array(data, pa.binary())], names=["lang", "h", "data"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, per_lang: int = 300, windows: int = 10, most: int = 60_000) -> Model | None:
    """A model from the labelled documents that are not held out; None if there are none. The driver holds most * WINDOW bytes."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & has_letter(F.col("text")))
    counts = labelled.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return None
    h = F.xxhash64("doc_id", "text")
    share = F.create_map(*[F.lit(v) for r in counts for v in (r.lang, min(1.0, per_lang / r["count"]))])
    part = F.pmod(h, F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * float(1 << 40)
    sample = labelled.filter(part).select("text", "lang", h.alias("h"))
    cut = sample.mapInArrow(_sampled(windows), "lang string, h long, data binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "data"))
    cap = max(1, min(2 * per_lang * windows, most // len(counts)))
    rows = cut.withColumn("place", place).filter(F.col("place") <= cap).orderBy("h", "lang", "data").collect()
    if not rows:
        return None
    langs = sorted({r.lang for r in rows})
    of = {name: i for i, name in enumerate(langs)}
    return fit(np.stack([np.frombuffer(r.data, np.uint8) for r in rows]), np.array([of[r.lang] for r in rows]), langs)


def predict(text: Column, model: Model | None) -> Column:
    """A struct of lang_pred and score."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = process_state(("langid", model.out.tobytes()), model.tables)
        for texts in parts:
            names, scores = [], []
            held, held_rows, total = [], [], 0

            def flush() -> None:
                if not held:
                    return
                x = np.concatenate(held)
                probs = model.probabilities(x, tables)
                weight = np.concatenate([w for _, w in held_rows])
                starts = np.cumsum([0] + [len(w) for _, w in held_rows[:-1]])
                mean = np.add.reduceat(probs * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                for (i, _), row in zip(held_rows, mean):
                    best = int(row.argmax())
                    names[i], scores[i] = model.langs[best], float(min(1.0, row[best]))

            for i, t in enumerate(texts):
                names.append(UNKNOWN)
                scores.append(0.0)
                if t is None:
                    continue
                data = t.encode("utf-8", "surrogatepass")
                w = windows(data)
                weight = np.full(len(w), float(WINDOW))
                weight[-1] = len(data) - WINDOW * (len(w) - 1)
                held.append(w)
                held_rows.append((i, weight))
                total += len(w)
                if total >= 4096:
                    flush()
                    held, held_rows, total = [], [], 0
            flush()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return run(F.when(has_letter(text), text))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    got = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), model).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """The rows whose text is in a learned language with a score of ``least`` or more, with all their columns."""
    p = predict(F.col("text"), model)
    rows = docs.select(F.struct("*").alias("row"), p.alias("p"))
    return rows.filter((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least)).select("row.*")

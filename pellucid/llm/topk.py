"""Exact top-k inner-product search by tiled matrix products.

Queries and candidates are dealt into tiles of bounded size; each (query tile, shard) pair is one
matrix product with a partial selection, and per-query lists are merged in a tree of fan-in 16.

Nulls, ties, repeats: vectors that are null, empty, or hold a null or non-finite component take no part,
nor do rows without an id. Ties go to the smaller id. Repeated rows are separate candidates, and a
repeated query row gets a list of its own; rows with the query's own id are never its results.
Vectors are compared only with vectors of the same length. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pellucid.llm.common import row_salt

FAN_IN = 16


def usable(vec_id: Column, vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec_id.isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of integral doubles."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 2**63:
        raise OverflowError("a score does not fit in a long")
    return exact.astype(np.int64)


def select_tile(q_uid, q_id, q_vec, c_id, c_vec, k: int) -> Iterator[tuple]:
    """(uid, query id, negated scores, ids) of the best k candidates of each query in one tile."""
    order = np.argsort(c_id, kind="stable")
    c_id, c_vec = c_id[order], c_vec[order]
    scores = _products(q_vec, c_vec)
    own_lo, own_hi = np.searchsorted(c_id, q_id, "left"), np.searchsorted(c_id, q_id, "right")
    for i in range(len(q_id)):
        keep = np.ones(len(c_id), bool)
        keep[own_lo[i] : own_hi[i]] = False
        ids, s = c_id[keep], scores[i][keep]
        if len(s) > k:
            kth = np.partition(s, len(s) - k)[len(s) - k]
            over, at = np.flatnonzero(s > kth), np.flatnonzero(s == kth)
            pick = np.concatenate([over, at[: k - len(over)]])  # ids ascend, so ties keep the smaller
            ids, s = ids[pick], s[pick]
        if len(s):
            best = np.lexsort((ids, -s))
            yield q_uid[i], q_id[i], (-s[best]).tolist(), ids[best].tolist()


def _tiles(k: int, scale: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        lengths = pdf["vector"].map(len)
        for _, part in pdf.groupby(lengths):
            vec = np.floor(np.stack(part["vector"].to_numpy()).astype(np.float64) * scale)
            is_q = part["is_query"].to_numpy(bool)
            uid, vid = part["uid"].to_numpy(np.int64), part["vec_id"].to_numpy(np.int64)
            if is_q.any() and not is_q.all():
                rows += select_tile(uid[is_q], vid[is_q], vec[is_q], vid[~is_q], vec[~is_q], k)
        shard = pdf["shard"].iloc[0]
        return pd.DataFrame([(r[0], r[1], shard, r[2], r[3]) for r in rows], columns=["uid", "query_id", "shard", "neg", "ids"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", query_rows: int = 1024, shard_rows: int = 2048) -> DataFrame:
    """The k best rows for each query row by the inner product of floor(scale * x).

    query_rows, shard_rows: rows of a tile, which bound a task's memory whatever the table's size.
    Returns query_id, rank, vec_id, score.
    """
    rows = vectors.filter(usable(F.col(id_col), F.col(vec_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"), is_query.alias("is_query"))
    n, nq = rows.agg(F.count("*"), F.count_if("is_query")).first()
    shards, tiles = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(nq / query_rows))
    salt = rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("salt", row_salt())
    parts = [
        salt.select("uid", "vec_id", "vector", F.lit(False).alias("is_query"), F.pmod("salt", F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")),
        salt.filter("is_query").select("uid", "vec_id", "vector", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod("salt", F.lit(tiles)).cast("int").alias("tile")),
    ]
    lists = parts[0].unionByName(parts[1]).groupBy("shard", "tile").applyInPandas(_tiles(k, scale), "uid long, query_id long, shard int, neg array<long>, ids array<long>")
    lists = lists.select("uid", "query_id", "shard", F.arrays_zip("neg", "ids").alias("best"))
    while shards > 1:
        lists = lists.groupBy("uid", "query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        shards = math.ceil(shards / FAN_IN)
    flat = lists.select("query_id", F.posexplode("best").alias("at", "b"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.ids").alias("vec_id"), (-F.col("b.neg")).alias("score"))

"""Connected components of an edge table by repeated contraction.

Each round maps every node to its least smaller neighbour, jumps twice along that forest, relabels the
edges and drops loops and repeats; the edges that are left shrink geometrically. Rounds end when no edge is left.
All state is in shared tables. Hubs are combined before shuffles, and joins are on single nodes, so that Spark
can split a hub's edges. All tables grow with the graph, and take far less room stored than as a broadcast: none is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm.common import Scratch


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b (long, not null). Returns node, root: every node that an edge has, and its component's least node."""
    edges = scratch.save(_tidy(edges))
    nodes = scratch.save(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root")))
    while not edges.isEmpty():
        up = scratch.save(edges.groupBy("a").agg(F.min("b").alias("p")))
        for _ in range(2):
            again = up.select(F.col("a").alias("a2"), F.col("p").alias("p2"))
            up = scratch.save(up.join(again.hint("merge"), up["p"] == again["a2"], "left").select("a", F.coalesce("p2", "p").alias("p")))
        pa, pb = up.select(F.col("a").alias("na"), F.col("p").alias("ra")), up.select(F.col("a").alias("nb"), F.col("p").alias("rb"))
        moved = edges.join(pa.hint("merge"), edges["a"] == pa["na"]).join(pb.hint("merge"), edges["b"] == pb["nb"], "left")
        edges = scratch.save(_tidy(moved.select(F.col("ra").alias("a"), F.coalesce("rb", "b").alias("b"))))
        nodes = scratch.save(nodes.join(pa.hint("merge"), nodes["root"] == pa["na"], "left").select("node", F.coalesce("ra", "root").alias("root")))
    return nodes

"""Audit of how five filters interact: what each removes, repeats or alone removes, in every order of application.

Documents are summed to cells (part, five failure flags, labels) first. A cube over the flags and the part then holds the
survivors of every subset of filters: the rows of a grouping set whose chosen flags are all false. A step of an order
is a pair of subsets, before and after one filter; pairs are joined, and 120 orders of five steps read them.

Nulls, ties, repeats: a null text is empty, a null source is the part ''. A document without id is identical to no
other one and has no labels. Rows of equal id and text are not smaller than one another: they fail together. Of several labels of
an id, any 1 counts. An empty table gives no row. The words of a text are one array of its row, whatever its length. A text that very many
documents share is counted by part and flags before its rows meet.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm.common import SPACE, Scratch, row_salt

FILTERS = "ABCDE"
#: Thresholds of the filters: fewest words, least percentage of distinct words, highest percentage of capitals, marks.
WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"
ALL = (1 << len(FILTERS)) - 1


def text_flags(text: Column) -> list[Column]:
    """The four failure conditions that a text alone decides; the text is not null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))

    c = F.element_at(F.transform(F.array(words), counts), 1)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [c.alias("counts"), (100 * capitals > CAPITALS * F.length(text)).alias("C"), text.rlike(MARKS).alias("D")]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good, toxic, n: how many documents of a part fail the same filters and have the same labels."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("th"), F.when(F.col("doc_id").isNull(), row_salt()).otherwise(0).alias("salt"), *text_flags(text))
    rows = rows.withColumns({"A": F.col("counts.n") < WORDS, "B": 100 * F.col("counts.d") < DISTINCT * F.col("counts.n")}).drop("counts")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    rows = rows.join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").fillna(False, ["good", "toxic"])
    kind = ["part", "A", "B", "C", "D", "good", "toxic"]
    once = rows.groupBy("doc_id", "salt", "th", *kind).agg(F.count("*").alias("times"))
    # a text has a row for each part and label at most
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "times"))
    texts = once.groupBy("th", *kind).agg(F.sum("times").alias("n"), F.min(known).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("times")).otherwise(0)).alias("lone"))
    least = F.min("first.doc_id").over(Window.partitionBy("th"))
    unlike = F.when(F.col("first.doc_id") == least, F.col("first.times")).otherwise(0) + F.col("lone")
    sums = texts.withColumn("unlike", unlike).groupBy(*kind).agg(F.sum("unlike").alias("unlike"), F.sum(F.col("n") - F.col("unlike")).alias("like"))
    either = F.array(F.struct(F.lit(False).alias("E"), F.col("unlike").alias("n")), F.struct(F.lit(True).alias("E"), F.col("like").alias("n")))
    return sums.select(*kind, F.inline(either)).filter("n > 0")


def survivors(counted: DataFrame) -> DataFrame:
    """part, subset (a bit for each filter), n, good, toxic: documents of a part that pass all filters of a subset, zeros included; part null is the whole table."""
    cube = counted.cube("part", *FILTERS).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        *[F.grouping(f).alias(f"not_{f}") for f in FILTERS], F.grouping("part").alias("whole"),
    )
    passed = F.lit(True)
    subset = F.lit(0)
    for i, f in enumerate(FILTERS):
        passed = passed & ((F.col(f"not_{f}") == 1) | ~F.col(f))
        subset = subset + (1 - F.col(f"not_{f}")) * (1 << i)
    found = cube.filter(passed).select("part", "whole", subset.cast("int").alias("subset"), "n", "good", "toxic")
    zeros = cube.filter(" and ".join(f"not_{f} = 1" for f in FILTERS)).select("part", "whole", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("subset"), *[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    return found.unionByName(zeros).groupBy("part", "whole", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def steps(alive: DataFrame) -> DataFrame:
    """A row for each part, filter order and step; alive: as survivors() gives it."""
    spark = alive.sparkSession
    orders = [("".join(p), k + 1, p[k], sum(1 << FILTERS.index(f) for f in p[:k])) for p in permutations(FILTERS) for k in range(len(FILTERS))]
    table = spark.createDataFrame(orders, "filter_order string, step int, filter string, subset int")
    more = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(1 << i).alias("bit")) for i, f in enumerate(FILTERS)])
    before = alive.select("part", "whole", "subset", "n", "good", "toxic", F.inline(more)).filter("subset & bit = 0").withColumn("after", F.col("subset") + F.col("bit"))
    after = alive.select(F.col("part").alias("p"), F.col("whole").alias("w"), F.col("subset").alias("after"), F.col("n").alias("kept"), F.col("good").alias("g"), F.col("toxic").alias("t"))
    pairs = before.join(after, before["part"].eqNullSafe(after["p"]) & (before["whole"] == after["w"]) & (before["after"] == after["after"]))
    pairs = pairs.select("part", "whole", "filter", "bit", "subset", "kept", (F.col("n") - F.col("kept")).alias("removed"), (F.col("good") - F.col("g")).alias("good_lost"), (F.col("toxic") - F.col("t")).alias("toxic_lost"))
    # orders in which a filter follows just this subset
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), F.bit_count("subset") + 1)
    of = Window.partitionBy("part", "whole", "filter")
    pairs = pairs.withColumns(
        {
            "failing": F.max(F.when(F.col("subset") == 0, F.col("removed"))).over(of),
            "unique_fails": F.max(F.when(F.col("subset") + F.col("bit") == ALL, F.col("removed"))).over(of),
            "shapley": F.sum(F.col("removed") * weight).over(of),
        }
    )
    out = pairs.join(F.broadcast(table), ["filter", "subset"])  # 600 rows
    return out.select("part", "whole", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch, whole: bool = False) -> DataFrame:
    """The steps of every part, or with ``whole`` of the table as one part; the table of cells is stored, so texts are read once."""
    out = steps(survivors(scratch.save(cells(docs, labels))))
    return (out.filter("whole = 1").drop("part") if whole else out.filter("whole = 0")).drop("whole")

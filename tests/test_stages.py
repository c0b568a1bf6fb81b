"""Trails by blocks equal the fold of a whole conversation."""

import random

import pytest
from pyspark.sql import functions as F

from pellucid.operators import stages

DDL = "conv_id long, seq long, found string, n long"


def folded(rows, cap):
    out, state = [], {}
    for c, seq, found, n in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3])):
        i, stage, bad = state.get(c, (0, "INITIAL", 0))
        bad += found is None
        if stage != "MAX_ITERATIONS":
            stage = "MAX_ITERATIONS" if (n + bad) // 2 >= cap else found or stage
        state[c] = i + 1, stage, bad
        out.append((c, seq, *state[c]))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_random_trails(spark, block):
    r = random.Random(block)
    rows = []
    for c in range(60):
        n = 0
        for seq in sorted(r.sample(range(200), r.randrange(1, 40))):
            n += r.randrange(1, 3)
            rows.append((c, seq, r.choice([None, None, *r.sample(stages.STAGES[:10], 3), *(["MAX_ITERATIONS"] if r.random() < 0.05 else [])]), n))
    df = spark.createDataFrame(rows, DDL).repartition(5)
    for cap in (5, 20, 1000):
        got = sorted((x.conv_id, x.seq, x.i, x.stage, x.unparsed) for x in stages.trail(df, cap, block).collect())
        assert got == folded(rows, cap)
    steps = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "found", "n"))).alias("steps"))
    walked = {x.conv_id: (x.stage, x.unparsed, x.trail) for x in stages.walk(steps, 20).collect()}
    for c in walked:
        mine = [x for x in folded(rows, 20) if x[0] == c]
        assert walked[c] == (mine[-1][3], mine[-1][4], [x[3] for x in mine])


def test_one_endless_conversation(spark):
    """A million replies of one conversation: no task of the blocks' stage sees more than a fraction."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") % 5 == 0, F.element_at(F.array(*[F.lit(s) for s in stages.STAGES[:8]]), (F.col("id") % 8 + 1).cast("int"))).alias("found"), (F.col("id") + 1).alias("n"))
    out = stages.trail(df, 10**9)
    top = out.filter(F.col("seq") >= n - 3).orderBy("seq").collect()
    assert [(x.i, x.stage, x.unparsed) for x in top] == [(n - 2, stages.STAGES[(n - 5) % 8], n - 2 - n // 5), (n - 1, stages.STAGES[(n - 5) % 8], n - 1 - n // 5), (n, stages.STAGES[(n - 5) % 8], n - n // 5)]
    sizes = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) < 0.6 * n


def test_graph_ends_once(spark):
    rows = [(1, 1, "EVIDENCE_ADJUDICATION", 2), (1, 2, "DONE", 3), (1, 3, "ERROR", 4), (2, 1, None, 2), (2, 2, "ERROR", 3), (3, 5, None, 1)]
    t = stages.trail(spark.createDataFrame(rows, DDL), 20, 2)
    got = {x.conv_id: (x.checks, x.outcome) for x in stages.graph(t, F.lit(True), F.lit(True)).collect()}
    assert got == {1: (2, "end"), 2: (2, "raise:error"), 3: (1, "open")}

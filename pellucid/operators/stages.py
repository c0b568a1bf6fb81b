"""The stage machine: markers in replies, checks with an iteration cap, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of stages; a marker must give one of them, in any case.
STAGES = (
    "INITIAL",
    "SEMANTIC_CONTEXT_EXTRACTION",
    "EXTERNAL_DETECTOR_INTEGRATION",
    "EXPERT_PRIOR_INVESTIGATION",
    "EXPERT_PROFILES_GENERATION",
    "CLUSTERING_PRIOR_INVESTIGATION",
    "CLUSTERING_PROFILES_GENERATION",
    "EVIDENCE_ADJUDICATION",
    "FORENSIC_REPORT_FORMULATION",
    "DONE",
    "MAX_ITERATIONS",
    "ERROR",
)
#: Fixed value: the marker's pattern, on lower-cased text.
MARKER = r"update stage to:\s*'?([a-zA-Z0-9_]+)'?"


def marker(content: Column, reasoning: Column) -> Column:
    """The stage that a reply's last marker names, or null."""
    low = F.lower(F.concat(F.coalesce(reasoning, F.lit("")), F.lit("\n"), content))
    name = F.upper(F.try_element_at(F.regexp_extract_all(low, F.lit(MARKER), F.lit(1)), F.lit(-1)))
    return F.when(name.isin(*STAGES), name)


def step(current: Column, found: Column, messages: Column, cap: int) -> Column:
    """The stage after a check: unchanged if no marker was found, which also adds a message; the cap beats both."""
    n = messages + F.when(found.isNull(), 1).otherwise(0)
    return F.when(F.floor(n / 2) >= cap, "MAX_ITERATIONS").otherwise(F.coalesce(found, current))


def walk(df: DataFrame, cap: int = 20) -> DataFrame:
    """Folds each conversation's replies in order: the stage after every one, and how many messages there are by then.

    Input: conv_id and steps, an array of (seq, found, n): n messages up to the reply. Output: conv_id, final
    stage, unparsed (replies without a valid marker), trail (array of stages).
    """
    start = F.struct(F.lit("INITIAL").alias("stage"), F.lit(0).alias("unparsed"), F.array().cast("array<string>").alias("trail"))

    def fold(acc: Column, s: Column) -> Column:
        bad = acc["unparsed"] + F.when(s["found"].isNull(), 1).otherwise(0)
        stage = F.when(acc["stage"] == "MAX_ITERATIONS", acc["stage"]).otherwise(step(acc["stage"], s["found"], (s["n"] + acc["unparsed"]).cast("int"), cap))
        return F.struct(stage.alias("stage"), bad.alias("unparsed"), F.concat(acc["trail"], F.array(stage)).alias("trail"))

    out = F.aggregate("steps", start, fold)
    return df.select("conv_id", out.alias("o")).select("conv_id", "o.stage", "o.unparsed", "o.trail")


def route(stage: Column, has_response: Column, is_success: Column) -> Column:
    """The next node: agent, reporter, end, or an error."""
    done = F.when(~has_response, "reporter").when(is_success.eqNullSafe(F.lit(False)), "agent").otherwise("end")
    return F.when(stage == "MAX_ITERATIONS", "raise:max_iterations").when(stage == "DONE", done).when(stage == "ERROR", "raise:error").when(stage == "FORENSIC_REPORT_FORMULATION", "reporter").otherwise("agent")


#: Sequence numbers of a block.
BLOCK = 1024


def trail(replies: DataFrame, cap: int = 20, block: int = BLOCK) -> DataFrame:
    """The stage after every reply, as rows; a conversation of any length is spread over blocks of its sequence.

    replies: conv_id, seq, found, n, as in walk(). Returns conv_id, seq, i (the reply's number, from 1), stage, unparsed.

    A reply maps the stages to stages: it leaves them, or sends all but MAX_ITERATIONS to one, or all to MAX_ITERATIONS. Maps of these kinds
    are closed under composition: the last that isn't the identity counts, and MAX_ITERATIONS absorbs. So a block is
    a map, a count of replies, one of replies without a marker and the highest count that the cap looks at. Blocks are composed in
    order, and each reply's state is its block's entry state followed by the block's replies up to it.
    """
    most = "MAX_ITERATIONS"
    order = ["seq", "found", "n"]
    rows = replies.select("conv_id", "seq", "found", "n", F.floor(F.col("seq") / block).alias("_block"))
    so_far = Window.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bad = F.when(F.col("found").isNull(), 1).otherwise(0)
    local = rows.withColumns({"_i": F.row_number().over(Window.partitionBy("conv_id", "_block").orderBy(*order)), "_bad": F.sum(bad).over(so_far), "_known": F.last("found", ignorenulls=True).over(so_far), "_stop": F.max(F.col("found").eqNullSafe(most)).over(so_far)})
    local = local.withColumn("_top", F.max(F.col("n") + F.col("_bad")).over(so_far))
    blocks = local.groupBy("conv_id", "_block").agg(F.max("_i").alias("i"), F.max("_bad").alias("bad"), F.max_by("_known", "_i").alias("known"), F.max("_stop").alias("stop"), F.max("_top").alias("top"))
    # a row for each block of a conversation
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    entry = blocks.withColumns({"i0": F.coalesce(F.sum("i").over(before), F.lit(0)), "bad0": F.coalesce(F.sum("bad").over(before), F.lit(0)), "known0": F.last("known", ignorenulls=True).over(before), "stop0": F.coalesce(F.max("stop").over(before), F.lit(False))})
    entry = entry.withColumn("top0", F.max(F.col("bad0") + F.col("top")).over(before)).select("conv_id", "_block", "i0", "bad0", "known0", "stop0", "top0")
    same = local["conv_id"].eqNullSafe(entry["conv_id"]) & local["_block"].eqNullSafe(entry["_block"])
    both = local.join(entry, same).drop(entry["conv_id"]).drop(entry["_block"])
    over = F.col("_stop") | F.col("stop0") | (F.greatest("top0", F.col("bad0") + F.col("_top")) >= 2 * cap)
    stage = F.when(over, most).otherwise(F.coalesce("_known", "known0", F.lit("INITIAL")))
    return both.select("conv_id", "seq", (F.col("i0") + F.col("_i")).cast("long").alias("i"), stage.alias("stage"), (F.col("bad0") + F.col("_bad")).cast("long").alias("unparsed"))


def graph(trail: DataFrame, has_response: Column, is_success: Column) -> DataFrame:
    """How each conversation's graph ends: at the first check that leads to the end or to an error, else open.

    trail: as trail() gives it, with the columns that has_response and is_success need. Returns conv_id, checks (made until then) and outcome.
    """
    node = route(F.col("stage"), has_response, is_success)
    final = (node == "end") | F.startswith(node, F.lit("raise:"))
    ended = F.when(final, F.col("i"))
    return trail.groupBy("conv_id").agg(F.coalesce(F.min(ended), F.max("i")).alias("checks"), F.coalesce(F.min_by(node, ended), F.lit("open")).alias("outcome"))


def after_report(is_success: Column) -> Column:
    """The messages that a report adds."""
    failed = F.array(F.lit("tool:report_conflict_tool"), F.lit("ai:update stage to: forensic_report_formulation"))
    return F.when(F.coalesce(is_success, F.lit(False)), F.array(F.lit("ai:update stage to: done"))).otherwise(failed)


def transitions(df: DataFrame) -> DataFrame:
    """How often each stage follows each, over rows of conv_id, seq, stage."""
    w = Window.partitionBy("conv_id").orderBy("seq")
    pairs = df.withColumn("from_stage", F.coalesce(F.lag("stage").over(w), F.lit("INITIAL")))
    return pairs.groupBy("from_stage", F.col("stage").alias("to_stage")).agg(F.count("*").alias("n"))

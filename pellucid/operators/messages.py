"""Conversations: rows of conv_id, seq, role (human, ai, tool), name, content, reasoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pellucid.functions import text

NUDGE = "Unrecognized stage: "


def latest(df: DataFrame, keep: Column, by: str = "conv_id") -> DataFrame:
    """The content of each conversation's last message that passes."""
    return df.filter(keep).groupBy(by).agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))


def tool_result(content: Column) -> Column:
    """A tool's JSON object as text; other JSON wrapped as value, other text as text, nothing as an empty object."""
    v = F.try_parse_json(content)
    kind = F.schema_of_variant(v)
    return (
        F.when(content.isNull() | (content == ""), "{}")
        .when(v.isNull(), F.to_json(F.struct(content.alias("text"))))
        .when(F.startswith(kind, F.lit("OBJECT")), F.to_json(v))
        .otherwise(F.concat(F.lit('{"value":'), F.to_json(v), F.lit("}")))
    )


def tool_kind(content: Column) -> Column:
    """Which of those four a content is."""
    v = F.try_parse_json(content)
    return F.when(content.isNull() | (content == ""), "empty").when(v.isNull(), "text").when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "object").otherwise("value")


def ordered_distinct(df: DataFrame, *key: str) -> DataFrame:
    """The first message of every key."""
    w = Window.partitionBy(*key).orderBy("seq")
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def history_rows(df: DataFrame, roles: tuple[str, ...] = ("ai", "tool"), nudge: str = NUDGE) -> DataFrame:
    """Messages for the report, rendered as entry: a nudge drops itself and what follows it; human messages, bare "done" markers, other
    roles and empty messages drop; of equal entries the first stays.

    Nudges in a row pair up, so that every second one only serves to be dropped.
    """
    by = Window.partitionBy("conv_id").orderBy("seq")
    is_nudge = F.coalesce(F.startswith("content", F.lit(nudge)), F.lit(False))
    d = df.withColumn("_nudge", is_nudge).withColumn("_run", F.row_number().over(by) - F.sum(F.col("_nudge").cast("int")).over(by))
    run = Window.partitionBy("conv_id", "_run", "_nudge").orderBy("seq")
    d = d.withColumn("_acts", F.col("_nudge") & (F.row_number().over(run) % 2 == 1))
    d = d.withColumn("_skip", F.coalesce(F.lag("_acts").over(by), F.lit(False)) | F.col("_nudge"))
    done = F.coalesce(F.trim(F.lower("content")) == "update stage to: done", F.lit(False))
    empty = (F.coalesce("content", F.lit("")) == "") & (F.coalesce("reasoning", F.lit("")) == "")
    d = d.filter(~F.col("_skip") & (F.col("role") != "human") & ~done & F.col("role").isin(*roles) & ~empty)
    d = d.withColumn("entry", text.history_entry(F.col("role"), F.col("name"), F.col("content"), F.col("reasoning")))
    return ordered_distinct(d.select("conv_id", "seq", "entry"), "conv_id", "entry")


def join_entries(df: DataFrame, sep: str = "\n\n") -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "entry"))), lambda x: x["entry"])
    return df.groupBy("conv_id").agg(F.array_join(parts, sep).alias("history"))


def delete_range(messages: Column, start: int, end: int | None = None) -> Column:
    """An array without the elements from start to end, both included and counted from 0, from the end if negative,
    in either order; an index outside is an error."""
    n = F.size(messages)
    s, e = (F.lit(i) if i >= 0 else n + i for i in (start, start if end is None else end))
    lo, hi = F.least(s, e), F.greatest(s, e)
    cut = F.concat(F.slice(messages, F.lit(1), lo), F.slice(messages, hi + 2, F.greatest(n - hi - 1, F.lit(0))))
    return F.when((lo >= 0) & (hi < n), cut).otherwise(F.raise_error(F.lit("message index out of range")))


def replace_at(messages: Column, index: int, new: Column) -> Column:
    """An array with one element replaced; negative indexes count from the end."""
    return F.transform(messages, lambda x, i: F.when(i == (F.lit(index) if index >= 0 else F.size(messages) + index), new).otherwise(x))


def recent(messages: Column, k: int = 5) -> Column:
    """The last k elements."""
    return F.slice(messages, F.greatest(F.size(messages) - k + 1, F.lit(1)), F.lit(k))


def middle(messages: Column) -> Column:
    """Without the first two elements and the last."""
    return F.slice(messages, F.lit(3), F.greatest(F.size(messages) - 3, F.lit(0)))

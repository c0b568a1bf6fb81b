"""Call telemetry: rows of session_id, ts, kind (llm, tool, error, other) and what the call reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(total: Column, prompt: Column, completion: Column, metadata: Column, usage: Column, chars: Column) -> Column:
    """Tokens of a call: the first count given that isn't 0, else a third of the characters, at least 1; 0 for no output."""
    zero = F.lit(0)
    both = F.coalesce(prompt, zero) + F.coalesce(completion, zero)
    guess = F.when(chars > 0, F.greatest(F.lit(1), F.floor(chars / 3))).otherwise(zero)
    return F.coalesce(F.nullif(total, zero), F.nullif(both, zero), F.nullif(metadata, zero), F.nullif(usage, zero), guess).cast("long")


def rollup(events: DataFrame) -> DataFrame:
    """Counters and times by session. Errors of the call chain are listed but not counted."""
    kind, took = F.col("kind"), F.col("duration")
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return events.groupBy("session_id").agg(
        F.count_if(kind == "llm").alias("llm_calls"),
        F.count_if(kind == "tool").alias("tool_calls"),
        F.round(F.coalesce(F.sum(F.when(kind == "llm", took)), F.lit(0.0)), 4).alias("llm_time"),
        F.round(F.coalesce(F.sum(F.when(kind == "tool", took)), F.lit(0.0)), 4).alias("tool_time"),
        F.sum("tokens").alias("total_tokens"),
        F.count_if(kind == "error_llm").alias("llm_errors"),
        F.count_if(kind == "error_tool").alias("tool_errors"),
        F.count_if(kind.isin("error_llm", "error_tool")).alias("total_errors"),
        F.round(seconds, 3).alias("total_time"),
    )


def spans(events: DataFrame, single_slot: bool = False) -> DataFrame:
    """Pairs start and end events (phase) into calls with seconds.

    By call_id; or, with single_slot, the way of a tracker that remembers only the last start: an end closes
    it, and ends that find none are 0 long.
    """
    at = F.unix_micros("ts")
    if not single_slot:
        calls = events.groupBy("session_id", "call_id").agg(F.first("kind").alias("kind"), F.min(F.when(F.col("phase") == "start", at)).alias("s"), F.max(F.when(F.col("phase") == "end", at)).alias("e"))
        return calls.select("session_id", "call_id", "kind", F.coalesce((F.col("e") - F.col("s")) / 1e6, F.lit(0.0)).alias("seconds"))
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    prior = events.withColumn("_p", F.lag("phase").over(w)).withColumn("_t", F.lag(at).over(w)).filter("phase = 'end'")
    return prior.select("session_id", "call_id", "kind", F.when(F.col("_p") == "start", (at - F.col("_t")) / 1e6).otherwise(0.0).alias("seconds"))


def error_details(events: DataFrame) -> DataFrame:
    """Each session's errors in order."""
    rows = F.sort_array(F.collect_list(F.struct("ts", "event_id", "message")))
    return events.filter("kind like 'error%'").groupBy("session_id").agg(F.transform(rows, lambda x: x["message"]).alias("errors"))

"""Call telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.operators import telemetry as tel
from pellucid.plans.registry import query
from pellucid.plans.views import TELEMETRY, TOKENS, telemetry

_TOKENS = ("total", "prompt", "completion", "metadata", "usage", "chars")


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf).withColumn("tokens", tel.tokens(*[F.col(c) for c in _TOKENS]))


@query(f"""WITH {TELEMETRY} SELECT session_id, count(*) FILTER (kind = 'llm') AS llm_calls, count(*) FILTER (kind = 'tool') AS tool_calls,
  round(COALESCE(sum(duration) FILTER (kind = 'llm'), 0.0), 4) AS llm_time, round(COALESCE(sum(duration) FILTER (kind = 'tool'), 0.0), 4) AS tool_time,
  CAST(sum({TOKENS}) AS BIGINT) AS total_tokens, count(*) FILTER (kind = 'error_llm') AS llm_errors, count(*) FILTER (kind = 'error_tool') AS tool_errors,
  count(*) FILTER (kind IN ('error_llm', 'error_tool')) AS total_errors, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS total_time
FROM telemetry GROUP BY 1""")
def telemetry_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return tel.rollup(_calls(spark, sf))


@query(f"WITH {TELEMETRY} SELECT event_id, CAST({TOKENS} AS BIGINT) AS tokens FROM telemetry")
def token_total(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).select("event_id", "tokens")


@query(f"WITH {TELEMETRY} SELECT session_id, string_agg(message, '|' ORDER BY ts, event_id) AS errors FROM telemetry WHERE kind LIKE 'error%' GROUP BY 1")
def error_details(spark: SparkSession, sf: str) -> DataFrame:
    return tel.error_details(telemetry(spark, sf)).select("session_id", F.array_join("errors", "|").alias("errors"))


@query(f"WITH {TELEMETRY} SELECT session_id, count(*) FILTER (kind = 'llm') AS llm_calls FROM telemetry GROUP BY 1")
def llm_calls(spark: SparkSession, sf: str) -> DataFrame:
    return tel.rollup(_calls(spark, sf)).select("session_id", "llm_calls")


@query(f"WITH {TELEMETRY} SELECT session_id, count(*) FILTER (kind = 'tool') AS tool_calls FROM telemetry GROUP BY 1")
def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    return tel.rollup(_calls(spark, sf)).select("session_id", "tool_calls")


@query(f"WITH {TELEMETRY} SELECT session_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS total_time FROM telemetry GROUP BY 1")
def total_time(spark: SparkSession, sf: str) -> DataFrame:
    return tel.rollup(_calls(spark, sf)).select("session_id", "total_time")


@query(f"WITH {TELEMETRY} SELECT kind, count(*) AS n FROM telemetry WHERE kind LIKE 'error%' GROUP BY 1")
def error_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf).filter("kind like 'error%'").groupBy("kind").agg(F.count("*").alias("n"))


_SPANS = """spans AS (SELECT user_id AS session_id, event_id // 2 AS call_id, event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS phase FROM events)"""


def _phases(spark: SparkSession, sf: str) -> DataFrame:
    """Events in pairs of start and end."""
    t = telemetry(spark, sf)
    return t.select("session_id", F.floor(F.col("event_id") / 2).alias("call_id"), "event_id", "ts", F.lit("llm").alias("kind"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("phase"))


@query(f"""WITH {_SPANS} SELECT session_id, call_id, round(COALESCE((epoch_us(max(ts) FILTER (phase = 'end')) - epoch_us(min(ts) FILTER (phase = 'start'))) / 1e6, 0.0), 3) AS seconds FROM spans GROUP BY 1, 2""")
def llm_time(spark: SparkSession, sf: str) -> DataFrame:
    """Calls paired by their id."""
    return tel.spans(_phases(spark, sf)).select("session_id", "call_id", F.round("seconds", 3).alias("seconds"))


@query(f"""WITH {_SPANS}, p AS (SELECT *, lag(phase) OVER w AS lp, lag(ts) OVER w AS lt FROM spans WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
SELECT session_id, call_id, round(CASE WHEN lp = 'start' THEN (epoch_us(ts) - epoch_us(lt)) / 1e6 ELSE 0.0 END, 3) AS seconds FROM p WHERE phase = 'end'""")
def tool_time(spark: SparkSession, sf: str) -> DataFrame:
    """Calls paired by a tracker with one slot."""
    return tel.spans(_phases(spark, sf), single_slot=True).select("session_id", "call_id", F.round("seconds", 3).alias("seconds"))

"""The driver's tables as the engine's relations, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as images: image_path, gt_label, dataset_name, doc_id, verdict."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id")
    path = F.concat(F.lit("images/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    return rows.select(path.alias("image_path"), F.col("quality").alias("gt_label"), F.col("source").alias("dataset_name"), "doc_id", F.col("toxic").alias("verdict"))


MANIFEST = """manifest AS (
  SELECT 'images/' || d.source || '/' || d.doc_id || '.jpg' AS image_path, l.quality AS gt_label, d.source AS dataset_name, d.doc_id, l.toxic AS verdict
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_path, finally_result (null for each seventh id, 2 for each eleventh), gt_label, is_success."""
    m = manifest(spark, sf_dir)
    result = F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("int")).when(F.col("doc_id") % 11 == 0, 2).otherwise(F.col("verdict"))
    success = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("boolean")).otherwise(F.col("doc_id") % 3 != 0)
    return m.select("image_path", result.alias("finally_result"), "gt_label", "dataset_name", success.alias("is_success"), "doc_id")


VERDICTS = (
    MANIFEST
    + """, verdicts AS (
  SELECT image_path, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 2 ELSE verdict END AS finally_result, gt_label, dataset_name,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 3 <> 0 END AS is_success, doc_id FROM manifest)"""
)

#: Markers that messages get, by (conv_id + turn) modulo their number.
MARKERS = (
    "",
    " update stage to: semantic_context_extraction",
    " Update Stage To: 'evidence_adjudication'",
    " update stage to: [done]",
    " update stage to: no_such_stage",
    " update stage to: initial, then update stage to: forensic_report_formulation",
    " update stage to: done",
    "",
    " update stage to: max_iterations",
)
TOOLS = ("semantic_context_extraction", "expert_results", "report_conflict_tool")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: conv_id, seq, role (human, ai, tool), name, content, reasoning.

    Each thirteenth message is nothing but a "done" marker, each seventeenth a nudge, each nineteenth empty;
    tools answer in JSON objects, numbers or text.
    """
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") + F.col("turn")
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKERS]), (n % len(MARKERS)).cast("int") + 1)
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise("tool")
    name = F.when(role == "tool", F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (n % len(TOOLS)).cast("int") + 1))
    answer = F.when(n % 4 == 0, F.concat(F.lit('{"semantic_result": '), (n % 2).cast("string"), F.lit("}"))).when(n % 4 == 1, (n % 10).cast("string")).when(n % 4 == 2, F.lit("")).otherwise(F.col("text"))
    content = (
        F.when(n % 13 == 0, "  Update stage to: DONE ")
        .when(n % 17 == 0, F.concat(F.lit("Unrecognized stage: "), F.col("text")))
        .when(n % 19 == 0, "")
        .when(role == "tool", answer)
        .otherwise(F.concat("text", mark))
    )
    reasoning = F.when((F.col("conv_id") * 7 + F.col("turn")) % 5 == 0, "so update stage to: error")
    return c.select("conv_id", F.col("turn").alias("seq"), role.alias("role"), name.alias("name"), content.alias("content"), reasoning.alias("reasoning"))


def _pick(values: tuple[str, ...], n: str) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[CAST({n} % {len(values)} AS INTEGER) + 1]"


MESSAGES = f"""raw AS (
  SELECT *, conv_id + turn AS n, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE 'tool' END AS r FROM conversations),
messages AS (
  SELECT conv_id, turn AS seq, r AS role, CASE WHEN r = 'tool' THEN {_pick(TOOLS, "n")} END AS name,
    CASE WHEN n % 13 = 0 THEN '  Update stage to: DONE ' WHEN n % 17 = 0 THEN 'Unrecognized stage: ' || text WHEN n % 19 = 0 THEN ''
      WHEN r = 'tool' THEN CASE WHEN n % 4 = 0 THEN '{{"semantic_result": ' || (n % 2) || '}}' WHEN n % 4 = 1 THEN CAST(n % 10 AS VARCHAR) WHEN n % 4 = 2 THEN '' ELSE text END
      ELSE text || {_pick(MARKERS, "n")} END AS content,
    CASE WHEN (conv_id * 7 + turn) % 5 = 0 THEN 'so update stage to: error' END AS reasoning
  FROM raw)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: session_id, event_id, ts, kind, duration, tokens' sources, message."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "llm").when(F.col("event_type") == "view", "tool").when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "error_llm").otherwise("error_tool")).otherwise("other")
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"),
        F.col("value").alias("duration"),
        F.when(i % 3 == 0, k * 10).alias("total"),
        F.when(i % 3 == 1, k).alias("prompt"),
        F.when(i % 3 == 1, k * 2).alias("completion"),
        F.when(i % 5 == 0, k * 3).alias("metadata"),
        F.when(i % 7 == 0, k * 4).alias("usage"),
        F.length("props").alias("chars"),
        F.concat(F.lit("event "), i.cast("string")).alias("message"),
    )


TELEMETRY = """telemetry AS (
  SELECT user_id AS session_id, event_id, ts,
    CASE event_type WHEN 'click' THEN 'llm' WHEN 'view' THEN 'tool' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'error_llm' ELSE 'error_tool' END ELSE 'other' END AS kind,
    value AS duration, k, CASE WHEN event_id % 3 = 0 THEN k * 10 END AS total, CASE WHEN event_id % 3 = 1 THEN k END AS prompt, CASE WHEN event_id % 3 = 1 THEN k * 2 END AS completion,
    CASE WHEN event_id % 5 = 0 THEN k * 3 END AS metadata, CASE WHEN event_id % 7 = 0 THEN k * 4 END AS usage, length(props) AS chars, 'event ' || event_id AS message
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
TOKENS = "COALESCE(NULLIF(total, 0), NULLIF(COALESCE(prompt, 0) + COALESCE(completion, 0), 0), NULLIF(metadata, 0), NULLIF(usage, 0), CASE WHEN chars > 0 THEN GREATEST(1, chars // 3) ELSE 0 END)"

SIDE = 8


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 as 8 x 8 gray planes: vec_id, g (array of 0 to 255), label."""
    g = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1.0) * 127.5).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", g.alias("g"), "label")


PIXELS = """pixels AS (
  SELECT vec_id, label, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1.0) * 127.5) AS BIGINT) AS g
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""

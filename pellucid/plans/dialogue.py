"""Messages, model replies and the stage machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pellucid.functions import text
from pellucid.functions.paths import strip
from pellucid.operators import messages as msg
from pellucid.operators import stages
from pellucid.plans.registry import query
from pellucid.plans.views import MESSAGES, messages, table
from pellucid.sources import containers
from pellucid.sources.files import new_folder

_IS_TOOL = "role = 'tool' and name = 'semantic_context_extraction'"
_HAS_AI = "role = 'ai' and content <> ''"
_STAGES = "(" + ", ".join(f"'{s}'" for s in stages.STAGES) + ")"

_KIND = "CASE WHEN content IS NULL OR content = '' THEN 'empty' WHEN NOT json_valid(content) THEN 'text' WHEN json_type(content) = 'OBJECT' THEN 'object' ELSE 'value' END"


@query(f"WITH {MESSAGES}, l AS (SELECT conv_id, max(seq) AS seq, arg_max(content, seq) AS content FROM messages WHERE role = 'tool' AND name = 'semantic_context_extraction' GROUP BY 1) SELECT conv_id, {_KIND} AS kind, CASE {_KIND} WHEN 'empty' THEN '{{}}' WHEN 'object' THEN replace(content, ': ', ':') WHEN 'value' THEN '{{\"value\":' || content || '}}' ELSE '{{\"text\":' || CAST(to_json(content) AS VARCHAR) || '}}' END AS result FROM l")
def tool_result(spark: SparkSession, sf: str) -> DataFrame:
    """The latest answer of a tool in every conversation that has one."""
    last = msg.latest(messages(spark, sf), F.expr(_IS_TOOL))
    return last.select("conv_id", msg.tool_kind(F.col("content")).alias("kind"), msg.tool_result(F.col("content")).alias("result"))


@query(f"WITH {MESSAGES} SELECT conv_id, max(seq) AS seq, arg_max(content, seq) AS content FROM messages WHERE role = 'tool' AND name = 'semantic_context_extraction' GROUP BY 1")
def latest_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return msg.latest(messages(spark, sf), F.expr(_IS_TOOL))


@query(f"WITH {MESSAGES} SELECT conv_id, max(seq) AS seq, arg_max(content, seq) AS content FROM messages WHERE role = 'ai' AND content <> '' GROUP BY 1")
def latest_ai(spark: SparkSession, sf: str) -> DataFrame:
    return msg.latest(messages(spark, sf), F.expr(_HAS_AI))


_FOUND = f"""replies AS (
  SELECT conv_id, seq, upper(list_extract(regexp_extract_all(lower(COALESCE(reasoning, '') || chr(10) || content), '{stages.MARKER.replace("'", "''")}', 1), -1)) AS name
  FROM messages WHERE role = 'ai' AND content <> ''),
found AS (SELECT conv_id, seq, CASE WHEN name IN {_STAGES} THEN name END AS stage FROM replies)"""


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).filter(_HAS_AI).select("conv_id", "seq", stages.marker(F.col("content"), F.col("reasoning")).alias("stage"))


@query(f"WITH {MESSAGES}, {_FOUND} SELECT conv_id, seq, stage FROM found")
def stage_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf)


@query(f"WITH {MESSAGES}, {_FOUND} SELECT conv_id, seq, stage FROM found WHERE stage IN {_STAGES}")
def stage_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Replies whose stage is in the table of stages."""
    dim = spark.createDataFrame([(s,) for s in stages.STAGES], "stage string")
    return _replies(spark, sf).join(F.broadcast(dim), "stage", "left_semi").select("conv_id", "seq", "stage")


_CAP = 4
_STEP = f"""steps AS (
  SELECT conv_id, seq, stage, row_number() OVER w AS i, sum(CASE WHEN stage IS NULL THEN 1 ELSE 0 END) OVER w AS bad,
    last_value(stage IGNORE NULLS) OVER w AS known, seq + 1 AS n
  FROM found WINDOW w AS (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
capped AS (SELECT *, bool_or((n + bad) // 2 >= {_CAP} OR COALESCE(stage = 'MAX_ITERATIONS', FALSE)) OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS over FROM steps),
trail AS (SELECT conv_id, seq, CASE WHEN over THEN 'MAX_ITERATIONS' ELSE COALESCE(known, 'INITIAL') END AS stage, bad FROM capped)"""


def _walked(spark: SparkSession, sf: str) -> DataFrame:
    r = _replies(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("stage").alias("found"), (F.col("seq") + 1).alias("n")))).alias("steps"))
    return stages.walk(r, _CAP)


@query(f"WITH {MESSAGES}, {_FOUND}, {_STEP} SELECT conv_id, arg_max(stage, seq) AS stage, CAST(max(bad) AS INTEGER) AS unparsed, string_agg(stage, '>' ORDER BY seq) AS trail FROM trail GROUP BY 1")
def stage_step(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's checks, with a cap of four iterations."""
    return _walked(spark, sf).select("conv_id", "stage", "unparsed", F.array_join("trail", ">").alias("trail"))


def _trail(spark: SparkSession, sf: str) -> DataFrame:
    replies = _replies(spark, sf).select("conv_id", "seq", F.col("stage").alias("found"), (F.col("seq") + 1).alias("n"))
    return stages.trail(replies, _CAP, 4)


@query(f"WITH {MESSAGES}, {_FOUND}, {_STEP} SELECT conv_id, seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS i, stage, bad::BIGINT AS unparsed FROM trail")
def stage_trail(spark: SparkSession, sf: str) -> DataFrame:
    """The stage after every reply, as rows, by blocks of four sequence numbers."""
    return _trail(spark, sf)


_ROUTE = "CASE stage WHEN 'MAX_ITERATIONS' THEN 'raise:max_iterations' WHEN 'DONE' THEN CASE WHEN conv_id % 3 = 0 THEN 'reporter' WHEN conv_id % 3 = 1 THEN 'agent' ELSE 'end' END WHEN 'ERROR' THEN 'raise:error' WHEN 'FORENSIC_REPORT_FORMULATION' THEN 'reporter' ELSE 'agent' END"


@query(f"WITH {MESSAGES}, {_FOUND} SELECT conv_id, seq, {_ROUTE} AS node FROM found WHERE stage IS NOT NULL")
def stage_route(spark: SparkSession, sf: str) -> DataFrame:
    """Where each parsed stage leads; a third of the conversations have no report, a third a failed one."""
    i = F.col("conv_id") % 3
    return _replies(spark, sf).filter("stage is not null").select("conv_id", "seq", stages.route(F.col("stage"), i != 0, i != 1).alias("node"))


@query(f"""WITH {MESSAGES}, {_FOUND}, {_STEP}, n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS i, {_ROUTE} AS node FROM trail),
f AS (SELECT conv_id, count(*) AS total, min(i) FILTER (node = 'end' OR node LIKE 'raise:%') AS ended, arg_min(node, i) FILTER (node = 'end' OR node LIKE 'raise:%') AS node FROM n GROUP BY 1)
SELECT conv_id, COALESCE(ended, total) AS checks, COALESCE(node, 'open') AS outcome FROM f""")
def graph(spark: SparkSession, sf: str) -> DataFrame:
    """Where each conversation's graph ends."""
    i = F.col("conv_id") % 3
    return stages.graph(_trail(spark, sf), i != 0, i != 1)


@query("SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'ai:update stage to: done' ELSE 'tool:report_conflict_tool|ai:update stage to: forensic_report_formulation' END AS added FROM conversations")
def reporter_append(spark: SparkSession, sf: str) -> DataFrame:
    success = F.when(F.col("conv_id") % 3 == 0, True).when(F.col("conv_id") % 3 == 1, False)
    return table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.array_join(stages.after_report(success), "|").alias("added"))


@query(f"WITH {MESSAGES}, {_FOUND}, p AS (SELECT stage, COALESCE(lag(stage) OVER (PARTITION BY conv_id ORDER BY seq), 'INITIAL') AS prev FROM found WHERE stage IS NOT NULL) SELECT prev AS from_stage, stage AS to_stage, count(*) AS n FROM p GROUP BY 1, 2")
def transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stages.transitions(_replies(spark, sf).filter("stage is not null"))


_ENTRY = "'[' || CASE role WHEN 'ai' THEN 'AIMessage' WHEN 'tool' THEN 'ToolMessage' || COALESCE(':' || name, '') ELSE 'HumanMessage' END || ']:' || COALESCE(content, 'None') || COALESCE(chr(10) || '[Reasoning]: ' || NULLIF(reasoning, ''), '')"
_KEPT = f"""s AS (SELECT *, COALESCE(starts_with(content, 'Unrecognized stage: '), FALSE) AS nudge FROM messages),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - sum(CASE WHEN nudge THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM s),
a AS (SELECT *, nudge AND row_number() OVER (PARTITION BY conv_id, run, nudge ORDER BY seq) % 2 = 1 AS acts FROM r),
k AS (SELECT *, nudge OR COALESCE(lag(acts) OVER (PARTITION BY conv_id ORDER BY seq), FALSE) AS skip FROM a),
e AS (SELECT conv_id, seq, {_ENTRY} AS entry FROM k WHERE NOT skip AND role IN ('ai', 'tool') AND NOT COALESCE(trim(lower(content)) = 'update stage to: done', FALSE) AND NOT (COALESCE(content, '') = '' AND COALESCE(reasoning, '') = '')),
h AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id, entry ORDER BY seq) = 1)"""


@query(f"WITH {MESSAGES}, {_KEPT} SELECT conv_id, string_agg(entry, chr(10) || chr(10) ORDER BY seq) AS history FROM h GROUP BY 1")
def history_extract(spark: SparkSession, sf: str) -> DataFrame:
    return msg.join_entries(msg.history_rows(messages(spark, sf)))


@query(f"WITH {MESSAGES}, {_KEPT} SELECT conv_id, seq FROM h")
def history_filter(spark: SparkSession, sf: str) -> DataFrame:
    return msg.history_rows(messages(spark, sf)).select("conv_id", "seq")


@query(f"WITH {MESSAGES} SELECT conv_id, seq, {_ENTRY} AS entry FROM messages")
def history_text(spark: SparkSession, sf: str) -> DataFrame:
    entry = text.history_entry(F.col("role"), F.col("name"), F.col("content"), F.col("reasoning"))
    return messages(spark, sf).select("conv_id", "seq", entry.alias("entry"))


@query(f"WITH {MESSAGES} SELECT conv_id, role, string_agg(content, chr(10) || chr(10) ORDER BY seq) AS history FROM messages WHERE content <> '' GROUP BY 1, 2")
def list_concat_text(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"])
    return messages(spark, sf).filter("content <> ''").groupBy("conv_id", "role").agg(F.array_join(parts, "\n\n").alias("history"))


@query(f"WITH {MESSAGES} SELECT conv_id, seq, role FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY seq) = 1")
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The first message of every role."""
    return msg.ordered_distinct(messages(spark, sf), "conv_id", "role").select("conv_id", "seq", "role")


@query("SELECT conv_id, turn AS seq, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) // 2 AS iteration FROM conversations")
def iteration_no(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return messages(spark, sf).select("conv_id", "seq", F.floor(F.count("*").over(w) / 2).alias("iteration"))


@query(f"WITH {MESSAGES} SELECT conv_id, seq FROM messages WHERE content IS NOT NULL AND content <> ''")
def nonempty_content(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).filter("content is not null and content <> ''").select("conv_id", "seq")


_URL = "'{\"type\":\"image_url\",\"url\":\"' || CASE WHEN seq % 2 = 0 THEN 'data:image/png;base64,QUJD' ELSE 'https://x.org/a.png' END || '\"}'"
_SAFE = _URL.replace("data:image/png;base64,QUJD", text.REDACTED)


def _dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Messages dumped as JSON text, each with an image entry."""
    url = F.when(F.col("seq") % 2 == 0, "data:image/png;base64,QUJD").otherwise("https://x.org/a.png")
    dump = F.concat(F.lit('{"type":"image_url","url":"'), url, F.lit('"}'))
    return messages(spark, sf).select("conv_id", "seq", "content", dump.alias("dump"))


@query(f"WITH {MESSAGES} SELECT conv_id, seq, {_SAFE} AS dump FROM messages")
def redact(spark: SparkSession, sf: str) -> DataFrame:
    return _dumps(spark, sf).select("conv_id", "seq", text.redact(F.col("dump")).alias("dump"))


#: A dump with entries in objects and arrays, beside keys and texts that only look like them: what comes before the key, between key and value, and after.
_PIECES = ('{"role": "user", "content": [{"type": "text", "text": "a, \\"url\\""}, {"type": "image_url", "image_url": {"', '" : "', '", "detail": [1.50, null]}}, {"x\\"url":"data:image/a","urls":"data:image/b","said":"{\\"url\\":\\"data:image/c\\"}"}]}')
_KEYS, _VALUES = ("url", "\\u0075r\\u006C", "URL"), ("data:image/png;base64,QUJD", "https://x.org/a.png", "\\u0064ata:image\\/gif;base64,\\\\QQ", 'data:image/\\"quoted\\"')


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CHANGED = f"""CASE WHEN seq % 3 < 2 AND seq % 4 <> 1 THEN {_quoted(text.REDACTED)} ELSE [{", ".join(map(_quoted, _VALUES))}][seq % 4 + 1] END"""


@query(f"WITH {MESSAGES} SELECT conv_id, seq, {_quoted(_PIECES[0])} || [{', '.join(map(_quoted, _KEYS))}][seq % 3 + 1] || {_quoted(_PIECES[1])} || {_CHANGED} || {_quoted(_PIECES[2])} AS dump FROM messages")
def redact_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Dumps with entries at any depth, and keys and values with escapes; all else stays byte for byte."""
    of = lambda words: F.get(F.array(*[F.lit(w) for w in words]), (F.col("seq") % len(words)).cast("int"))
    dump = F.concat(F.lit(_PIECES[0]), of(_KEYS), F.lit(_PIECES[1]), of(_VALUES), F.lit(_PIECES[2]))
    return messages(spark, sf).select("conv_id", "seq", text.redact(dump).alias("dump"))


_DETAIL = f"WITH {MESSAGES} SELECT conv_id, count(*) AS n, '[' || string_agg({_SAFE}, ',' ORDER BY seq) || ']' AS detail FROM messages WHERE content <> '' GROUP BY 1"


@query(_DETAIL)
def detail_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's redacted dump, empty messages left out."""
    d = _dumps(spark, sf).filter("content <> ''").withColumn("dump", text.redact(F.col("dump")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "dump"))), lambda x: x["dump"])
    return d.groupBy("conv_id").agg(F.count("*").alias("n"), F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("detail"))


@query(_DETAIL.replace("conv_id, count(*)", "md5(CAST(conv_id AS VARCHAR)) || '.json' AS result_id, count(*)").replace("GROUP BY 1", "GROUP BY conv_id"))
def detail_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The details of all conversations, written in two appends of containers and read back."""
    folder = new_folder(spark)
    rows = _details(spark, sf)
    for part in (0, 1):
        containers.write(rows.filter(F.crc32("name") % 2 == part), folder, 1 << 16)
    return _opened(containers.read(spark, folder))


@query(_DETAIL.replace("conv_id, count(*)", "md5(CAST(conv_id AS VARCHAR)) || '.json' AS result_id, count(*)").replace("WHERE content <> ''", "WHERE content <> '' AND conv_id % 10 = 0").replace("GROUP BY 1", "GROUP BY conv_id"))
def detail_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Some conversations' details, each one range of a container."""
    folder = new_folder(spark)
    containers.write(_details(spark, sf), folder)
    wanted = table(spark, sf, "conversations").filter("conv_id % 10 = 0").select(F.concat(F.md5(F.col("conv_id").cast("string")), F.lit(".json")).alias("name"))
    return _opened(containers.lookup(spark, folder, wanted))


def _details(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.md5(F.col("conv_id").cast("string")), F.lit(".json"))
    return detail_messages(spark, sf).select(name.alias("name"), F.encode(F.to_json(F.struct("n", "detail")), "UTF-8").alias("content"))


def _opened(found: DataFrame) -> DataFrame:
    return found.select(F.col("name").alias("result_id"), F.from_json(F.decode("content", "UTF-8"), "n long, detail string").alias("d")).select("result_id", "d.*")


@query("SELECT doc_id, CASE WHEN length(text) > 4096 THEN left(text, 4096) || '...' ELSE text END AS text FROM documents")
def truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text")).alias("text"))


@query("""SELECT conv_id, turn, replace(replace('“' || text || '”', '“', '"'), '”', '"') AS text FROM conversations""")
def quote_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", text.straight_quotes(F.concat(F.lit("“"), "text", F.lit("”"))).alias("text"))


_FENCED = "CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN chr(10) || props || '  ' WHEN 2 THEN '```json' || chr(10) || '{\"k\": ' || '```' ELSE event_type END"


def _fenced(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id") % 4
    s = (
        F.when(i == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(i == 1, F.concat(F.lit("\n"), "props", F.lit("  ")))
        .when(i == 2, F.lit('```json\n{"k": ```'))
        .otherwise(F.col("event_type"))
    )
    return table(spark, sf, "events").select("event_id", s.alias("reply"))


_STRIPPED = f"regexp_replace(regexp_replace(replace(replace({_FENCED}, '```json' || chr(10), ''), '```', ''), '^\\s+', ''), '\\s+$', '')"


@query(f"SELECT event_id, {_STRIPPED} AS reply FROM events")
def fence_strip(spark: SparkSession, sf: str) -> DataFrame:
    return _fenced(spark, sf).select("event_id", text.strip_fences(F.col("reply")).alias("reply"))


@query(f"SELECT event_id, json_valid({_STRIPPED}) AS is_json, CASE WHEN json_valid({_STRIPPED}) THEN CAST(json_extract_string({_STRIPPED}, '$.k') AS BIGINT) END AS k FROM events")
def json_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a reply is JSON once its fences are gone, and a field of it."""
    v = F.try_parse_json(text.strip_fences(F.col("reply")))
    return _fenced(spark, sf).select("event_id", v.isNotNull().alias("is_json"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, COALESCE(CAST(json_extract_string(props, '$.a.b') AS BIGINT), -1) AS missing FROM events")
def map_get_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted keys, with a default for those that aren't there."""
    v = F.parse_json("props")
    return table(spark, sf, "events").select("event_id", F.variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(F.variant_get(v, "$.a.b", "bigint"), F.lit(-1)).alias("missing"))


@query("SELECT doc_id, quality + toxic AS result, (quality + toxic) BETWEEN 0 AND 1 AS valid FROM labels")
def verdict_validate(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("quality") + F.col("toxic")
    return table(spark, sf, "labels").select("doc_id", r.alias("result"), r.between(0, 1).alias("valid"))


_TURNS = "SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY 1"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))


@query(f"SELECT conv_id, array_to_string(list_concat(t[1:len(t) - 2], t[len(t):]), ',') AS kept FROM ({_TURNS}) WHERE len(t) >= 2")
def history_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations without their last message but one."""
    return _turns(spark, sf).filter(F.size("t") >= 2).select("conv_id", F.array_join(msg.delete_range(F.col("t"), -2), ",").alias("kept"))


@query(f"SELECT conv_id, array_to_string(list_concat([-1], t[2:]), ',') AS changed FROM ({_TURNS})")
def history_modify(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with their first message replaced."""
    return _turns(spark, sf).select("conv_id", F.array_join(msg.replace_at(F.col("t"), 0, F.lit(-1).cast("long")), ",").alias("changed"))


@query(f"SELECT conv_id, array_to_string(t[greatest(len(t) - 4, 1):], ',') AS recent FROM ({_TURNS})")
def recent_k(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", F.array_join(msg.recent(F.col("t")), ",").alias("recent"))


@query(f"SELECT conv_id, COALESCE(array_to_string(t[3:len(t) - 1], ','), '') AS middle FROM ({_TURNS})")
def history_slice(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", F.array_join(msg.middle(F.col("t")), ",").alias("middle"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a,role,b_2' WHEN 1 THEN '' ELSE 'v' || doc_id || ',source' END AS vars FROM documents WHERE text IS NOT NULL")
def template_vars(spark: SparkSession, sf: str) -> DataFrame:
    """The variables of prompt templates with a document in them."""
    words = F.regexp_replace("text", r"[{}]", "")
    full = F.concat(F.lit("You are {a}. {role.name} "), words, F.lit(" {b_2[0]} {a}"))
    named = F.concat(F.lit("{v"), F.col("doc_id").cast("string"), F.lit("} "), words, F.lit(" {9bad} {source[0]}"))
    template = F.when(F.col("doc_id") % 3 == 0, full).when(F.col("doc_id") % 3 == 1, words).otherwise(named)
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.array_join(text.template_variables(template), ",").alias("vars"))


@query("SELECT doc_id, list_extract(string_split(CASE WHEN doc_id % 2 = 0 THEN 'head ### system ###' || text ELSE text END, '###'), -1) AS section FROM documents")
def prompt_section(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("head ### system ###"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.last_section(t).alias("section"))


@query("SELECT doc_id, array_to_string(list_filter([source, ' ', '', chr(9), lang], lambda x: regexp_replace(x, '\\s', '', 'g') <> ''), '|') AS kept FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def blank_items(spark: SparkSession, sf: str) -> DataFrame:
    """Lists without their blank items."""
    d = table(spark, sf, "documents").filter("lang is not null and source is not null")
    items = F.array("source", F.lit(" "), F.lit(""), F.lit("\t"), "lang")
    return d.select("doc_id", F.array_join(F.filter(items, lambda x: strip(x) != ""), "|").alias("kept"))


@query("""SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"k":' || json_extract_string(props, '$.k') END || '}' AS doc FROM events""")
def json_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON; a number that isn't one goes."""
    k = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.get_json_object("props", "$.k").cast("double"))
    clean = F.when(~F.isnan(k), k.cast("long"))
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), clean.alias("k"))).alias("doc"))

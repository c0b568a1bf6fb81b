import json

import pytest
from pyspark.sql import functions as F

from pellucid import config
from pellucid.functions import text
from pellucid.operators import messages, reasoner, stages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tool_result(spark):
    cases = {'{"semantic_result": 1}': {"semantic_result": 1}, "": {}, "[1]": {"value": [1]}, "7": {"value": 7}, "no json": {"text": "no json"}}
    for given, want in cases.items():
        assert json.loads(one(spark, messages.tool_result(F.lit(given)))) == want
    assert one(spark, messages.tool_result(F.lit(None).cast("string"))) == "{}"


def test_markers(spark):
    cases = {"update stage to: done, update stage to: 'error'": "ERROR", "update stage to: [done]": None, "Update Stage To: nothing": None, "": None, "update stage to: max_iterations_reached": None, "update stage to: MAX_ITERATIONS": "MAX_ITERATIONS"}
    for given, want in cases.items():
        assert one(spark, stages.marker(F.lit(given), F.lit(None).cast("string"))) == want
    assert one(spark, stages.marker(F.lit("hm"), F.lit("update stage to: done"))) == "DONE"


def test_history(spark):
    rows = [
        (1, 0, "human", None, "question", None),
        (1, 1, "ai", None, "look", "thought"),
        (1, 2, "tool", "probe", "7", None),
        (1, 3, "ai", None, "look", "thought"),
        (1, 4, "ai", None, " Update stage to: done", None),
        (1, 5, "ai", None, "Unrecognized stage: x", None),
        (1, 6, "ai", None, "dropped with it", None),
        (1, 7, "ai", None, "", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, seq long, role string, name string, content string, reasoning string")
    got = messages.join_entries(messages.history_rows(df)).first().history
    assert got == "[AIMessage]:look\n[Reasoning]: thought\n\n[ToolMessage:probe]:7"


def test_delete_range(spark):
    a = F.array(*[F.lit(i) for i in range(5)])
    for (s, e), want in {(1, None): [0, 2, 3, 4], (-1, None): [0, 1, 2, 3], (3, 1): [0, 4], (0, -1): []}.items():
        assert one(spark, messages.delete_range(a, s, e)) == want
    with pytest.raises(Exception, match="out of range"):
        one(spark, messages.delete_range(a, 5))


def test_text(spark):
    assert one(spark, text.strip_fences(F.lit(' ```json\n{"a": 1}\n``` '))) == '{"a": 1}'
    assert one(spark, text.template_variables(F.lit("{a} {b.c} {a} {d[0]}"))) == ["a", "b", "d"]
    assert one(spark, text.truncate(F.lit("x" * 5000))) == "x" * 4096 + "..."
    assert text.REDACTED in one(spark, text.redact(F.lit('{"url": "data:image/png;base64,AAA", "b": 1}')))


def test_reasoner(spark):
    replies = iter(["nonsense", '```json\n{"observations": "", "detected_anomalies": "", "limitations": "", "pred_label": 3}```', '{"observations": "o", "detected_anomalies": "", "limitations": "", "pred_label": 1}'])
    got, error, tries = reasoner.ask(lambda p: next(replies), "q")
    assert got["pred_label"] == 1 and error is None and tries == 3
    got, error, tries = reasoner.ask(lambda p: "[]", "q")
    assert got is None and "object" in error and tries == 3

    def broken():
        def reply(p):
            raise OSError("no service")

        return reply

    df = spark.createDataFrame([("a", "x"), ("b", None)], "image_path string, prompt string")
    assert [r.error for r in reasoner.profiles(df, broken).collect()] == ["OSError: no service"] * 2
    assert sorted(r.pred_label for r in reasoner.profiles(df).collect()) == [0, 1]


def test_plugins():
    from pellucid.operators import plugins

    tools = plugins.default_tools(lambda path: {"semantic_result": 1})
    assert list(tools.enabled()) == ["semantic_context_extraction"] and tools.enabled({"semantic_context_extraction": False}) == {}
    assert tools.items["semantic_context_extraction"].execute("a.png") == {"semantic_result": 1}
    with pytest.raises(ValueError):
        tools.register("semantic_context_extraction", None)
    assert "fft" in plugins.default_features().enabled({"lbp": False})


def test_config(tmp_path):
    c = config.Config({"a": {"b": 1}})
    c.set("a.c.d", 2)
    assert c.get("a.c.d") == 2 and c.get("a.b.x", 9) == 9 and c.section("a")["b"] == 1
    c.save(str(tmp_path / "c.yaml"))
    assert config.Config.load(str(tmp_path / "c.yaml")).values == c.values
    with pytest.raises(ValueError):
        config.feature_settings({"dct_block": 5})

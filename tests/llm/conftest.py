import pytest

pytest.importorskip("pellucid.llm")

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows; columns that clash with the operators' own."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DDL).repartition(3)
        if extra:
            for c in ("h", "th", "fp", "key", "size", "row", "part", "pos", "lab", "score", "bucket", "queue", "media"):
                df = df.selectExpr("*", f"'clash' as {c}")
        return df

    return make


@pytest.fixture()
def scratch(spark):
    from pellucid.llm.common import Scratch

    return Scratch(spark)

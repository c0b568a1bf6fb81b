import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from compare import SF, assert_same, connect  # noqa: E402

from pellucid.llm import queries, sql  # noqa: E402


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_oracle(spark, name):
    assert_same(queries.QUERIES[name](spark, SF).toPandas(), connect().execute(sql.ORACLE[name]).df())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != names[-1]:
            assert docs.columns == columns
        counts.append(docs.count())
        if name == "near_dedup":
            assert docs.select("doc_id").distinct().count() == counts[-1] < counts[-2]
    tokens = docs.groupBy("sequence_id").sum("length").collect()
    assert sorted(t[1] for t in tokens)[1:] == [1024] * (len(tokens) - 1)
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]

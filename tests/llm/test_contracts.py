"""The registered queries' columns over odd tables, and the pipeline's stages over them."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from texts import ODD, text

from pellucid.llm import queries

WANT = {
    "op1_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_license_scan": ["doc_id", "template_id", "matched", "total", "containment"],
    "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_exact_top_k": ["query_id", "rank", "vec_id", "score"],
    "op7_token_counts": ["doc_id", "n_words", "n_pieces"],
    "op8_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op9_substring_dedup": ["doc_id", "ref_doc_id", "start_word", "n_words"],
    "op10_token_ids": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op11_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op12_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
}
BY_ROW = {"op1_simhash_near_dedup", "op2_language_id", "op5_mixing", "op7_token_counts", "op8_media_columns", "op10_token_ids", "op13_line_dedup"}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Tables with odd rows and clashing columns, and empty ones."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, text(40 + i, i % 25), "en" if i % 3 else None, ["s", "t", None][i % 3], None) for i in range(40)]
    rows += [(d, t, None, None, None) for d, t in ODD]
    clash = ["h", "th", "fp", "key", "size", "row", "part", "pos", "lab", "score", "bucket", "queue", "media", "shard", "target"]
    docs = spark.createDataFrame(rows, ddl).select("*", *[F.lit("clash").alias(c) for c in clash])
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, None if i == 5 else 2.0], i) for i in range(50)] + [(None, None, None)], "vec_id long, embedding array<float>, label int")
    out = []
    for name, d, v in (("odd", docs, vectors), ("empty", docs.limit(0), vectors.limit(0))):
        at = tmp_path_factory.mktemp(name)
        d.write.parquet(f"{at}/documents.parquet")
        marks = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1)] if name == "odd" else [], "doc_id long, quality int, toxic int")
        marks.selectExpr("*", "'clash' as part", "'clash' as n").write.parquet(f"{at}/labels.parquet")
        v.write.parquet(f"{at}/embeddings.parquet")
        out.append((str(at), d.count()))
    return out


@pytest.mark.parametrize("name", WANT)
def test_query_columns_and_rows(spark, folders, name):
    for at, n in folders:
        got = queries.QUERIES[name](spark, at)
        assert got.columns[: len(WANT[name])] == WANT[name] and len(set(got.columns)) == len(got.columns)
        rows = got.collect()
        if name in BY_ROW:
            assert len(rows) == n
        assert n or not rows


def test_stages_over_odd_tables(spark, folders, scratch):
    for at, n in folders:
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, at)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = scratch.save(out)
                assert docs.count() <= n if name != "mix_sources" else True
            else:
                assert out.count() >= docs.count()

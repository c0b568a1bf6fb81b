"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.llm import binary, chaining, collocations, interaction, langid, license, linededup, media, mixing, packing, simhash, topk, wordpiece
from pellucid.llm.common import Scratch, shared_dir, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0, Scratch(spark))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark), ["doc_id", "source"])
    return mixed.select("row.doc_id", "size", "source_size", "target", mixing.taken(F.col("pieces")).alias("taken"), "row.source", mixing.shards_of(F.col("pieces")).alias("shards"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_table(table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"), Scratch(spark))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.read_ids(*binary.write_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1, Scratch(spark)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), Scratch(spark))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = linededup.LineIndex(spark, shared_dir(spark)).insert(docs).clean(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_language_id,
        op3_license_scan,
        op4_packing,
        op5_mixing,
        op6_exact_top_k,
        op7_token_counts,
        op8_media_columns,
        op9_substring_dedup,
        op10_token_ids,
        op11_filter_audit,
        op12_collocations,
        op13_line_dedup,
    )
}

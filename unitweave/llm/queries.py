"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.llm import backoff_lm, bitplane, circulant, divergence, exact_topk, lexpack, licenses, merkle, mixing, overlap_join, puquality, quality_rules, surrogates
from unitweave.llm.common import crc32_divides, table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitplane.write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return bitplane.read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return puquality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexpack.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("n_lines")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join.join_groups(table(spark, sf_dir, "documents")).drop("class_id", "n_links")  # the columns of its SQL


def op10_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score_corpus(table(spark, sf_dir, "documents"))


def op11_circulant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_groups(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, tampered=crc32_divides(docs["doc_id"], 7))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mix_sources, op2_token_shards, op3_pu_quality, op4_exact_top_k, op5_lexical_packing, op6_license_digests, op7_adaptive_rules, op8_surrogates, op9_jaccard_join, op10_backoff_scores, op11_circulant_groups, op12_source_divergence, op13_merkle_manifest)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE, "op4_exact_top_k": exact_topk.ORACLE, "op6_license_digests": licenses.oracle(), "op7_adaptive_rules": quality_rules.ORACLE, "op9_jaccard_join": overlap_join.ORACLE, "op11_circulant_groups": circulant.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_merkle_manifest": merkle.ORACLE}

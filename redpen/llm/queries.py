"""Queries of this folder's operators over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from redpen.llm import (
    bpe,
    cross_entropy,
    html_text,
    licenses,
    mixing,
    near_dedup,
    nearest,
    prefix_trie,
    repetition,
    sharding,
    toxicity,
    url_filter,
    vector_codes,
)
from redpen.llm.tables import read


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(read(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good quality; background: all documents."""
    good = read(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy.score(read(spark, sf_dir, "documents"), good)


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def compressed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def judged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_html_extraction": html_extraction,
    "op2_toxicity": toxic_documents,
    "op3_nearest_neighbours": nearest_neighbours,
    "op4_quality_rules": quality_rules,
    "op5_byte_bpe": byte_bpe,
    "op6_license_scan": license_scan,
    "op7_sharding": sharded,
    "op8_mixing": mixed_sources,
    "op9_minhash_dedup": minhash_near_dedup,
    "op10_lm_scoring": lm_scoring,
    "op11_vector_codes": compressed_vectors,
    "op12_prefix_trie": conversation_trie,
    "op13_url_filter": judged_urls,
}
ORACLE: dict[str, str] = {
    "op8_mixing": mixing.mix_sql(),
    "op11_vector_codes": vector_codes.compress_sql(),
    "op12_prefix_trie": prefix_trie.trie_sql(),
}

"""Registered queries of the operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import (
    bpe_words, decontaminate, html_main, line_dedup, near_dedup, oracles, orchard, packing, prefix_trie, quality, secrets, sharding,
    surrogates, toxicity,
)
from feedloom.llm.common import table
from feedloom.sources.store import run_dir

SHARDS = 24
#: Stands for a secret that a deployment brings along.
SURROGATE_KEY = "surrogate-key"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a version of its own, against a new ledger."""
    ledger = run_dir(spark, "secret-ledger")
    return secrets.digest(secrets.scan_versions(table(spark, sf_dir, "documents"), ledger))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs)


def op3_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(documents, benchmark).drop("text_hash")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_private(docs, SURROGATE_KEY)


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = dict.fromkeys(range(SHARDS), 1.0)
    return sharding.shard_records(table(spark, sf_dir, "documents"), now, now | {SHARDS: 1.0})


def op11_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.centroid_clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op13_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_words.digests(bpe_words.encode_decode(table(spark, sf_dir, "documents"), tokenizer, as_bytes=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_benchmark_windows": op3_benchmark_windows,
    "op4_main_text": op4_main_text,
    "op5_surrogates": op5_surrogates,
    "op6_length_buckets": op6_length_buckets,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_toxicity": op9_toxicity,
    "op10_rendezvous_shards": op10_rendezvous_shards,
    "op11_orchard_clusters": op11_orchard_clusters,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_bpe_words": op13_bpe_words,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": oracles.SECRETS,
    "op8_quality_cascade": oracles.QUALITY,
    "op11_orchard_clusters": oracles.CLUSTERS,
    "op12_prefix_trie": oracles.PREFIXES,
}

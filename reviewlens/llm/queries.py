"""Registered queries of this package: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlens.llm import chat, mixing, packing, pii, quality, ranking, repair, repeats, sharding, simhash, toxicity, vectors, warc

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).selectExpr(
        "-7L as conv_id",
        "id as turn",
        "if(id = 0, 'user', 'assistant') as role",
        r"concat('\\', '### Assistant: </turn> ok') as text",
    )
    events = chat.turn_events(turns.unionByName(odd))
    return chat.chat_digests(chat.render(chat.reconstruct(events)))


def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), sharding.HashTree.even(SHARDS))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.selectExpr("doc_id", "held_out", "score", "predicted", "cast(size(passages) as bigint) as n_passages")


def source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_plan(_table(spark, sf_dir, "documents")).drop("copies")


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(_table(spark, sf_dir, "conversations"))


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": warc_archives,
    "op2_quality_rules": quality_rules,
    "op3_chat_format": chat_format,
    "op4_pii_spans": pii_spans,
    "op5_simhash": simhash_components,
    "op6_sharding": shard_assignment,
    "op7_toxicity": toxicity_scores,
    "op8_mixing": source_mixture,
    "op9_packing": packed_sequences,
    "op10_vectors": vector_duplicates,
    "op11_conversation_repair": conversation_repair,
    "op12_ranked_search": ranked_search,
    "op13_repeated_passages": repeated_passages,
}

# The others need hashes, tokens or models that SQL does not have; tests hold them against plain versions.
ORACLES: dict[str, str] = {"op8_mixing": mixing.mixture_sql(), "op12_ranked_search": ranking.ranked_sql()}

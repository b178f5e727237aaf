"""Registered queries of the training-data operators, with the SQL they must agree with where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import (
    bpe,
    chat,
    fingerprints,
    html_extraction,
    lexical_search,
    mixing,
    oracles,
    quality,
    sharding,
    simhash,
    token_counts,
    toxicity,
    url_filters,
    whitening,
)

SHARDS = sharding.ShardPlan(tuple(f"shard-{k:03d}" for k in range(64)))
URL_RULES = tuple(
    map(url_filters.parse_rule, ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"))
)


@dataclass(frozen=True)
class Case:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(_table(spark, folder, "documents").select("doc_id", "source"), ["doc_id"], SHARDS, ["source"])


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(_table(spark, folder, "documents").select("doc_id", "text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_edit(_table(spark, folder, "documents"))


def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.inline(extra)).select(F.lit(-7).cast("long").alias("conv_id"), "turn", "role", F.lit(said).alias("text"))
    return chat.read_back(chat.prefix_tree(turns.unionByName(extra)))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, _table(spark, folder, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.neighbours").alias("neighbours"),
        F.col("toxicity.evidence").alias("evidence"),
    )


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"), columns=["doc_id"]).select("doc_id", "quality.*")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.filter_urls(_table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(_table(spark, folder, "pages"))


CASES = {
    "op1_sharding": Case(op1_sharding, oracles.sharding(SHARDS)),
    "op2_byte_bpe": Case(op2_byte_bpe),
    "op3_fingerprints": Case(op3_fingerprints, oracles.FINGERPRINTS),
    "op4_chat_formatting": Case(op4_chat_formatting),
    "op5_toxicity": Case(op5_toxicity),
    "op6_token_counts": Case(op6_token_counts),
    "op7_quality_rules": Case(op7_quality_rules, oracles.quality(quality.QualityRules())),
    "op8_mixing": Case(op8_mixing, oracles.MIXING),
    "op9_simhash": Case(op9_simhash),
    "op10_url_filters": Case(op10_url_filters, oracles.url_filters(URL_RULES)),
    "op11_whitening": Case(op11_whitening),
    "op12_lexical_search": Case(op12_lexical_search, oracles.LEXICAL_SEARCH),
    "op13_html_extraction": Case(op13_html_extraction),
}

"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, chat, decontam, exact_dedup, language, near_dedup, quality, ranking, repair, repeats, token_store, toxicity, warc
from quire.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    parts = chat.format_conversations(rows.unionByName(probe))
    return chat.digest_conversations(parts).withColumn("conv_id", F.col("conv").cast("long")).drop("conv")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_store.token_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def queries():
    return {
        f.__name__: f
        for f in (
            op1_exact_dedup,
            op2_chat_formatting,
            op3_minhash_near_dedup,
            op4_toxicity,
            op5_quality_classifier,
            op6_token_store,
            op7_language_id,
            op8_warc,
            op9_byte_bpe,
            op10_decontamination,
            op11_ranked_search,
            op12_conversation_repair,
            op13_suffix_dedup,
        )
    }


def oracle_sql():
    return {"op1_exact_dedup": exact_dedup.SQL, "op2_chat_formatting": chat.SQL, "op8_warc": warc.SQL, "op11_ranked_search": ranking.SQL, "op12_conversation_repair": repair.SQL}

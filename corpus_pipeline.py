"""The corpus pipeline: stages that each read what the stage before has written.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, exact_dedup, near_dedup, toxicity
from quire.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. Null and empty texts are scored as an empty window; repeated rows stay or
    go together; without labels of both classes all stay; an empty table gives an empty one."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest id. Null and empty texts are one group; rows that repeat
    the kept id all stay, as do those of a group of null ids alone; an empty table gives an empty one."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the least id. Stages go by the usual rule, five-word shingles and
    similarity 0.8; the query of the same operator has four-word shingles by its own contract. Texts without words and
    rows without an id stay; rows that repeat a kept id stay; an empty table gives an empty one."""
    return near_dedup.drop_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null and empty texts stay; rows that repeat an id of which one
    holds a passage all go; without items all stay; an empty table gives an empty one."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row that is left, repeats and null ids too: its token ids and the
    digest of the text that they decode to; null and empty texts have no ids; an empty table gives none."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode_bytes),
]

#: Neither a trained network nor near copies nor merges can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs

"""Exact deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold_ascii, free_name, text_of


def groups_of_equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per distinct normalised text that occurs more than once: its keys, the kept id and the group's size.

    Rows are grouped by the 128-bit hash together with the text itself, so the aggregation compares the bytes inside
    a hash group and two texts with one hash stay apart. Copies are combined before the shuffle: a group that holds
    a third of all rows sends one row per map task.
    """
    best = (F.max if keep == "max" else F.min)("__id")
    return (
        _keyed(docs, id_col, text_col, True)
        .groupBy("__hash", "__norm")
        .agg(best.alias("__keep"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select("__hash", F.sha2(F.col("__norm").cast("binary"), 256).alias("__sha"), "__keep", "__n")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("__id"), fold_ascii(text_of(text_col)).alias("__norm"))
    keys = ["__id", F.md5(F.col("__norm").cast("binary")).alias("__hash")]
    if with_text:
        return norm.select(*keys, "__norm")
    return norm.select(*keys, F.sha2(F.col("__norm").cast("binary"), 256).alias("__sha"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null text counts as empty, so null and empty texts form
    one group. Of equal texts the largest (``keep="min"``: smallest) id stays; rows that repeat that id are the same
    document and all stay. Null ids never win against others; a group of null ids only keeps them all. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    groups = groups_of_equal_texts(docs, id_col, text_col, keep)
    rows = _keyed(docs, id_col, text_col, False)
    joined = rows.join(groups, ["__hash", "__sha"], "left")
    grouped = F.col("__n").isNotNull()
    keep_id = F.when(grouped, F.col("__keep")).otherwise(F.col("__id"))
    return joined.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with their own columns, whatever their names. Null and empty texts are
    one group; rows that repeat the kept id all stay; an empty table gives an empty one."""
    at, digest = free_name(docs, "__gone"), free_name(docs, "__sha")
    gone = exact_dedup(docs, id_col, text_col, keep).where("not kept").select(F.col(id_col).alias(at), F.col("text_sha256").alias(digest)).distinct()
    sha = F.sha2(fold_ascii(text_of(text_col)).cast("binary"), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(F.col(at)) & (sha == F.col(digest)), "left_anti")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) d
WINDOW g AS (PARTITION BY t)
"""

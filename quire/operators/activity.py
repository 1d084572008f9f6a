"""Edits, conflicts, compile logs and worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.numbering import number_within


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in an order. A maximum, so rows are combined before they are shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def uncompiled_saves(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """(user_id, doc, node, lang, ext, event_id): each user's newest edit of a version, by language and extension, that differs
    from the stored text; edits of versions that the node doesn't have are leftovers and don't count."""
    k = ["doc", "node", "lang", "ext"]
    last = newest(edits.select(*k, "user_id", "ts", "event_id", "content"), [*k, "user_id"], ["ts", "event_id"])
    return last.join(segments.select(*k, "text"), k).where("content <> text").select("user_id", *k, "event_id")


def conflicts(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """Edits that began from another text than the stored one."""
    now = segments.select("doc", "node", "lang", F.md5("text").alias("now"))
    return edits.join(now, ["doc", "node", "lang"]).where("base_md5 <> now").select("event_id", "doc", "node", "user_id")


def apply_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc, node, lang, text, optarg, previous, modified): segments(doc, node, lang, text, optarg) after the newest edit that
    isn't in conflict; an edit without an optarg leaves it as it was."""
    now = segments.select("doc", "node", "lang", "text", "optarg")
    able = edits.join(now.select("doc", "node", "lang", F.md5("text").alias("now")), ["doc", "node", "lang"]).where("base_md5 = now")
    last = newest(able.withColumnRenamed("optarg", "new_optarg"), ["doc", "node", "lang"], ["ts", "event_id"]).select("doc", "node", "lang", "content", "ts", "new_optarg")
    both = now.join(last, ["doc", "node", "lang"], "left")
    changed = F.col("content").isNotNull() & (F.col("content") != F.col("text"))
    return both.select("doc", "node", "lang", F.coalesce("content", "text").alias("text"), F.coalesce("new_optarg", "optarg").alias("optarg"), F.when(changed, F.col("text")).alias("previous"), F.col("ts").alias("modified"))


def log_errors(logs: DataFrame, id_col: str, text_col: str, context: int = 10) -> DataFrame:
    """(id, line, path, at, message, context): `path:line:message` lines of logs, and up to ten lines after each, to
    the second blank one or the next error."""
    pattern = r"^([^:\s][^:]*):(\d+):\s*(.*)$"
    lines = F.split(text_col, "\n", -1)
    starts = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i)), lambda x: x.isNotNull())
    rows = logs.select(F.col(id_col).alias("id"), lines.alias("lines"), F.posexplode(starts).alias("k", "line"), starts.alias("starts"))
    after = F.coalesce(F.get("starts", F.col("k") + 1), F.size("lines"))
    block = F.slice("lines", F.col("line") + 2, F.least(F.lit(context), F.greatest(after - F.col("line") - 1, F.lit(0))))
    blank = F.aggregate(
        "block", F.struct(F.lit(0).alias("blanks"), F.lit(0).alias("kept")), lambda acc, x: F.struct((acc["blanks"] + (F.trim(x) == "").cast("int")).alias("blanks"), (acc["kept"] + ((acc["blanks"] + (F.trim(x) == "").cast("int")) < 2).cast("int")).alias("kept"))
    )
    out = rows.withColumn("block", block).withColumn("kept", blank["kept"])
    first = F.get("lines", F.col("line"))
    return out.select("id", F.col("line").cast("long").alias("line"), F.regexp_extract(first, pattern, 1).alias("path"), F.regexp_extract(first, pattern, 2).cast("long").alias("at"), F.regexp_extract(first, pattern, 3).alias("message"), F.array_join(F.slice("block", F.lit(1), F.col("kept")), "\n").alias("context"))


def needs_rerun(text: str):
    """Whether a log asks for another pass."""
    return F.col(text).rlike("Rerun to get|Label\\(s\\) may have changed|undefined references")


def output_changed(before: Column, now: Column) -> Column:
    """Whether a run changed a file that the next run reads, by the fingerprints before and after; a new file counts."""
    return ~before.eqNullSafe(now)


def worklist(nodes: DataFrame, reached: DataFrame, excluded: tuple) -> DataFrame:
    """(doc, node, place): nodes to compile: among reached(doc, node), of a kind that compiles, least recently compiled first and never
    compiled ones before all."""
    able = nodes.where(~F.col("environ").isin(*excluded)).join(reached, ["doc", "node"], "left_semi")
    return number_within(able.select("doc", "node", "compiled"), ["doc"], [F.col("compiled").asc_nulls_first(), "node"], "place").drop("compiled")


def available_logs(nodes: DataFrame, logs: DataFrame, accesses: tuple = ("private", "public")) -> DataFrame:
    """(doc, node, lang, access): logs that exist, of all that a node's languages could have."""
    all_ = nodes.select("doc", "node", "lang", F.explode(F.array(*map(F.lit, accesses))).alias("access"))
    return all_.join(logs, ["doc", "node", "lang", "access"], "left_semi")


def rebase_errors(errors: DataFrame, line_map: DataFrame, hidden: int) -> DataFrame:
    """(doc, node, at, line): error lines of a language's text, less its hidden lines, as lines of the mixed text:
    the first line there that has come so far; line_map(doc, node, line, to)."""
    shown = errors.select("doc", "node", (F.col("at") - hidden).cast("long").alias("at"))
    hits = shown.join(line_map.select("doc", "node", "line", F.col("to").alias("at")), ["doc", "node", "at"])
    return hits.groupBy("doc", "node", "at").agg(F.min("line").alias("line"))

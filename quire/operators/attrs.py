"""Attributes of nodes as rows (doc, node, key, value[, value2]): changes, views, differences and problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.ids import id_to_int, int_to_id, normalize_id, strip_delims


def upsert(attrs: DataFrame, adds: DataFrame, single: tuple) -> DataFrame:
    """``attrs`` with adds(doc, node, key, value, seq): of a single-valued key the last add wins over what is stored;
    of other keys each value is there once. Rows come out as (doc, node, key, value)."""
    new = F.row_number().over(Window.partitionBy("doc", "node", "key").orderBy(F.desc("seq"), F.desc("value"))) == 1
    last = adds.where(F.col("key").isin(*single)).withColumn("new", new).where("new").select("doc", "node", "key", "value")
    kept = attrs.where(F.col("key").isin(*single)).join(last, ["doc", "node", "key"], "left_anti").select("doc", "node", "key", "value")
    many = attrs.where(~F.col("key").isin(*single)).select("doc", "node", "key", "value").unionByName(adds.where(~F.col("key").isin(*single)).select("doc", "node", "key", "value")).distinct()
    return kept.unionByName(last).unionByName(many)


def get(attrs: DataFrame, key: str) -> DataFrame:
    """(doc, node, values): the values of a key, sorted."""
    return attrs.where(F.col("key") == key).groupBy("doc", "node").agg(F.sort_array(F.collect_list("value")).alias("values"))


def get_pairs(attrs: DataFrame, key: str) -> DataFrame:
    """(doc, node, pairs): the values of a key with their second values, sorted; null where there is no second one."""
    pair = F.struct("value", "value2")
    return attrs.where(F.col("key") == key).groupBy("doc", "node").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))


def keys(attrs: DataFrame) -> DataFrame:
    """(doc, node, keys): the keys that each node has, sorted."""
    return attrs.groupBy("doc", "node").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def pivot(attrs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per node and a column of joined values for each key."""
    wide = attrs.groupBy("doc", "node").pivot("key", keys).agg(F.array_join(F.sort_array(F.collect_list("value")), ";"))
    return wide


def delete(attrs: DataFrame, gone: DataFrame) -> DataFrame:
    """``attrs`` without gone(doc, node, key[, value])."""
    return attrs.join(gone, gone.columns, "left_anti")


def flatten(nodes: DataFrame, edges: DataFrame, attrs: DataFrame) -> DataFrame:
    """One (doc, node, key, value, link) relation of node fields, extensions, children, parents and attributes; ``link`` is
    where ids and extensions lead to, null for others. nodes(doc, node, lang, access, environ, exts), exts joined by commas."""
    none = F.lit(None).cast("string")
    fields = nodes.select("doc", "node", F.expr("stack(3, 'lang', lang, 'access', access, 'environ', environ) as (key, value)")).where("value is not null").withColumn("link", none)
    page = lambda node: F.concat(F.lit("/UUID/"), F.col("doc"), F.lit("/"), int_to_id(node))
    ext = nodes.select("doc", "node", F.explode(F.split("exts", ",")).alias("value"))
    ext = ext.select("doc", "node", F.lit("extension").alias("key"), "value", F.concat(page(F.col("node")), F.lit("/?ext="), "value").alias("link"))
    end = lambda a, b, key: edges.select("doc", F.col(a).alias("node"), F.lit(key).alias("key"), F.col(b).cast("string").alias("value"), page(F.col(b)).alias("link"))
    rest = attrs.select("doc", "node", "key", "value", none.alias("link"))
    return fields.unionByName(ext).unionByName(end("parent", "child", "child_uuid")).unionByName(end("child", "parent", "parent_uuid")).unionByName(rest)


def split_citations(attrs: DataFrame, keys: tuple = ("M_cite",)) -> DataFrame:
    """Citations of several works as one row for each, in braces again; other rows as they are."""
    several = attrs.where(F.col("key").isin(*keys))
    rows = several.select("doc", "node", "key", F.explode(F.split(strip_delims(F.col("value")), ",", -1)).alias("v")).select("doc", "node", "key", F.concat(F.lit("{"), F.trim("v"), F.lit("}")).alias("value"))
    return rows.unionByName(attrs.where(~F.col("key").isin(*keys)).select("doc", "node", "key", "value"))


def diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows only in one table, with ``change``: added or deleted."""
    a, b = old.select(*columns).distinct(), new.select(*columns).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("deleted")))


def derived(attrs: DataFrame) -> DataFrame:
    """Attributes that are read from the text (M_... and S_...)."""
    return attrs.where(F.col("key").startswith("M_") | F.col("key").startswith("S_"))


def duplicate_labels(attrs: DataFrame) -> DataFrame:
    """(doc, key, value, n): label values on several nodes of a document."""
    return attrs.where(F.col("key").endswith("M_label")).groupBy("doc", "key", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def wrong_uuid(attrs: DataFrame) -> DataFrame:
    """Nodes whose own id command names another node."""
    told = id_to_int(strip_delims(F.col("value")))
    return attrs.where(F.col("key").endswith("M_uuid")).withColumn("told", told).where(~F.col("told").eqNullSafe(F.col("node"))).select("doc", "node", "value")


def clean_authors(value: Column) -> Column:
    """Author names without braces around them and spaces at their ends."""
    return F.trim(strip_delims(F.trim(value)))


def replaces(attrs: DataFrame) -> DataFrame:
    """(doc, node, replaced): nodes that a node says it replaces; the list is split at , ; / and white space."""
    parts = F.explode(F.split(strip_delims(F.col("value")), r"[,;/\s]+", -1))
    rows = attrs.where(F.col("key").endswith("M_replaces")).select("doc", "node", parts.alias("id"))
    return rows.where(normalize_id(F.col("id")).isNotNull() & (F.col("id") != "")).select("doc", "node", id_to_int(F.col("id")).alias("replaced")).distinct()


def replaced_by(replacements: DataFrame) -> DataFrame:
    """(doc, node, by): the other direction of ``replaces``: the nodes that took a node's place."""
    return replacements.select("doc", F.col("replaced").alias("node"), F.col("node").alias("by"))


def merge_status(status: DataFrame, results: DataFrame) -> DataFrame:
    """(doc, node, status): status(map) after results(doc, node, prog, ok, seq), of which the last of a program counts: a
    success drops its key, a failure sets it."""
    last = results.groupBy("doc", "node", "prog").agg(F.max_by("ok", F.struct("seq", F.col("ok").cast("int"))).alias("ok"))
    per = last.groupBy("doc", "node").agg(F.map_from_entries(F.collect_list(F.struct("prog", "ok"))).alias("r"))
    old = F.coalesce("status", F.expr("cast(map() as map<string,boolean>)"))
    both = status.join(per, ["doc", "node"], "full").withColumn("old", old).withColumn("r", F.coalesce("r", F.expr("cast(map() as map<string,boolean>)")))
    kept = F.map_filter("old", lambda k, v: ~F.map_contains_key("r", k))
    return both.select("doc", "node", F.map_concat(kept, F.map_filter("r", lambda k, v: ~v)).alias("status"))


def failed_status(status: DataFrame) -> DataFrame:
    """(doc, node, prog, lang, access): the failures in a status map; keys are prog[:lang[:access]]."""
    part = lambda i: F.get(F.split("key", ":", -1), F.lit(i))
    return status.select("doc", "node", F.explode("status").alias("key", "ok")).where("not ok").select("doc", "node", part(0).alias("prog"), part(1).alias("lang"), part(2).alias("access"))


def rollup_times(nodes: DataFrame) -> DataFrame:
    """(doc, modified, compiled): the latest times; compiled only when every node has been compiled."""
    done = F.count(F.lit(1)) == F.count("compiled")
    return nodes.groupBy("doc").agg(F.max("modified").alias("modified"), F.when(done, F.max("compiled")).alias("compiled"))

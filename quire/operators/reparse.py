"""The whole job that reads a corpus's texts again and brings its attributes, edges, ranges and order up to date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import attrs, index, segment, tree
from quire.operators.numbering import number_within
from quire.scratch import written
from quire.sources.commits import CorpusTables

#: Environs whose texts aren't read for attributes: they keep those they have.
NOT_READ = ("graphic_file", "preamble", "input_preamble", "usepackage", "bibliography")


def _told(df: DataFrame, code: str, *args: str | Column) -> DataFrame:
    return df.select("doc", F.col("node").cast("long").alias("node"), F.lit(code).alias("code"), F.concat_ws(" ", *args).alias("detail"))


def reparse(segments: DataFrame, stored: DataFrame, edges: DataFrame, files: DataFrame, roots: DataFrame, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """New tables attrs(doc, node, key, value), edges(doc, parent, child, ordinal), orders(doc, node, order_in_document) and
    report(doc, node, code, detail), from segments(doc, node, environ, text), what is stored in attrs and edges, and
    files(doc, path, target), the nodes that paths stand for. ``rules`` are each document's, see ``segment.explode_markers``.

    Attributes of texts (M_..., S_...) are made anew but for NOT_READ environs: several citations become one row each; ids
    that texts tell aren't stored, wrong ones are reported; of equal labels of a document the least node's stays. A node's
    children are what its text inputs, in that order. Index ranges are marked on all nodes below them in the new tree. The
    report has what was added and deleted: NEW, DELETED, CHILD_NEW, CHILD_GONE, WRONG_UUID, DUPLICATE_LABEL, RANGE_OPEN and
    RANGE_CLOSE (without a partner), and UNCLOSED arguments. Attributes that don't come from texts stay as they are.
    """
    k = ["doc", "node", "key", "value"]
    deep = segment.explode_deep(segments, rules=rules).select("doc", "node", "pos", "macro", "arg", "env", "unclosed")
    # texts between markers aren't read again
    asked = F.col("macro").isin(*segment.COMMANDS, "input", "include") | (F.col("unclosed") != "")
    deep = written(deep.where(asked), "deep")
    read = segments.where(~F.col("environ").isin(*NOT_READ)).select("doc", "node")
    found = segment.attributes(deep).join(read, ["doc", "node"], "left_semi").distinct()
    wrong = attrs.wrong_uuid(found)
    found = found.where("key <> 'M_uuid'")
    cites = [r.key for r in found.where(F.col("key").endswith("M_cite")).select("key").distinct().collect()]
    fresh = attrs.split_citations(found, tuple(cites)).distinct() if cites else found
    first = fresh.where(F.col("key").endswith("M_label")).groupBy("doc", "key", "value").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    judged = written(fresh.join(first, ["doc", "key", "value"], "left"), "fresh")
    twice = judged.where("node > least")
    fresh = judged.where("least is null or node = least").select(*k)

    old = attrs.derived(stored).select(*k)
    again = old.join(read, ["doc", "node"], "left_semi")
    changed = written(attrs.diff(again, fresh, k), "changed")
    kept = stored.select(*k).exceptAll(again) if stored.columns == k else stored.select(*k).join(again.distinct(), k, "left_anti")

    children = segment.resolve_inputs(deep, files).where("target is not null").groupBy("doc", "node", "target").agg(F.min("pos").alias("pos"))
    made = number_within(children, ["doc", "node"], ["pos", "target"], "ordinal").select("doc", F.col("node").alias("parent"), F.col("target").alias("child"), "ordinal")
    untouched = edges.join(segments.select("doc", F.col("node").alias("parent")), ["doc", "parent"], "left_anti")
    linked = written(made.unionByName(untouched.select(*made.columns)), "edges")
    moved = written(attrs.diff(edges, linked, ["doc", "parent", "child"]).withColumnRenamed("parent", "node"), "moved")

    visits = written(tree.walk(linked, roots), "visits")
    ranged = index.range_attrs(kept.unionByName(fresh), visits)
    lone = index.unpaired(index.entries(fresh))
    orders = tree.order_in_document(segments.select("doc", "node"), visits)
    report = [
        _told(changed.where("change = 'added'"), "NEW", "key", "value"),
        _told(changed.where("change = 'deleted'"), "DELETED", "key", "value"),
        _told(moved.where("change = 'added'"), "CHILD_NEW", F.col("child").cast("string")),
        _told(moved.where("change = 'deleted'"), "CHILD_GONE", F.col("child").cast("string")),
        _told(wrong, "WRONG_UUID", "value"),
        _told(twice, "DUPLICATE_LABEL", "key", "value"),
        _told(lone.where("value = '('"), "RANGE_OPEN", "lang", "key"),
        _told(lone.where("value = ')'"), "RANGE_CLOSE", "lang", "key"),
        _told(deep.where("unclosed <> ''").select("doc", "node", F.explode(F.split("unclosed", ",")).alias("macro")), "UNCLOSED", "macro"),
    ]
    return {"attrs": ranged.distinct(), "edges": linked, "orders": orders, "report": reduce(DataFrame.unionByName, report)}


def reparse_corpus(tables: CorpusTables, files: DataFrame, roots: DataFrame, rules: DataFrame | None = None, job: str | None = None) -> int:
    """``reparse`` over the tables segments, attrs and edges of a store, committed together; gives the version. Read at one
    version throughout: a commit that comes in between makes this one fail, and nothing of it is seen. A job that is
    repeated under its name does nothing once it has been committed."""
    if job is not None and (made := tables.done(job)):
        return made
    base = tables.version()
    now = {name: tables.read(name, base) for name in ("segments", "attrs", "edges")}
    return tables.commit(reparse(now["segments"], now["attrs"], now["edges"], files, roots, rules), base, job)

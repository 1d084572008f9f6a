"""Checks of a corpus, each a DataFrame, and their report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.ids import RESERVED, SLUG, valid_language
from quire.operators import tree
from quire.operators.numbering import number_within
from quire.plans.rules import PICTURE_COMMANDS, SECTIONS
from quire.scratch import moved, written

CAP = 16


def allocate_ids(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new`` with new_node: numbers after the document's greatest node, in the order of r, which tells rows apart."""
    top = existing.groupBy("doc").agg(F.max("node").alias("top"))
    places = number_within(new.select("doc", "r"), ["doc"], ["r"], "n")
    return new.join(places, ["doc", "r"]).join(top, "doc", "left").withColumn("new_node", F.coalesce("top", F.lit(0)) + F.col("n")).drop("n", "top")


def validate(df: DataFrame, name: Column, language: Column, slug: Column, reserved: tuple = RESERVED) -> tuple[DataFrame, DataFrame]:
    """The valid rows of ``df``, and the rejected ones with ``reasons``: any of reserved, language and slug."""
    found = F.array(F.when(name.isin(*reserved), "reserved"), F.when(~valid_language(language), "language"), F.when(~slug.rlike(SLUG), "slug"))
    judged = df.withColumn("reasons", F.filter(found, lambda x: x.isNotNull()))
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def contents(nodes: DataFrame, visits: DataFrame, title: Column, kinds: tuple = ("section", "input")) -> DataFrame:
    """(doc, node, depth, environ, title) of the nodes that make a document's contents list."""
    own = nodes.where(F.col("environ").isin(*kinds)).select("doc", "node", "environ", title.alias("title"))
    return visits.select("doc", "node", "depth").join(own, ["doc", "node"]).select("doc", "node", "depth", "environ", "title")


def problem(df: DataFrame, code: str, node: str, *args: str) -> DataFrame:
    return df.select("doc", F.lit(code).alias("code"), F.col(node).cast("long").alias("node"), F.array(*[F.col(a).cast("string") for a in args]).cast("array<string>").alias("args"))


def missing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return problem(tree.missing_children(nodes, edges), "MISSING_CHILD", "parent", "child")


def disconnected(nodes: DataFrame, reached: DataFrame, replaced: DataFrame) -> DataFrame:
    """DISCONNECTED nodes, and DISCONNECTED_REPLACED ones that replaced(doc, node, by) knows."""
    gone = tree.disconnected(nodes, reached, replaced)
    code = F.when(F.col("replaced_by").isNull(), "DISCONNECTED").otherwise("DISCONNECTED_REPLACED")
    return gone.select("doc", code.alias("code"), F.col("node").cast("long").alias("node"), F.filter(F.array(F.col("replaced_by").cast("string")), lambda x: x.isNotNull()).alias("args"))


def wrong_access(nodes: DataFrame, private: tuple) -> DataFrame:
    """Of environments, private ones must have private access, and others must not."""
    wrong = F.col("environ").startswith("E_") & (F.col("environ").isin(*private) != (F.col("access") == "private"))
    return problem(nodes.where(wrong), "WRONG_ACCESS", "node", "environ", "access")


def wrong_environ(nodes: DataFrame, environs: DataFrame) -> DataFrame:
    """(doc, node, n): nodes with none or several values in environs(doc, node, value)."""
    per = environs.groupBy("doc", "node").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("doc", "node").join(moved(per), ["doc", "node"], "left").select("doc", "node", F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("n <> 1")


def wrong_header(segments: DataFrame) -> DataFrame:
    """Segments of sectioning nodes whose first line that isn't a comment is not the node's command; other environs have
    no header to be wrong."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~F.ltrim(x).startswith("%") & (F.trim(x) != ""))
    bad = segments.where(F.col("environ").isin(*SECTIONS)).where(~F.coalesce(F.get(lines, F.lit(0)).startswith(F.concat(F.lit("\\"), F.col("environ"))), F.lit(False)))
    return problem(bad, "WRONG_HEADER", "node", "environ")


def dup_input(inputs: DataFrame) -> DataFrame:
    """(doc, node, lang, target, n) of inputs that occur more than once."""
    return inputs.where("target is not null").groupBy("doc", "node", "lang", "target").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_input(inputs: DataFrame, versions: DataFrame) -> DataFrame:
    """(doc, node, lang, target): an input of the node that the text of one of its versions(doc, node, lang) lacks; a
    version without any input lacks them all."""
    targets = inputs.where("target is not null").select("doc", "node", "target").distinct()
    wanted = versions.select("doc", "node", "lang").distinct().join(moved(targets), ["doc", "node"])
    return wanted.join(moved(inputs.select("doc", "node", "lang", "target")), ["doc", "node", "lang", "target"], "left_anti").select("doc", "node", "lang", "target")


def untranslated(nodes: DataFrame, languages: list[str], cap: int = CAP) -> DataFrame:
    """(doc, node, n): nodes that lack one of the languages, the first ``cap`` of a document, with their number. Nodes in
    many languages at once, or without language, are exempt."""
    exempt = F.exists("langs", lambda x: x.isin("mul", "und", "zxx"))
    lack = nodes.where(~exempt & (F.size(F.array_except(F.array(*map(F.lit, languages)), "langs")) > 0)).select("doc", "node")
    counts = lack.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return number_within(lack, ["doc"], ["node"], "k").where(F.col("k") <= cap).join(counts, "doc").select("doc", "node", "n")


def unchecked(nodes: DataFrame, checked: DataFrame) -> DataFrame:
    """Nodes whose present text is not among checked(doc, node, md5)."""
    now = nodes.withColumn("md5", F.md5("text"))
    return now.join(checked.select("doc", "node", "md5"), ["doc", "node", "md5"], "left_anti")


def report(*problems: DataFrame) -> DataFrame:
    """One table of problems(doc, code, node, args)."""
    return reduce(DataFrame.unionByName, problems)


def rendered(problems: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, code, node, args, flagged): problems with a flag on those of disconnected nodes; a document of docs(doc)
    without any has a row with code OK."""
    gone = problems.where("code like 'DISCONNECTED%'").select("doc", "node").distinct().withColumn("flagged", F.lit(True))
    rows = problems.join(gone, ["doc", "node"], "left").select("doc", "code", "node", "args", F.coalesce("flagged", F.lit(False)).alias("flagged"))
    fine = docs.select("doc").distinct().join(problems.select("doc").distinct(), "doc", "left_anti")
    return rows.unionByName(fine.select("doc", F.lit("OK").alias("code"), F.lit(None).cast("long").alias("node"), F.array().cast("array<string>").alias("args"), F.lit(False).alias("flagged")))


def check_corpus(nodes: DataFrame, edges: DataFrame, inputs: DataFrame, versions: DataFrame, replaced: DataFrame, rules: DataFrame, extensions: DataFrame, languages: list[str], private: tuple) -> DataFrame:
    """problems(doc, code, node, args) of whole documents: every check of this module over nodes(doc, node, environ, exts,
    access, text, langs), edges, inputs(doc, node, lang, macro, context, path, target), versions(doc, node, lang, environ,
    text) and replaced(doc, node, by). One walk gives what is reached, and its loops."""
    nodes, inputs, edges = written(nodes.drop("text"), "nodes"), written(inputs, "inputs"), written(edges, "edges")
    roots = written(tree.roots_of(nodes), "roots")
    visits = written(tree.walk(edges, roots), "visits")
    reached = visits.where("is_first").select("doc", "node")
    live = edges.join(moved(reached.withColumnRenamed("node", "parent")), ["doc", "parent"], "left_semi")
    again = live.groupBy("doc", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n")).join(moved(roots), "doc").withColumn("n", F.col("n") - F.when(F.col("node") == F.col("root"), 0).otherwise(1))
    links = tree.check_links(nodes, edges, rules, extensions)
    found = [
        problem(again.where("n > 0"), "DUPLICATE", "node", "n"),
        missing(nodes, edges),
        disconnected(nodes, reached, replaced),
        problem(links, "WRONG_LINK", "child", "parent", "parent_environ", "child_environ"),
        check_commands(inputs, nodes),
        wrong_access(nodes, private),
        wrong_header(versions),
        wrong_input(inputs),
        problem(dup_input(inputs), "DUP_INPUT", "node", "lang", "target"),
        problem(missing_input(inputs, versions), "MISSING_INPUT", "node", "lang", "target"),
        problem(untranslated(nodes, languages), "UNTRANSLATED", "node", "n"),
    ]
    found.append(problem(tree.loops(visits), "LOOP", "node", "parent"))
    return report(*found)


def wrong_input(inputs: DataFrame) -> DataFrame:
    """Inputs without a known target, or of another language's version: inputs(doc, node, lang, path, target)."""
    told = F.regexp_extract("path", r"_([a-z]{3})(?:\.tex)?$", 1)
    return problem(inputs.where(F.col("target").isNull() | ((told != "") & (told != F.col("lang")))), "WRONG_INPUT", "node", "lang", "path")


def check_commands(inputs: DataFrame, nodes: DataFrame, parenthood: dict[str, tuple] | None = None) -> DataFrame:
    """References whose command or surroundings don't fit what they bring in: inputs(doc, node, macro, context, target).
    An environment needs an input within its own begin, or within one that ``parenthood`` allows it in (a bibliography's
    may be anywhere); a picture needs its command; packages and bibliographies come by theirs or by an input, other nodes
    by an input."""
    child = nodes.select("doc", F.col("node").alias("target"), "environ")
    around = F.col("context").eqNullSafe(F.col("environ")) | (F.col("environ") == "E_thebibliography")
    for outer, inner in (parenthood or {}).items():
        around = around | (F.coalesce(F.col("context") == outer, F.lit(False)) & F.col("environ").isin(*inner))
    by_name = F.col("environ").isin("usepackage", "bibliography", "include") & (F.col("macro") == F.col("environ"))
    fits = (
        F.when(F.col("environ").startswith("E_"), (F.col("macro") == "input") & around)
        .when(F.col("environ") == "graphic_file", F.col("macro").isin(*PICTURE_COMMANDS))
        .otherwise(F.col("macro").isin("input", "include") | by_name)
    )
    return problem(inputs.join(moved(child), ["doc", "target"]).where(~fits), "CMD_PARENT_CHILD", "node", "macro", "context", "environ")

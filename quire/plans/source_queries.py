"""Queries that write files from the given tables in the layout of stored corpora, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.fixtures import cte, view
from quire.functions import text as T
from quire.functions.ids import id_to_path, int_to_id
from quire.operators import segment
from quire.plans.registry import query
from quire.plans.tree_queries import _id_sql
from quire.scratch import shared_path
from quire.sources import files


def _written(spark: SparkSession, rows: DataFrame) -> str:
    root = shared_path(spark, "source-files")
    files.write_texts(rows, root)
    return root


def _folder(name: str):
    """The path of a file in a node's folder."""
    return F.concat("doc", F.lit("/"), id_to_path(int_to_id(F.col("node"))), F.lit(f"/{name}"))


@query(f"WITH {cte('fx_node')} SELECT doc, node, 'eng' AS lang, CASE WHEN node % 9 = 0 THEN '.bib' ELSE '.tex' END AS ext, md5(text) AS md5 FROM fx_node")
def src_segments(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4, SRC-5: segments written in their layout and read back."""
    n = view(spark, d, "fx_node").select("doc", "node", F.lit("eng").alias("lang"), F.when(F.col("node") % 9 == 0, ".bib").otherwise(".tex").alias("ext"), "text")
    root = shared_path(spark, "layout")
    files.write_layout(n, root)
    return files.read_segments(spark, root).select("doc", "node", "lang", "ext", F.md5("text").alias("md5"))


@query(f"WITH {cte('fx_node')} SELECT doc || '/f' || r || '.tex' AS path, 'tex' AS ext, md5(text) AS md5 FROM fx_node WHERE node % 2 = 0")
def src_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1: a tree of source files, of which some have other extensions."""
    name = F.concat("doc", F.lit("/f"), F.col("r").cast("string"), F.when(F.col("node") % 2 == 0, ".tex").otherwise(".log"))
    root = _written(spark, view(spark, d, "fx_node").select(name.alias("path"), "text"))
    return files.read_sources(spark, root, ("tex",)).select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), "ext", F.md5("text").alias("md5"))


_LINES = """x AS (SELECT doc, node, unnest(['lang=' || lang, 'access=' || access, 'environ=' || environ]) AS line FROM fx_environ UNION ALL SELECT doc, node, 'extension=' || unnest(string_split(exts, ',')) FROM fx_environ UNION ALL SELECT doc, parent, 'child_uuid=' || child FROM fx_edge UNION ALL SELECT doc, child, 'parent_uuid=' || parent FROM fx_edge
UNION ALL SELECT DISTINCT doc, node, key || '=' || value || CASE WHEN node % 3 = 0 THEN chr(9) || node ELSE '' END FROM fx_attr)"""


@query(f"""WITH {cte('fx_environ', 'fx_edge', 'fx_attr')}, {_LINES} SELECT doc, node, substr(line, 1, instr(line, '=') - 1) AS key, string_split(substr(line, instr(line, '=') + 1), chr(9))[1] AS value, string_split(substr(line, instr(line, '=') + 1), chr(9))[2] AS value2 FROM x""")
def src_metadata(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2, SRC-3: metadata files written, second values too, and read back."""
    a = view(spark, d, "fx_attr").select("doc", "node", "key", "value", F.when(F.col("node") % 3 == 0, F.col("node").cast("string")).alias("value2")).distinct()
    root = shared_path(spark, "metadata")
    files.write_metadata(view(spark, d, "fx_environ"), view(spark, d, "fx_edge"), a, root)
    rows = files.read_metadata(spark, root)
    return rows.select(F.regexp_extract("path", "doc=([^/]+)/", 1).alias("doc"), F.regexp_extract("path", "node=([^/]+)/", 1).cast("long").alias("node"), "key", "value", "value2")


@query(f"""WITH RECURSIVE {cte('fx_edge')}, c(doc, ancestor, descendant) AS (SELECT doc, node, node FROM fx_node UNION SELECT c.doc, c.ancestor, e.child FROM c JOIN fx_edge e ON e.doc = c.doc AND e.parent = c.descendant)
SELECT c.doc, c.ancestor AS node, 'eng' AS lang, 'AUX_label_eng' AS key, '{{doc:' || (descendant % 7) || '}}' AS value, (n.r || chr(9) || 'p ' || descendant) AS value2 FROM c JOIN fx_node n ON n.node = c.descendant""")
def src_labels(spark: SparkSession, d: str) -> DataFrame:
    """SRC-6: label files that input those of the node's children, all of one name in folders of their own."""
    n, e = view(spark, d, "fx_node"), view(spark, d, "fx_edge")
    up = F.concat(F.lit("\\@input{../../../../"), id_to_path(int_to_id(F.col("child"))), F.lit("/view_eng.aux}\n"))
    inputs = e.groupBy("doc", F.col("parent").alias("node")).agg(F.array_join(F.sort_array(F.collect_list(up)), "").alias("inputs"))
    own = F.concat(F.lit("\\relax\n\\newlabel{doc:"), (F.col("node") % 7).cast("string"), F.lit("}{{"), F.col("r").cast("string"), F.lit("}{p "), F.col("node").cast("string"), F.lit("}}\n"))
    rows = n.join(inputs, ["doc", "node"], "left").select(_folder("view_eng.aux").alias("path"), F.concat(own, F.coalesce("inputs", F.lit(""))).alias("text"))
    return files.read_labels(spark, _written(spark, rows)).drop("path")


@query(f"WITH {cte('fx_node')} SELECT doc, node, 'eng' AS lang, node % 50 AS user_id, md5(text) AS base_md5, md5(text || ' more') AS content FROM fx_node")
def src_edits(spark: SparkSession, d: str) -> DataFrame:
    """SRC-7: edit states in JSON files named after language and user."""
    state = F.to_json(F.struct(F.md5("text").alias("base_md5"), F.concat("text", F.lit(" more")).alias("content")))
    path = F.concat("doc", F.lit("/"), id_to_path(int_to_id(F.col("node"))), F.lit("/blob_eng_"), (F.col("node") % 50).cast("string"), F.lit("_editstate.json"))
    rows = files.read_edits(spark, _written(spark, view(spark, d, "fx_node").select(path.alias("path"), state.alias("text"))))
    return rows.where("ts is not null").select("doc", "node", "lang", "user_id", "base_md5", F.md5("content").alias("content"))


@query(f"WITH {cte('fx_word')}, p AS (SELECT DISTINCT chr(92) || w1 AS macro, chr(CAST(945 + node % 20 AS INTEGER)) AS symbol FROM fx_word WHERE w1 <> '') SELECT p.macro, p.symbol, (SELECT min(q.macro) FROM p q WHERE q.symbol = p.symbol) AS inverse FROM p")
def src_symbols(spark: SparkSession, d: str) -> DataFrame:
    """SRC-8: dictionaries of macros and code points in JSON, and their inverse; other names are left out."""
    w = view(spark, d, "fx_word")
    table = F.create_map(F.concat(F.lit("\\"), "w1"), F.col("node") % 20 + 945, F.concat("w1", F.lit("1")), F.lit(1))
    rows = w.select(F.concat("doc", F.lit("/"), F.col("node").cast("string"), F.lit(".json")).alias("path"), F.to_json(table).alias("text"))
    symbols = files.read_symbol_map(spark, _written(spark, rows) + "/*").distinct()
    return symbols.join(files.inverse_symbols(symbols).withColumnRenamed("macro", "inverse"), "symbol").select("macro", "symbol", "inverse")


@query("SELECT page_id, md5(html) AS md5 FROM pages")
def src_html(spark: SparkSession, d: str) -> DataFrame:
    """SRC-9: rendered pages as files."""
    rows = view(spark, d, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return files.read_html(spark, _written(spark, rows)).select(F.regexp_extract("path", "page([0-9]+)", 1).cast("long").alias("page_id"), F.md5("html").alias("md5"))


@query(f"WITH {cte('fx_edge')} SELECT e.doc, e.child, md5(n.text) AS md5 FROM fx_edge e JOIN fx_node n ON n.node = e.child")
def src_corpus(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10: a corpus saved as tables and loaded."""
    root = shared_path(spark, "corpus")
    files.save_corpus({"nodes": view(spark, d, "fx_node"), "edges": view(spark, d, "fx_edge")}, root)
    t = files.load_corpus(spark, root, ["nodes", "edges"])
    return t["edges"].join(t["nodes"].select("doc", F.col("node").alias("child"), "text"), ["doc", "child"]).select("doc", "child", F.md5("text").alias("md5"))


_EVEN = "CAST(substr(doc, 4) AS INTEGER) % 2 = 0"


@query(f"""WITH {cte('fx_node')} SELECT doc, node, CASE WHEN {_EVEN} THEN 'mark' ELSE 'note' END AS macro, CASE k WHEN 1 THEN lang ELSE CASE WHEN {_EVEN} THEN 'y' ELSE 'x' END END AS arg, CASE WHEN k = 2 THEN CASE WHEN {_EVEN} THEN 'raw' ELSE 'asis' END END AS env FROM fx_node, (VALUES (1), (2)) v(k)""")
def src_rules(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11: rules of segmentation from files, each document's own: what is a command and a verbatim body in every other
    one is neither in the rest."""
    n = view(spark, d, "fx_node")
    own = F.when(F.expr(_EVEN), F.array(F.lit("mark"), F.lit("asis"))).otherwise(F.array(F.lit("note"), F.lit("raw")))
    rule = F.to_json(F.create_map(F.lit("metadata_command"), F.array(own[0]), F.lit("verbatim_environment"), F.array(own[1])))
    root = _written(spark, n.select(F.concat("doc", F.lit("/"), F.col("node").cast("string"), F.lit(".json")).alias("path"), rule.alias("text")))
    both = lambda c: F.concat(F.lit("\\mark{"), c, F.lit("}\\note{"), c, F.lit("}"))
    text = F.concat(both(F.col("lang")), F.lit("\\begin{asis}"), both(F.lit("x")), F.lit("\\end{asis}\\begin{raw}"), both(F.lit("y")), F.lit("\\end{raw}\\label{a}"), F.coalesce("text", F.lit("")))
    rules = segment.document_rules(files.read_rules(spark, root))
    deep = segment.explode_deep(n.select("doc", "node", text.alias("text")), rules=rules)
    return deep.where("macro in ('mark', 'note', 'label')").select("doc", "node", "macro", "arg", "env")


@query(f"""WITH {cte('fx_node')} SELECT doc, node, CAST(CASE WHEN {_EVEN} THEN 1 ELSE 3 END AS BIGINT) AS pos, CASE WHEN {_EVEN} THEN 'thm' ELSE 'lem' END AS env, CASE WHEN {_EVEN} THEN lang ELSE '' END AS opt, doc || CASE WHEN {_EVEN} THEN 'a' ELSE 'b' END AS body FROM fx_node""")
def seg_discover_split(spark: SparkSession, d: str) -> DataFrame:
    """SEG-6: theorem-like environments that a document's first file declares split all of its files, and no other
    document's."""
    declared = F.when(F.col("r") == 1, F.concat(F.lit("\\newtheorem{"), F.when(F.expr(_EVEN), "thm").otherwise("lem"), F.lit("}{Name}\n"))).otherwise("")
    text = F.concat(declared, F.lit("\\begin{thm}["), "lang", F.lit("]"), "doc", F.lit("a\\end{thm}\\begin{lem}"), "doc", F.lit("b\\end{lem}\n"), "text")
    n = view(spark, d, "fx_node").select("doc", "node", text.alias("text"))
    return segment.environments(segment.explode_deep(n), segment.discover_environments(n))


@query(f"WITH {cte('fx_node')} SELECT doc, node, 'α' || text || '!' AS text FROM fx_node")
def text_filters(spark: SparkSession, d: str) -> DataFrame:
    """UDF-1, TXT-7: a chain of filters found by name, one of them the user's."""
    t = F.concat(F.lit("\\alpha{}"), "text")
    return view(spark, d, "fx_node").select("doc", "node", T.apply_filters(t, ["symbols", "bare", "shout"], {"shout": lambda c: F.concat(c, F.lit("!")), "bare": lambda c: F.replace(c, F.lit("{}"), F.lit(""))}).alias("text"))

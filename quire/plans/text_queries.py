"""Queries on languages, text transforms, segmentation and reassembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.fixtures import cte, view
from quire.functions import text as T
from quire.functions.ids import int_to_id
from quire.operators import activity, languages, reparse, segment, tree
from quire.plans.registry import query
from quire.plans.rules import SECTIONS, child_rules, child_rules_sql, kind_sql
from quire.plans.tree_queries import _id_sql, _walk_sql
from quire.scratch import shared_path
from quire.sources.commits import CorpusTables



def _nested(levels: int = 8) -> str:
    """An argument with so many levels of braces in it: the oracle's regular expressions are matched without recursion."""
    inner = r"[^{}]*"
    for _ in range(levels):
        inner = rf"[^{{}}]*(?:\{{{inner}\}}[^{{}}]*)*"
    return inner


_ARGUMENT = rf"\{{{_nested()}\}}"
_HEAD = rf"^\\[A-Za-z]+\*?(?:{segment.OPTION})*(?:{_ARGUMENT})?"
_PIECE = rf"^\\([A-Za-z]+)\*?(?:{segment.OPTION})*(?:\{{({_nested()})\}})?"
_BODIES = "|".join(rf"\\begin\{{{v}\*?\}}(?s:.*?)\\end\{{{v}\*?\}}" for v in segment.VERBATIM)
_VERB = r"\\verb\*?(?:\|[^|\n]*\||\+[^+\n]*\+|![^!\n]*!|/[^/\n]*/)"
_NAMES = "|".join([*SECTIONS, *segment.INPUTS, *segment.COMMANDS])
_MARKER = rf"({_BODIES}|{_VERB}|\\(?:begin|end)\{{[A-Za-z*]+\}}(?:{segment.OPTION})?|\\(?:{_NAMES})\*?(?:{segment.OPTION})*{_ARGUMENT}|\\(?:item|par)\b)|(\\[\\%])|%[^\n]*"

_PIECES = f"""{cte('fx_markup')},
m0 AS (SELECT doc, node, string_split(replace(replace(regexp_replace(translate(text, chr(1) || chr(2), '  '), '{_MARKER}', chr(1) || '\\1' || chr(2) || '\\2', 'g'), chr(1) || chr(2), ''), chr(2), ''), chr(1)) AS l FROM fx_markup),
m1 AS (SELECT doc, node, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM m0),
m2 AS (SELECT doc, node, CAST(pos AS BIGINT) AS pos, CASE WHEN pos > 0 THEN regexp_extract(raw, '{_PIECE}', 1) ELSE '' END AS macro, CASE WHEN pos > 0 THEN regexp_extract(raw, '{_PIECE}', 2) ELSE '' END AS arg,
 CASE WHEN pos > 0 THEN regexp_extract(raw, '{segment.BEGIN_OPTION}', 1) ELSE '' END AS opt, raw FROM m1),
m AS (SELECT doc, node, pos, CASE WHEN macro = 'begin' AND arg = 'verbatim' THEN 'verbatim' ELSE macro END AS macro, arg, opt, raw FROM m2),
p0 AS (SELECT *, sum(CASE macro WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY doc, node ORDER BY pos) AS depth FROM m),
p AS (SELECT *, CASE WHEN depth > 0 THEN last_value(CASE WHEN macro = 'begin' THEN arg END IGNORE NULLS) OVER (PARTITION BY doc, node, depth ORDER BY pos) END AS env FROM p0)"""


def _deep(spark: SparkSession, d: str) -> DataFrame:
    return segment.explode_deep(view(spark, d, "fx_markup"))


@query(f"WITH {_PIECES} SELECT doc, node, pos, macro, arg, opt, raw FROM m")
def seg_markers(spark: SparkSession, d: str) -> DataFrame:
    """SEG-1: pieces of marked-up texts, with arguments of six levels of braces, of 5,000 groups, and without an end."""
    return segment.explode_markers(view(spark, d, "fx_markup")).drop("size", "unclosed")


@query(f"""WITH {cte('fx_node')}, s AS (SELECT doc, node, 0 AS k, CASE node % 7 WHEN 1 THEN 1 ELSE 2 END AS "rank", lang AS title FROM fx_node WHERE node % 7 <> 0 UNION ALL SELECT doc, node, 1, 3, 'x' FROM fx_node WHERE node % 3 = 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY k) AS BIGINT) AS pos FROM s)
SELECT t.doc, t.node, t.pos, t.title, t.rank, u.node AS parent_node, u.pos AS parent_pos FROM t LEFT JOIN LATERAL (SELECT v.node, v.pos FROM t v WHERE v.doc = t.doc AND v.rank < t.rank AND (v.node, v.pos) < (t.node, t.pos) ORDER BY v.node DESC, v.pos DESC LIMIT 1) u ON TRUE""")
def seg_sections(spark: SparkSession, d: str) -> DataFrame:
    """SEG-2: chapters, sections and subsections around whole texts, and their parents across a document's files."""
    n = view(spark, d, "fx_node")
    head = F.when(F.col("node") % 7 == 0, "").when(F.col("node") % 7 == 1, F.concat(F.lit("\\chapter{"), "lang", F.lit("}"))).otherwise(F.concat(F.lit("\\section{"), "lang", F.lit("}")))
    tail = F.when(F.col("node") % 3 == 0, "\n\\subsection{x}").otherwise("")
    return segment.sections(segment.explode_markers(n.select("doc", "node", F.concat(head, "text", tail).alias("text"))))


@query(f"""WITH {_PIECES}, h AS (SELECT doc, node, pos AS p1, arg, opt FROM p WHERE macro = 'begin' AND depth = 1 AND arg = 'theorem'),
b AS (SELECT h.doc, h.node, h.p1, h.arg, h.opt, p.pos, CASE WHEN p.pos = h.p1 THEN regexp_replace(p.raw, '{segment.BEGIN_HEAD}', '') ELSE p.raw END AS t FROM h JOIN p ON p.node = h.node AND p.pos >= h.p1 AND p.depth > 0
 AND NOT EXISTS (SELECT 1 FROM p z WHERE z.node = h.node AND z.pos > h.p1 AND z.pos <= p.pos AND z.depth <= 0))
SELECT doc, node, p1 AS pos, arg AS env, opt, string_agg(t, '' ORDER BY pos) AS body FROM b GROUP BY doc, node, p1, arg, opt""")
def seg_environments(spark: SparkSession, d: str) -> DataFrame:
    """SEG-3: bodies of outermost theorems."""
    return segment.environments(_deep(spark, d), ("theorem",))


_BLANKS = "l AS (SELECT source AS doc, doc_id AS node, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n[ \\t]*\\n\\s*') AS l FROM documents)"


@query(f"""WITH {_BLANKS}, p AS (SELECT doc, node, unnest(l) AS p, unnest(range(len(l))) AS k FROM l) SELECT doc, node, CAST(k AS BIGINT) AS pos, p AS text, length(p) >= 80 AS child FROM p""")
def seg_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """SEG-5: paragraphs between blank lines, and which are long enough to stand alone (each line of the documents is a
    paragraph here)."""
    return segment.paragraphs(_spaced(spark, d), 80)


@query(f"""WITH {_BLANKS}, p AS (SELECT doc, node, unnest(l) AS p, unnest(range(len(l))) AS k FROM l)
SELECT doc, node, string_agg(CASE WHEN length(p) >= 80 THEN chr(92) || 'input{{PAR/' || k || '}}%' ELSE p END, chr(10) || chr(10) ORDER BY k) AS text FROM p GROUP BY doc, node""")
def seg_merge_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """SEG-5: what stays with the parents: short paragraphs, and inputs of the long ones."""
    return segment.without_paragraphs(_spaced(spark, d), 80)


def _spaced(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("node"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query(f"WITH {cte('fx_node')} SELECT DISTINCT doc, 'thm' || lang AS env FROM fx_node")
def seg_discover(spark: SparkSession, d: str) -> DataFrame:
    """SEG-6: theorem-like environments that texts declare."""
    n = view(spark, d, "fx_node").select("doc", F.concat(F.lit("\\newtheorem{thm"), "lang", F.lit("}{Theorem}\n"), "text").alias("text"))
    return segment.discover_environments(n)


_PROLOGUE = "'% start ' || chr(92) || 'documentclass{{no}}' || chr(10)"


@query(f"""WITH {cte('fx_node')} SELECT node, {_PROLOGUE} AS prologue, chr(92) || 'documentclass{{article}}' || chr(10) AS preamble, chr(92) || 'begin{{document}}' || chr(10) || text || chr(10) AS body, chr(92) || 'end{{document}}' || chr(10) || text AS epilogue FROM fx_node""".replace("{{", "{").replace("}}", "}"))
def seg_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """SEG-7: a whole document's four parts; a comment with a command in it doesn't count."""
    whole = F.concat(F.lit("% start \\documentclass{no}\n\\documentclass{article}\n\\begin{document}\n"), "text", F.lit("\n\\end{document}\n"), "text")
    return segment.front_matter(view(spark, d, "fx_node").select("node", whole.alias("text")), "node")


@query(f"""WITH {_PIECES}, i AS (SELECT doc, node, pos, regexp_replace(arg, '\\.tex$', '') AS path FROM m WHERE macro = 'input') SELECT i.doc, i.node, i.pos, i.path, t.node AS target FROM i LEFT JOIN fx_node t ON t.doc = i.doc AND 'f' || t.r = i.path""")
def seg_inputs(spark: SparkSession, d: str) -> DataFrame:
    """SEG-9, ATT-5: inputs joined to the files they name, several parents of one file included."""
    return _resolved(spark, d)


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "fx_node").select("doc", F.format_string("f%d", "r").alias("path"), F.col("node").alias("target"))
    return segment.resolve_inputs(segment.explode_markers(view(spark, d, "fx_markup")), files)


@query(f"""WITH {_PIECES}, i AS (SELECT i.doc, i.node, i.pos, t.node AS target FROM (SELECT doc, node, pos, regexp_replace(arg, '\\.tex$', '') AS path FROM m WHERE macro = 'input') i JOIN fx_node t ON t.doc = i.doc AND 'f' || t.r = i.path)
SELECT doc, node AS parent, target AS child, min(pos) AS ordinal, count(*) OVER (PARTITION BY doc, target) AS parents FROM i GROUP BY doc, node, target""")
def seg_input_nodes(spark: SparkSession, d: str) -> DataFrame:
    """SEG-9: one node for each file that is input, and edges from all that input it."""
    nodes, edges = segment.input_nodes(_resolved(spark, d))
    per = edges.groupBy("doc", "child").agg(F.count(F.lit(1)).alias("parents"))
    return edges.join(nodes.select("doc", F.col("node").alias("child")), ["doc", "child"]).join(per, ["doc", "child"]).select("doc", "parent", "child", "ordinal", "parents")


@query(f"""WITH {_PIECES}, i AS (SELECT p.doc, p.node, p.pos * 2 + k AS pos, macro, regexp_replace(arg, '\\.tex$', '') AS path, env AS context FROM p, (VALUES (0), (1)) v(k) WHERE macro = 'input'), j AS (SELECT i.*, t.node AS target FROM i LEFT JOIN fx_node t ON t.doc = i.doc AND 'f' || t.r = i.path)
SELECT doc, node, path, context, target, target IS NOT NULL AND row_number() OVER (PARTITION BY doc, node, target ORDER BY pos) > 1 AS again, target IS NULL AS bad FROM j""")
def attr_inputs(spark: SparkSession, d: str) -> DataFrame:
    """ATT-5: inputs with their context, repeated and bad ones told (each input is doubled here)."""
    m = view(spark, d, "fx_markup")
    twice = m.select("doc", "node", F.regexp_replace("text", r"(\\input\{[^{}]*\})", "$1$1").alias("text"))
    files = view(spark, d, "fx_node").select("doc", F.format_string("f%d", "r").alias("path"), F.col("node").alias("target"))
    found = segment.reparse_inputs(segment.explode_deep(twice), files)
    return found.select("doc", "node", "path", "context", "target", "again", "bad")


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "fx_node")
    files = n.select("doc", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")).distinct()
    files = files.select("doc", F.format_string("pic%d", "k").alias("path"), F.lit("pdf").alias("ext")).unionByName(files.where("k < 6").select("doc", F.format_string("pic%d", "k").alias("path"), F.lit("eps").alias("ext")))
    return segment.graphics(segment.explode_markers(view(spark, d, "fx_markup")), files)


_PICTURES = f"""{_PIECES}, g AS (SELECT m.doc, m.node, 'pic' || (r % 9) AS path, CASE WHEN r % 9 < 6 THEN 'eps,pdf' WHEN r % 9 = 6 THEN 'pdf' END AS extensions FROM m JOIN fx_node n ON n.node = m.node WHERE m.macro = 'includegraphics' AND m.arg = 'pic' || (r % 9) || '.png')"""


@query(f"WITH {_PICTURES} SELECT doc, node, path, extensions FROM g")
def seg_graphics(spark: SparkSession, d: str) -> DataFrame:
    """SEG-8: pictures and the extensions that there are."""
    return _pictures(spark, d)


@query(f"""WITH {_PICTURES}, k AS (SELECT doc, path, extensions, count(DISTINCT node) AS parents FROM g WHERE extensions IS NOT NULL GROUP BY doc, path, extensions)
SELECT doc, (SELECT max(node) FROM fx_node n WHERE n.doc = k.doc) + row_number() OVER (PARTITION BY doc ORDER BY path) AS node, 'graphic_file' AS environ, path, extensions, parents FROM k""")
def seg_graphic_nodes(spark: SparkSession, d: str) -> DataFrame:
    """SEG-8: a node for each picture that has a file."""
    return segment.graphic_nodes(_pictures(spark, d), view(spark, d, "fx_node"))


@query(f"""WITH RECURSIVE {cte('fx_edge')}, t AS (SELECT doc, parent, child, ordinal FROM fx_edge UNION ALL SELECT doc, node, node + 1000000, 1 FROM fx_node n WHERE NOT EXISTS (SELECT 1 FROM fx_edge e WHERE e.parent = n.node) UNION ALL SELECT doc, node + 1000000, node + 2000000, 1 FROM fx_node n WHERE NOT EXISTS (SELECT 1 FROM fx_edge e WHERE e.parent = n.node)),
s AS (SELECT doc, parent, min(child) AS only FROM t GROUP BY doc, parent HAVING count(*) = 1 AND parent % 2 = 0),
f(doc, parent, ordinal, child) AS (SELECT doc, parent, ordinal, child FROM t WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.doc = t.doc AND x.parent = t.parent) UNION ALL SELECT f.doc, f.parent, f.ordinal, s.only FROM f JOIN s ON s.doc = f.doc AND s.parent = f.child)
SELECT doc, parent, child, ordinal FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc = f.doc AND s.parent = f.child)""")
def seg_zip(spark: SparkSession, d: str) -> DataFrame:
    """SEG-12: nodes without words of their own that hold one child left out, with chains of them at the leaves."""
    n, e = view(spark, d, "fx_node"), view(spark, d, "fx_edge")
    leaves = n.join(e.select(F.col("parent").alias("node")), "node", "left_anti")
    more = lambda a, b: leaves.select("doc", (F.col("node") + a).alias("parent"), (F.col("node") + b).alias("child"), F.lit(1).cast("long").alias("ordinal"))
    rows = n.select("doc", "node", "text").unionByName(leaves.select("doc", (F.col("node") + 1000000).alias("node"), "text"))
    blank = F.when(F.col("node") % 2 == 0, F.regexp_replace("text", r"\S", " ")).otherwise(F.concat("text", F.lit(".")))
    return segment.zip_sections(rows.withColumn("text", blank), e.unionByName(more(0, 1000000)).unionByName(more(1000000, 2000000)))


@query(f"""WITH {cte('fx_environ')} SELECT doc, node, CASE WHEN environ IN ('main_file', 'graphic_file', 'E_document', 'input') THEN t ELSE chr(92) || 'uuid{{' || {_id_sql('node')} || '}}%' || chr(10) || t END AS text FROM (SELECT *, regexp_replace(text, '\\s+$', '') AS t FROM fx_environ) q""")
def seg_stamp(spark: SparkSession, d: str) -> DataFrame:
    """SEG-15: ids on top of segments."""
    return view(spark, d, "fx_environ").select("doc", "node", segment.stamp(F.col("text"), int_to_id(F.col("node")), F.col("environ")).alias("text"))


@query(f"""WITH {_PIECES} SELECT doc, node, 'unbalanced' AS code, '-1,-1' AS detail FROM fx_markup WHERE r % 6 = 0 UNION ALL SELECT doc, node, 'end', 'a,b' FROM fx_markup WHERE r % 6 <> 0 AND r % 8 = 1
UNION ALL SELECT doc, node, 'unclosed', 'label' FROM fx_markup WHERE r % 97 <> 5 AND r % 10 = 3 UNION ALL SELECT doc, node, 'absolute', '/etc/f' FROM fx_markup WHERE r % 6 <> 0 AND r % 8 = 1 UNION ALL SELECT m.doc, m.node, 'unknown', m.arg FROM m WHERE m.macro IN ('input', 'includegraphics') AND NOT starts_with(m.arg, '/') AND NOT EXISTS (SELECT 1 FROM fx_node t WHERE t.doc = m.doc AND 'f' || t.r = regexp_replace(m.arg, '\\.[a-z]+$', ''))""")
def seg_problems(spark: SparkSession, d: str) -> DataFrame:
    """SEG-16: unbalanced environments, ends of other kinds, absolute paths and unknown files."""
    files = view(spark, d, "fx_node").select("doc", F.format_string("f%d", "r").alias("path"))
    return segment.problems(_deep(spark, d), files)


@query(f"""WITH {cte('fx_environ')}, s AS (SELECT doc, node, environ AS pe, text, 3 AS start, 5 AS length, 'paragraph' AS environ FROM fx_environ UNION ALL SELECT doc, node, environ, text, CAST(length(text) // 2 AS INTEGER) + 6, 4, 'E_lemma' FROM fx_environ UNION ALL SELECT doc, node, environ, text, 5, 9, 'E_lemma' FROM fx_environ WHERE node % 2 = 0),
{child_rules_sql()}, k AS (SELECT *, NOT (start = 5) AND start + length <= length(text) + 1 AND EXISTS (SELECT 1 FROM rules r WHERE r.parent = {kind_sql('s.pe')} AND r.child = {kind_sql('s.environ')}) AS fits FROM s),
f AS (SELECT *, (SELECT max(node) FROM fx_node n WHERE n.doc = k.doc) + row_number() OVER (PARTITION BY doc ORDER BY node, start) AS child FROM k WHERE fits)
SELECT k.doc, k.node, k.start, f.child, CASE WHEN k.fits THEN substr(k.text, k.start, k.length) END AS child_text,
 CASE WHEN NOT EXISTS (SELECT 1 FROM f x WHERE x.node = k.node) THEN k.text ELSE coalesce((SELECT substr(k.text, 1, 2) || chr(92) || 'input{{UUID/' || x.child || '}}' FROM f x WHERE x.node = k.node AND x.start = 3), substr(k.text, 1, 7)) ||
 coalesce((SELECT substr(k.text, 8, x.start - 8) || chr(92) || 'input{{UUID/' || x.child || '}}' || substr(k.text, x.start + x.length) FROM f x WHERE x.node = k.node AND x.start > 5), substr(k.text, 8)) END AS stub_text
FROM k LEFT JOIN f ON f.node = k.node AND f.start = k.start""".replace("{{", "{").replace("}}", "}"))
def seg_carve(spark: SparkSession, d: str) -> DataFrame:
    """SEG-17: up to three ranges of each text carved out into children; overlapping and disallowed ones are refused."""
    n = view(spark, d, "fx_environ")
    two = n.select("doc", "node", F.lit(3).alias("start"), F.lit(5).alias("length"), F.lit("paragraph").alias("environ"))
    two = two.unionByName(n.select("doc", "node", (F.floor(F.length("text") / 2) + 6).cast("int").alias("start"), F.lit(4).alias("length"), F.lit("E_lemma").alias("environ")))
    two = two.unionByName(n.where("node % 2 = 0").select("doc", "node", F.lit(5).alias("start"), F.lit(9).alias("length"), F.lit("E_lemma").alias("environ")))
    return segment.carve(n, two, child_rules(spark)).drop("text")


@query(f"""WITH {_PIECES} SELECT doc, node, CASE WHEN env IS NOT NULL THEN 'S_E_' || env || '_' ELSE '' END || 'M_' || macro AS key, '{{' || arg || '}}' AS value FROM p WHERE macro IN ('label', 'ref', 'index')""")
def attr_reparse(spark: SparkSession, d: str) -> DataFrame:
    """ATT-4, SEG-13: attributes read from the texts again, with their innermost environment."""
    return segment.attributes(_deep(spark, d))


_HEADED = """chr(92) || 'cite{a' || r % 3 || ',b' || r % 2 || '}' || CASE WHEN r % 6 = 1 THEN chr(92) || 'uuid{00B}' ELSE '' END || CASE r % 5 WHEN 2 THEN chr(92) || 'index{rng|(}' || chr(92) || 'index{rng|)}' WHEN 3 THEN chr(92) || 'index{lone|(}' ELSE '' END || chr(10) || text"""
_AGAIN = f"""{_PIECES.replace(cte('fx_markup'), cte('fx_markup', 'fx_edge')).replace('FROM fx_markup)', 'FROM tx)').replace('m0 AS (', "tx AS (SELECT doc, node, r, " + _HEADED + " AS text FROM fx_markup), m0 AS (", 1)},
a0 AS (SELECT DISTINCT doc, node, CASE WHEN env IS NOT NULL THEN 'S_E_' || env || '_' ELSE '' END || 'M_' || macro AS key, '{{' || replace(arg, chr(10), ' ') || '}}' AS value FROM p WHERE macro IN ('label', 'ref', 'index', 'cite')),
a1 AS (SELECT DISTINCT doc, node, key, CASE WHEN key LIKE '%M_cite' THEN '{{' || unnest(string_split(trim(value, '{{}}'), ',')) || '}}' ELSE value END AS value FROM a0),
a AS (SELECT *, min(node) OVER (PARTITION BY doc, key, value) AS least FROM a1),
fresh AS (SELECT doc, node, key, value FROM a WHERE key NOT LIKE '%M_label' OR node = least),
e AS (SELECT i.doc, i.node AS parent, t.node AS child FROM p i JOIN fx_node t ON t.doc = i.doc AND 'f' || t.r = regexp_replace(i.arg, '\\.tex$', '') WHERE i.macro = 'input' GROUP BY ALL),
root AS (SELECT doc, min(node) AS node FROM fx_node GROUP BY doc),
w(doc, node, k, seen) AS (SELECT doc, node, 0, [node] FROM root UNION ALL SELECT w.doc, e.child, w.k + 1, list_append(w.seen, e.child) FROM w JOIN e ON e.doc = w.doc AND e.parent = w.node WHERE len(w.seen) = len(list_distinct(w.seen))),
o AS (SELECT doc, node, max(k) AS k FROM w GROUP BY doc, node),
c(doc, node, below) AS (SELECT e.doc, e.parent, e.child FROM e JOIN o ON o.doc = e.doc AND o.node = e.parent UNION SELECT c.doc, c.node, e.child FROM c JOIN e ON e.doc = c.doc AND e.parent = c.below),
marks AS (SELECT n.doc, c.below AS node, 'rangeindex' AS key, 'rng' AS value FROM fx_node n JOIN c ON c.doc = n.doc AND c.node = n.node WHERE n.r % 5 = 2 AND c.below <> n.node),
stored AS (SELECT doc, node, 'M_label' AS key, '{{doc:' || node || '}}' AS value FROM fx_node UNION ALL SELECT doc, node, 'M_ref', '{{old}}' FROM fx_node WHERE r % 7 = 0)"""


@query(f"""WITH RECURSIVE {_AGAIN}
SELECT doc, node, 'attr' AS kind, key, value FROM fresh UNION SELECT doc, node, 'attr', key, value FROM marks UNION ALL SELECT doc, node, 'attr', 'lang', lang FROM fx_node
UNION ALL SELECT doc, parent, 'edge', '1', CAST(child AS VARCHAR) FROM e UNION ALL SELECT n.doc, n.node, 'order', '', CAST(coalesce(o.k, 2147483647) AS VARCHAR) FROM fx_node n LEFT JOIN o ON o.doc = n.doc AND o.node = n.node
UNION ALL SELECT doc, node, 'report', 'NEW', key || ' ' || value FROM (SELECT * FROM fresh EXCEPT SELECT * FROM stored) x UNION ALL SELECT doc, node, 'report', 'DELETED', key || ' ' || value FROM (SELECT * FROM stored EXCEPT SELECT * FROM fresh) x
UNION ALL SELECT doc, parent, 'report', 'CHILD_NEW', CAST(child AS VARCHAR) FROM (SELECT * FROM e EXCEPT SELECT doc, parent, child FROM fx_edge) x UNION ALL SELECT doc, parent, 'report', 'CHILD_GONE', CAST(child AS VARCHAR) FROM (SELECT doc, parent, child FROM fx_edge EXCEPT SELECT * FROM e) x
UNION ALL SELECT doc, node, 'report', 'WRONG_UUID', '{{00B}}' FROM fx_node WHERE r % 6 = 1 AND node <> 10 UNION ALL SELECT doc, node, 'report', 'DUPLICATE_LABEL', key || ' ' || value FROM a WHERE key LIKE '%M_label' AND node > least
UNION ALL SELECT doc, node, 'report', 'RANGE_OPEN', ' lone' FROM fx_node WHERE r % 5 = 3 UNION ALL SELECT doc, node, 'report', 'UNCLOSED', 'label' FROM fx_node WHERE r % 97 <> 5 AND r % 10 = 3""")
def attr_reparse_all(spark: SparkSession, d: str) -> DataFrame:
    """ATT-13, ATT-8: the whole job over stored tables: texts parsed again, citations split, ranges and edges made anew, all
    committed together with a report, and read back."""
    m = view(spark, d, "fx_markup")
    head = F.expr(_HEADED.replace("chr(92) || '", "'" + 2 * chr(92)))
    own = m.select("doc", "node", F.lit("section").alias("environ"), head.alias("text"))
    stored = m.select("doc", "node", F.lit("M_label").alias("key"), F.format_string("{doc:%d}", "node").alias("value"))
    stored = stored.unionByName(m.where("r % 7 = 0").select("doc", "node", F.lit("M_ref").alias("key"), F.lit("{old}").alias("value"))).unionByName(m.select("doc", "node", F.lit("lang").alias("key"), F.col("lang").alias("value")))
    stored = stored.unionByName(m.where("r % 4 = 0").select("doc", "node", F.lit("rangeindex").alias("key"), F.lit("old").alias("value")))
    tables = CorpusTables(spark, shared_path(spark, "corpus-tables"))
    tables.commit({"segments": own, "attrs": stored, "edges": view(spark, d, "fx_edge")})
    files = m.select("doc", F.format_string("f%d", "r").alias("path"), F.col("node").alias("target"))
    made = reparse.reparse_corpus(tables, files, tree.roots_of(m), job="all")
    text = lambda c: F.col(c).cast("string")
    shown = {"attrs": ("attr", "node", F.col("key"), F.col("value")), "edges": ("edge", "parent", text("ordinal"), text("child")), "orders": ("order", "node", F.lit(""), text("order_in_document")), "report": ("report", "node", F.col("code"), F.col("detail"))}
    return reduce(DataFrame.unionByName, [tables.read(t, made).select("doc", F.col(n).alias("node"), F.lit(kind).alias("kind"), a.alias("key"), b.alias("value")) for t, (kind, n, a, b) in shown.items()])


@query(f"""{_walk_sql('fx_edge')}, o AS (SELECT w.doc, n.text, row_number() OVER (PARTITION BY w.doc ORDER BY w.path) AS place FROM w JOIN fx_node n ON n.node = w.node)
SELECT doc, CAST((place - 1) // {segment.PART} + 1 AS BIGINT) AS part, string_agg(text, chr(10) ORDER BY place) AS text FROM o GROUP BY ALL""")
def asm_assemble(spark: SparkSession, d: str) -> DataFrame:
    """ASM-1: whole documents from their segments, in numbered parts."""
    n = view(spark, d, "fx_node")
    return segment.assemble(n, tree.walk(view(spark, d, "fx_edge"), tree.roots_of(n)))


@query(f"""WITH {_PIECES.replace(cte('fx_markup'), cte('fx_markup', 'fx_environ'))}, q0 AS (SELECT doc, node, pos, macro, raw, regexp_replace(arg, '\\.[a-z]+$', '') AS path FROM m),
q AS (SELECT q0.doc, q0.node, q0.pos, CASE WHEN q0.macro IN ('input', 'include', 'bibliography') AND t.node IS NOT NULL THEN CASE WHEN t.environ IN ('section', 'subsection', 'paragraph') THEN chr(92) || t.environ || '{{node ' || t.r || '}}' ELSE '' END
 || chr(92) || 'uuidplaceholder{{' || t.node || '}}{{' || q0.path || '}}' || regexp_replace(q0.raw, '{_HEAD}', '') ELSE q0.raw END AS t FROM q0 LEFT JOIN fx_environ t ON t.doc = q0.doc AND 'f' || t.r = q0.path)
SELECT doc, node, string_agg(t, '' ORDER BY pos) AS text FROM q GROUP BY doc, node""")
def asm_squash(spark: SparkSession, d: str) -> DataFrame:
    """ASM-4: texts without comments, child inputs replaced by placeholders after their sections' titles."""
    targets = view(spark, d, "fx_environ").select("doc", F.format_string("f%d", "r").alias("path"), F.col("node").alias("target"), "environ", F.format_string("node %d", "r").alias("title"))
    return segment.squash(view(spark, d, "fx_markup"), targets)


@query(f"""WITH {cte('fx_edge')} SELECT n.doc, n.node, CASE WHEN access IN ('open', 'public') THEN text ELSE chr(92) || 'uuidplaceholder' || chr(10) || coalesce((SELECT string_agg(chr(92) || 'input{{' || child || '}}', chr(10) ORDER BY ordinal, child) FROM fx_edge e WHERE e.parent = n.node), '') END AS text FROM fx_node n""")
def asm_mask(spark: SparkSession, d: str) -> DataFrame:
    """ASM-5: a corpus without its private texts."""
    return segment.mask(view(spark, d, "fx_node"), view(spark, d, "fx_edge"))


@query(f"""WITH {cte('fx_environ')} SELECT doc, node, CASE WHEN environ IN ('main_file', 'E_document') THEN text ELSE chr(92) || 'documentclass{{' || CASE WHEN r % 2 = 0 THEN 'amsart' ELSE 'article' END || '}}' || chr(10) || chr(92) || 'def' || chr(92) || 'R{{r}}' || chr(10) || chr(92) || 'newif' || chr(92) || 'ifCDL' || lang || chr(92) || 'CDL' || lang || 'true' || chr(10) || chr(92) || 'title{{' || doc || '}}' || chr(10) || chr(92) || 'begin{{document}}' || chr(10) ||
 CASE WHEN environ = 'E_theorem' THEN chr(92) || 'begin{{theorem}}' || chr(10) || text || chr(10) || chr(92) || 'end{{theorem}}' || chr(10) ELSE text || chr(10) END || chr(92) || 'end{{document}}' || chr(10) END AS text FROM fx_environ""".replace("{{", "{").replace("}}", "}"))
def asm_standalone(spark: SparkSession, d: str) -> DataFrame:
    """ASM-7: segments that stand by themselves."""
    classname = F.when(F.col("r") % 2 == 0, "amsart")
    return view(spark, d, "fx_environ").select("doc", "node", segment.standalone(F.col("text"), F.col("environ"), F.col("doc"), classname, F.lit("\\def\\R{r}"), F.col("lang")).alias("text"))


# Mixed texts: line k of a document is English if k % 3 = 0, Italian if k % 3 = 1, else of any language; then two lines of
# any language, with a misplaced header and with an input.
_MUL = """l0 AS (SELECT source AS doc, doc_id + 1 AS node, len(string_split(text, chr(10))) AS n, list_concat(string_split(text, chr(10)), ['see ' || chr(92) || 'CDLeng x', chr(92) || 'input{UUID/0/0/1/blob_mul.tex}']) AS l FROM documents),
l AS (SELECT doc, node, n, x, k, CASE WHEN k < n THEN k % 3 ELSE 2 END AS h FROM (SELECT doc, node, n, unnest(l) AS x, unnest(range(len(l))) AS k FROM l0) q)"""


def _mul(spark: SparkSession, d: str) -> DataFrame:
    head = lambda i: F.when(i % 3 == 0, "\\CDLeng ").when(i % 3 == 1, "  \\CDLita ").otherwise("")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(head(i), x))
    tail = F.array(F.lit("see \\CDLeng x"), F.lit("\\input{UUID/0/0/1/blob_mul.tex}"))
    return view(spark, d, "documents").select(F.col("source").alias("doc"), (F.col("doc_id") + 1).alias("node"), F.lit("mul").alias("lang"), F.array_join(F.concat(lines, tail), "\n").alias("text"))


def _doc_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document is in English and Italian; the language-neutral kinds are no languages to derive."""
    return view(spark, d, "documents").select(F.col("source").alias("doc"), F.explode(F.array(*map(F.lit, ("eng", "ita", "mul", "zxx")))).alias("lang")).distinct()


_DERIVED = f"""{_MUL}, g AS (SELECT * FROM (VALUES ('eng', 0), ('ita', 1)) v(lang, m)),
j AS (SELECT doc, node, lang, string_agg(CASE WHEN k = n THEN x || '%misplaced language header' WHEN k = n + 1 THEN replace(x, 'blob_mul', 'blob_' || lang) ELSE x END, chr(10) ORDER BY k) AS t FROM l JOIN g ON h = m OR h = 2 GROUP BY doc, node, lang)"""


@query(f"""WITH {_DERIVED} SELECT doc, node, lang, '%% -*- lang: ' || lang || ' -*-' || chr(10) || '%% generated file, edits are lost' || chr(10) || t || chr(10) AS text FROM j""")
def lang_derive(spark: SparkSession, d: str) -> DataFrame:
    """LNG-1, LNG-2, LNG-3: language versions of mixed texts, in each document's languages."""
    return languages.derive(_mul(spark, d), _doc_languages(spark, d))


@query(f"""WITH {_DERIVED} SELECT doc, node, lang, t || chr(10) AS text FROM j""")
def lang_from_mul(spark: SparkSession, d: str) -> DataFrame:
    """LNG-8: mixed texts turned back into versions kept by hand."""
    return languages.from_mul(_mul(spark, d), _doc_languages(spark, d))


@query(f"""WITH {_MUL} SELECT doc, node, CAST(k + 1 AS BIGINT) AS line, CASE WHEN h <> 1 THEN CAST(sum(CASE WHEN h <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY k) AS BIGINT) END AS "to" FROM l""")
def lang_line_map(spark: SparkSession, d: str) -> DataFrame:
    """LNG-4: where lines of a mixed text stand in one language's."""
    return languages.map_lines(_mul(spark, d), "eng")


@query(f"""WITH {_MUL} SELECT doc, node, row_number() OVER (PARTITION BY node ORDER BY k) AS line, CAST(k + 1 AS BIGINT) AS "to" FROM l WHERE h <> 1""")
def lang_line_map_back(spark: SparkSession, d: str) -> DataFrame:
    """LNG-4: where lines of one language's text stand in the mixed one."""
    return languages.map_lines_back(languages.map_lines(_mul(spark, d), "eng"))


@query(f"""WITH {cte('fx_conv')}, f AS (SELECT node, lang, turn, string_split(text, chr(10)) AS l FROM fx_conv), l AS (SELECT node, lang, turn, unnest(l) AS text, unnest(range(len(l))) AS pos FROM f)
SELECT node, row_number() OVER (PARTITION BY node ORDER BY pos, turn) AS place, lang, text FROM l""")
def lang_multimerge(spark: SparkSession, d: str) -> DataFrame:
    """LNG-6: versions merged in turn."""
    lines = view(spark, d, "fx_conv").select("node", "lang", F.col("turn").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return languages.multimerge(lines, ["node"])


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Four versions of each document: as it is, with every third line another, without every fourth line, and with every
    fifth line twice."""
    n = view(spark, d, "documents").select(F.col("source").alias("doc"), (F.col("doc_id") + 1).alias("node"), F.split("text", "\n", -1).alias("l"))
    made = {
        "eng": F.col("l"),
        "ita": F.transform("l", lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("it "), x)).otherwise(x)),
        "fra": F.filter("l", lambda x, i: i % 4 != 2),
        "deu": F.flatten(F.transform("l", lambda x, i: F.when(i % 5 == 0, F.array(x, x)).otherwise(F.array(x)))),
    }
    return reduce(DataFrame.unionByName, [n.select("doc", "node", F.lit(lang).alias("lang"), F.array_join(l, "\n").alias("text")) for lang, l in made.items()])


@query()
def lang_lookahead(spark: SparkSession, d: str) -> DataFrame:
    """LNG-7: versions merged with common lines once (tested against a plain greedy loop, and that every version's lines
    come out whole and in order)."""
    return languages.multimerge_lookahead(_versions(spark, d)).drop("common")


@query("""WITH l AS (SELECT source AS doc, doc_id + 1 AS node, string_split(text, chr(10)) AS l FROM documents),
v AS (SELECT doc, node, 'eng' AS lang, l FROM l UNION ALL SELECT doc, node, 'ita', list_transform(l, lambda x, i: CASE WHEN i % 3 = 2 THEN 'it ' || x ELSE x END) FROM l
UNION ALL SELECT doc, node, 'fra', list_filter(l, lambda x, i: i % 4 <> 3) FROM l UNION ALL SELECT doc, node, 'deu', flatten(list_transform(l, lambda x, i: CASE WHEN i % 5 = 1 THEN [x, x] ELSE [x] END)) FROM l)
SELECT doc, node, lang, regexp_replace(array_to_string(l, chr(10)), '\\n$', '') || chr(10) AS text FROM v""")
def lang_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """LNG-8: four versions as one mixed text, and each got back from it."""
    versions = _versions(spark, d)
    return languages.from_mul(languages.to_mul(versions), versions.select("doc", "lang").distinct())


@query()
def lang_to_mul_many(spark: SparkSession, d: str) -> DataFrame:
    """LNG-8: several versions as one mixed text (``lang_round_trip`` gets each version back from it)."""
    return languages.to_mul(_versions(spark, d))


@query("""SELECT source AS doc, doc_id + 1 AS node, 'mul' AS lang, (SELECT string_agg(CASE WHEN trim(x) = '' THEN x ELSE chr(92) || 'CDL' || d.lang || ' ' || x END, chr(10) ORDER BY k) FROM (SELECT unnest(string_split(d.text, chr(10))) AS x, unnest(range(len(string_split(d.text, chr(10))))) AS k) q) || chr(10) || chr(92) || 'CDL' || d.lang || ' ' || chr(92) || 'input{SEC/a/blob_mul}' AS text FROM documents d""")
def lang_to_mul(spark: SparkSession, d: str) -> DataFrame:
    """LNG-8: versions in one language as mixed texts."""
    text = F.concat("text", F.lit("\n\\input{SEC/a/blob_"), "lang", F.lit("}"))
    return languages.to_mul(view(spark, d, "documents").select(F.col("source").alias("doc"), (F.col("doc_id") + 1).alias("node"), "lang", text.alias("text")))


@query(f"""WITH {cte('fx_version')} SELECT DISTINCT doc, node FROM fx_version WHERE lang = 'ita'""")
def lang_complete(spark: SparkSession, d: str) -> DataFrame:
    """LNG-8: nodes with all of their document's languages."""
    return languages.complete(view(spark, d, "fx_version"), _doc_languages(spark, d))


def _langs(n: DataFrame) -> DataFrame:
    return n.withColumn("langs", F.when(F.col("node") % 2 == 0, F.array(F.lit("eng"))).otherwise(F.array(F.lit("eng"), F.lit("ita"))))


@query()
def lang_untranslated(spark: SparkSession, d: str) -> DataFrame:
    """LNG-10: characters still to translate, markup counted as codes (tested against a loop)."""
    return languages.untranslated_chars(_langs(view(spark, d, "fx_markup")), ["eng", "ita"])


_VERSIONS = """s AS (SELECT doc, node, 'eng' AS lang, '.tex' AS ext FROM fx_local UNION ALL SELECT doc, node, 'ita', '.tex' FROM fx_local WHERE node % 2 = 1 UNION ALL SELECT doc, node, 'fra', x FROM fx_local CROSS JOIN (VALUES ('.pdf'), ('.svg'), ('.png')) e(x) WHERE node % 3 = 0 UNION ALL SELECT doc, node, 'mul', '.tex' FROM fx_local WHERE node % 5 = 0)"""


@query(f"""WITH {cte('fx_local', 'fx_user')}, {_VERSIONS},
q AS (SELECT n.doc, n.node, n.node % 50 AS user_id, CASE n.node % 4 WHEN 0 THEN 'deu' WHEN 1 THEN 'ita' WHEN 2 THEN 'fra' END AS want, CASE WHEN n.node % 6 = 3 THEN '.png' END AS want_ext, n.node % 2 = 0 AS edit FROM fx_local n),
p AS (SELECT doc, node, user_id, CASE WHEN edit AND node % 5 = 0 THEN 'mul' ELSE want END AS want, want_ext FROM q), w AS (SELECT user_id, CASE user_id % 2 WHEN 0 THEN 'fra' ELSE 'ita' END AS lang, 0.5 AS weight FROM fx_user)
SELECT p.doc || '/' || p.node AS request, p.doc, p.node, z.lang, z.ext FROM p LEFT JOIN LATERAL (SELECT s.lang, s.ext FROM s LEFT JOIN w ON w.user_id = p.user_id AND w.lang = s.lang WHERE s.doc = p.doc AND s.node = p.node AND (p.want IS NULL OR p.want = s.lang) AND (p.want_ext IS NULL OR p.want_ext = s.ext)
 ORDER BY coalesce(w.weight, 0) DESC, s.lang, CASE s.ext WHEN '.svg' THEN 2 WHEN '.png' THEN 4 WHEN '.pdf' THEN 7 ELSE 10 END LIMIT 1) z ON TRUE""")
def lang_choose(spark: SparkSession, d: str) -> DataFrame:
    """LNG-11: the version that a user gets; node numbers are a document's own."""
    n, u = view(spark, d, "fx_local"), view(spark, d, "fx_user")
    one = lambda rows, lang, ext: rows.select("doc", "node", F.lit(lang).alias("lang"), F.lit(ext).alias("ext"))
    s = one(n, "eng", ".tex").unionByName(one(n.where("node % 2 = 1"), "ita", ".tex")).unionByName(one(n.where("node % 5 = 0"), "mul", ".tex"))
    for ext in (".pdf", ".svg", ".png"):
        s = s.unionByName(one(n.where("node % 3 = 0"), "fra", ext))
    want = F.when(F.col("node") % 4 == 0, "deu").when(F.col("node") % 4 == 1, "ita").when(F.col("node") % 4 == 2, "fra")
    q = n.select(F.concat("doc", F.lit("/"), F.col("node").cast("string")).alias("request"), (F.col("node") % 50).alias("user_id"), "doc", "node", want.alias("want"), F.when(F.col("node") % 6 == 3, ".png").alias("want_ext"), (F.col("node") % 2 == 0).alias("edit"))
    w = u.select("user_id", F.when(F.col("user_id") % 2 == 0, "fra").otherwise("ita").alias("lang"), F.lit(0.5).alias("weight"))
    return languages.choose_version(q, s, w)


@query("SELECT doc_id, 'eng' || CASE WHEN doc_id % 2 = 0 THEN ',ita' ELSE '' END AS langs, lang || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ',IT' END AS bad FROM documents")
def lang_valid(spark: SparkSession, d: str) -> DataFrame:
    """LNG-12: malformed codes reported and dropped from language lists."""
    langs = F.array(F.lit("eng"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "ita").otherwise("IT"))
    found = languages.malformed_languages(view(spark, d, "documents").select("doc_id", langs.alias("langs")))
    return found.select("doc_id", F.array_join(languages.valid_languages(F.col("langs")), ",").alias("langs"), F.array_join("bad", ",").alias("bad"))


@query(f"WITH {cte('fx_environ')} SELECT doc, node, CASE WHEN r % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN environ IN {segment.NO_ID} THEN 0 ELSE 1 END AS n FROM fx_environ")
def lang_prologue(spark: SparkSession, d: str) -> DataFrame:
    """LNG-5: hidden lines of stored segments."""
    lang = F.when(F.col("r") % 4 == 0, "mul").otherwise(F.col("lang"))
    return view(spark, d, "fx_environ").select("doc", "node", languages.prologue_length(lang, F.col("environ")).alias("n"))


def _turns_sql(s: str, mark: str, left: str, right: str) -> str:
    return f"list_aggregate(list_transform(string_split({s}, '{mark}'), lambda x, i: CASE WHEN i = 1 THEN x WHEN i % 2 = 0 THEN chr(92) || '{left}' || x ELSE chr(92) || '{right}' || x END), 'string_agg', '')"


_HIDDEN = "replace(replace(replace(replace(text, '% $x$', '% ' || chr(1) || 'x' || chr(1)), 'verb|$z$ ', 'verb|' || chr(1) || 'z' || chr(1) || ' '), '$$', chr(2)), '$', chr(3))"
_SHOWN = _turns_sql(_turns_sql(_HIDDEN, "\x02", "[", "]"), "\x03", "(", ")")


@query(f"""WITH {cte('fx_markup')} SELECT doc, node, replace({_SHOWN}, chr(1), '$') AS text FROM fx_markup""")
def text_dedollarize(spark: SparkSession, d: str) -> DataFrame:
    """TXT-1: math delimiters in whole texts, verbatim bodies left alone."""
    return view(spark, d, "fx_markup").select("doc", "node", T.dedollarize(F.col("text")).alias("text"))


@query(f"""WITH {cte('fx_markup')} SELECT doc, node, text || 'α' || r || ' β ' || chr(92) || 'betaX ≤ ' || text || 'ψ∑' AS text FROM fx_markup""")
def text_symbols(spark: SparkSession, d: str) -> DataFrame:
    """TXT-3, TXT-4: symbols for macros in whole texts, with a macro of the user's."""
    t = F.concat("text", F.lit("\\alpha"), F.col("r").cast("string"), F.lit(" \\beta \\betaX \\le "), "text", F.lit("\\own\\sum"))
    return view(spark, d, "fx_markup").select("doc", "node", T.symbols_to_unicode(t, {"own": "ψ"}).alias("text"))


@query(f"""WITH {cte('fx_markup')} SELECT doc, node, text || 'ũè' || r || ' ü' || text AS text FROM fx_markup""")
def text_accents(spark: SparkSession, d: str) -> DataFrame:
    """TXT-2: accent macros in whole texts."""
    t = F.concat("text", F.lit("\\~u\\`{e}"), F.col("r").cast("string"), F.lit(' \\"u'), "text")
    return view(spark, d, "fx_markup").select("doc", "node", T.accents_to_unicode(t).alias("text"))


@query(f"""WITH {cte('fx_markup')} SELECT doc, node, regexp_replace(text, '(\\\\item|\\\\begin\\{{[^}}]*\\}}|\\\\end\\{{[^}}]*\\}})', '\\1' || chr(10), 'g') AS text FROM fx_markup""")
def text_break(spark: SparkSession, d: str) -> DataFrame:
    """TXT-5: new lines after structure."""
    return view(spark, d, "fx_markup").select("doc", "node", T.break_structure(F.col("text")).alias("text"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\n+|\\n+$', '', 'g') || chr(10) AS text FROM documents""")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    """TXT-6, TXT-7: normal form, through a chain of filters."""
    return view(spark, d, "documents").select("doc_id", T.apply_filters(F.col("text"), ["normalize"]).alias("text"))


def _html_sql(c: str) -> str:
    s = f"regexp_replace({c}, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g')"
    for entity, char in T.ENTITIES.items():
        s = f"replace({s}, '{entity}', {'chr(39)' if char == chr(39) else 'chr(160)' if char == chr(160) else repr(char)})"
    return f"trim(regexp_replace({s}, '[ \\t\\r\\n]+', ' ', 'g'))"


@query(f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def text_html(spark: SparkSession, d: str) -> DataFrame:
    """TXT-9, SRC-9: texts of pages."""
    return view(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, CAST(k AS BIGINT) AS line, x AS text FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS k FROM (SELECT doc_id, list_concat(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.;\\])}]) ', '\\1' || chr(10), 'g'), chr(10)), [chr(92) || '[ a. b' || chr(92) || ']', 'end']) AS l FROM documents) a) b""")
def text_catalog_lines(spark: SparkSession, d: str) -> DataFrame:
    """TXT-10: catalog lines before packing, math apart."""
    lines = T.catalog_lines(F.concat(F.coalesce("text", F.lit("")), F.lit(" \\label{x} \\[ a. b\\] end")))
    # an empty text is an empty line, none is no line
    own = F.when(F.col("text").isNull(), F.filter(lines, lambda x: x != "")).otherwise(lines)
    return view(spark, d, "documents").select("doc_id", F.posexplode(own).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


@query()
def text_packed_lines(spark: SparkSession, d: str) -> DataFrame:
    """TXT-10: catalog lines packed to 60 characters (tested against a loop)."""
    return view(spark, d, "documents").select("doc_id", F.posexplode(T.packed_lines(T.catalog_lines(F.col("text")))).alias("line", "text"))


@query("""SELECT doc_id, CAST(1 + length(substr(text, 1, p)) - length(replace(substr(text, 1, p), chr(10), '')) AS BIGINT) AS line, CAST(length(regexp_extract(substr(text, 1, p), '([^\\n]*)$', 1)) AS BIGINT) AS "char", p AS back FROM (SELECT doc_id, text, CAST(length(text) * (doc_id % 7 + 1) // 8 AS BIGINT) AS p FROM documents) q""")
def text_positions(spark: SparkSession, d: str) -> DataFrame:
    """TXT-13: offsets anywhere in the texts to lines and back."""
    t = view(spark, d, "documents").select("doc_id", "text", F.floor(F.length("text") * (F.col("doc_id") % 7 + 1) / 8).cast("int").alias("p"))
    r = t.select("doc_id", "text", T.pos_to_linechar(F.col("text"), F.col("p")).alias("p")).select("doc_id", "text", F.col("p.line").cast("long").alias("line"), F.col("p.char").cast("long").alias("char"))
    return r.select("doc_id", "line", "char", T.linechar_to_pos(F.col("text"), F.col("line"), F.col("char")).cast("long").alias("back"))


_PAGE = """p AS (SELECT page_id, html, page_id % 3 = 0 AS child, page_id % 4 = 0 AS lit FROM pages)"""


@query(f"""WITH {_PAGE} SELECT page_id, replace(replace(regexp_replace(replace(html, '<img src="images/', '<img src="/UUID/P' || page_id || '/html/images/'), '(<a [^>]*?href=")(/[^"#?]*|[^"#?:]*\\.html)(#[^"]*)?"', '\\1\\2?lang=eng\\3"', 'g'), '</head>', '<link rel="alternate" hreflang="it" href="/it"/></head>'), '<html>', '<html lang="en">')
 || '<a href="/UUID/P' || page_id || '/x?lang=eng" class="btn btn-sm">own</a><a href="/UUID/Pz?lang=eng#a" class="btn btn-sm btn-outline-' || CASE WHEN child THEN 'success' ELSE 'dark' END || CASE WHEN lit THEN ' bg-warning' ELSE '' END || '">z</a><img src="/UUID/P' || page_id || '/html/images/a.png">' AS html FROM p""")
def text_links(spark: SparkSession, d: str) -> DataFrame:
    """TXT-12: pages made ready to be served: links, pictures, language, alternates."""
    own = F.concat(F.lit("P"), F.col("page_id").cast("string"))
    page = F.concat("html", F.lit('<a href="@HERE@'), own, F.lit('/x">own</a><a href="@HERE@Pz#a">z</a><img src="images/a.png">'))
    children = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("Pz"), F.lit("Py"))).otherwise(F.array(F.lit("Py")))
    alternates = F.array(F.struct(F.lit("it").alias("lang"), F.lit("/it").alias("href")))
    shown = T.rewrite_links(page, "@HERE@", "/UUID/", own, F.lit("eng"), children, F.when(F.col("page_id") % 4 == 0, "Pz").otherwise(""), alternates)
    return view(spark, d, "pages").select("page_id", shown.alias("html"))


@query(f"""WITH {cte('fx_edit')}, o AS (SELECT e.event_id, unnest(string_split(n.text, chr(10))) AS x FROM fx_edit e JOIN fx_node n ON n.node = e.node), w AS (SELECT event_id, unnest(string_split(content, chr(10))) AS x FROM fx_edit),
oc AS (SELECT event_id, x, count(*) AS c FROM o GROUP BY 1, 2), wc AS (SELECT event_id, x, count(*) AS c FROM w GROUP BY 1, 2),
z AS (SELECT event_id, c, 0 AS k FROM wc UNION ALL SELECT event_id, -c, 0 FROM oc WHERE FALSE), j AS (SELECT wc.event_id, wc.c - coalesce(oc.c, 0) AS dlt FROM wc LEFT JOIN oc ON oc.event_id = wc.event_id AND oc.x = wc.x UNION ALL SELECT oc.event_id, -oc.c FROM oc LEFT JOIN wc ON oc.event_id = wc.event_id AND oc.x = wc.x WHERE wc.x IS NULL)
SELECT event_id, CAST(sum(CASE WHEN dlt > 0 THEN dlt ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN dlt < 0 THEN -dlt ELSE 0 END) AS BIGINT) AS removed FROM j GROUP BY event_id""")
def text_line_diff(spark: SparkSession, d: str) -> DataFrame:
    """TXT-15: how many lines edits add and remove."""
    both = view(spark, d, "fx_edit").join(view(spark, d, "fx_node").select("node", "text"), "node")
    return T.line_changes(both, ["event_id"], "text", "content")


@query(f"""WITH {cte('fx_edit')} SELECT e.event_id, md5(e.content) AS newer, md5(n.text) AS older FROM fx_edit e JOIN fx_node n ON n.node = e.node""")
def text_diff(spark: SparkSession, d: str) -> DataFrame:
    """TXT-15: line differences of edits; both texts can be had from each again."""
    both = view(spark, d, "fx_edit").join(view(spark, d, "fx_node").select("node", "text"), "node").select("event_id", T.line_diff(F.col("text"), F.col("content")).alias("diff"))
    return both.select("event_id", F.md5(T.patched(F.col("diff"))).alias("newer"), F.md5(T.patched(F.col("diff"), "-")).alias("older"))


@query(f"""WITH {_MUL}, n AS (SELECT node, k, sum(CASE WHEN h <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY k) AS t FROM l) SELECT node, CAST(1 AS BIGINT) AS at, CAST(min(k) + 1 AS BIGINT) AS line FROM n WHERE t = 1 GROUP BY node""")
def activity_rebase(spark: SparkSession, d: str) -> DataFrame:
    """ACT-5: error lines of a generated version (line 3, two hidden) brought back to the mixed text."""
    errors = _mul(spark, d).select("doc", "node", F.lit(3).alias("at"))
    return activity.rebase_errors(errors, languages.map_lines(_mul(spark, d), "eng"), 2).select("node", "at", "line")

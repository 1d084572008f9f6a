"""Queries on protection, files, headers, language versions and further audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.fixtures import cte, view
from quire.functions import protect
from quire.operators import access, audit, index, languages, segment, tree
from quire.plans.registry import query
from quire.plans.tree_queries import _walk_sql


@query(f"WITH {cte('fx_markup')} SELECT doc, node, text, FALSE AS shows FROM fx_markup")
def text_protect(spark: SparkSession, d: str) -> DataFrame:
    """TXT-8: markup protected and restored; ``shows`` tells whether any is left in the protected text."""
    m = view(spark, d, "fx_markup").withColumn("toks", protect.tokens(F.col("text")))
    p = m.withColumn("p", protect.protect(F.col("text"), F.col("toks")))
    return p.select("doc", "node", protect.restore(F.col("p"), F.col("toks")).alias("text"), F.col("p").contains("\\").alias("shows"))


@query(f"""WITH {cte('fx_markup')} SELECT doc, node, doc || ' ' || chr(92) || 'emph{{' || lang || '}}' AS title, chr(92) || 'section{{' || doc || ' ' || chr(92) || 'emph{{' || lang || '}}}}' || chr(10) AS header, substr(text, 20 + length(doc) + length(lang)) AS body, md5(text) AS whole FROM fx_markup""")
def text_headers(spark: SparkSession, d: str) -> DataFrame:
    """TXT-11: hidden headers and editable bodies, and both put together again."""
    parts = view(spark, d, "fx_markup").select("doc", "node", segment.split_header(F.col("text")).alias("s"))
    return parts.select("doc", "node", "s.title", "s.header", "s.body", F.md5(segment.join_header(F.col("s"))).alias("whole"))


@query(f"""{_walk_sql('fx_edge')}, f AS (SELECT w.doc, w.node, w.path, coalesce((SELECT 'f' || a.r FROM w v JOIN fx_node a ON a.node = v.node WHERE v.doc = w.doc AND starts_with(w.path, v.path) AND a.r % 4 = 1 ORDER BY length(v.path) DESC LIMIT 1), '') AS file FROM w),
o AS (SELECT f.doc, f.file, n.text, row_number() OVER (PARTITION BY f.doc, f.file ORDER BY f.path) AS place FROM f JOIN fx_node n ON n.node = f.node WHERE f.file <> '')
SELECT doc, file, CAST((place - 1) // {segment.PART} + 1 AS BIGINT) AS part, string_agg(text, chr(10) ORDER BY place) AS text FROM o GROUP BY ALL""")
def asm_files(spark: SparkSession, d: str) -> DataFrame:
    """ASM-2: original files."""
    n = view(spark, d, "fx_node").withColumn("original_filename", F.when(F.col("r") % 4 == 1, F.format_string("f%d", "r")))
    return segment.assemble_files(n, tree.walk(view(spark, d, "fx_edge"), tree.roots_of(n)))


@query(f"WITH {cte('fx_node')} SELECT doc, node, '% begin' || chr(10) || text || chr(10) || chr(92) || 'includegraphics[width=1cm]{{pic' || r || '}} ' || text || chr(10) || '% end' || chr(10) AS text FROM fx_node".replace("{{", "{").replace("}}", "}"))
def asm_restore(spark: SparkSession, d: str) -> DataFrame:
    """ASM-3: old commands back in place, id header and checkpoints gone, between comments."""
    r = F.col("r").cast("string")
    t = F.concat(F.lit("\\uuid{00"), r, F.lit("}%\n"), "text", F.lit("\n\\UUIDcheckpoint{1}\n\\includegraphics[width=1cm]{UUID/0/0/1/pic"), r, F.lit("} "), "text")
    return view(spark, d, "fx_node").select("doc", "node", segment.restore_commands(t, comments=True).alias("text"))


@query(f"""WITH RECURSIVE {cte('fx_edge_defect', 'fx_environ')}, reach(doc, node) AS (SELECT doc, min(node) FROM fx_node GROUP BY doc UNION SELECT e.doc, e.child FROM reach x JOIN fx_edge_defect e ON e.doc = x.doc AND e.parent = x.node)
SELECT x.doc, x.node, CASE WHEN (n.access IN ('open', 'public') AND n.lang = 'en') OR n.environ = 'input' THEN n.text ELSE chr(92) || 'uuidplaceholder' || chr(10) || coalesce((SELECT string_agg(chr(92) || 'input{{' || child || '}}', chr(10) ORDER BY ordinal, child) FROM fx_edge_defect e WHERE e.doc = x.doc AND e.parent = x.node), '') END AS text
FROM reach x LEFT JOIN fx_environ n ON n.doc = x.doc AND n.node = x.node""".replace("{{", "{").replace("}}", "}"))
def asm_mask_tree(spark: SparkSession, d: str) -> DataFrame:
    """ASM-6: the masked corpus of one language: reachable nodes, missing ones too, and kinds that are always copied."""
    n, e = view(spark, d, "fx_environ"), view(spark, d, "fx_edge_defect")
    return segment.mask_tree(n, e, tree.reachable(e, tree.roots_of(n)), "en", kept=("input",))


@query(f"WITH {cte('fx_node')} SELECT doc, node, CASE WHEN r % 4 = 0 THEN 'option' WHEN r % 3 = 0 THEN 'preamble_' || lang ELSE 'preamble_doc' END AS preamble FROM fx_node")
def asm_preamble(spark: SparkSession, d: str) -> DataFrame:
    """ASM-8: the preamble of each node, by priority."""
    n = view(spark, d, "fx_node")
    c = n.where("r % 4 = 0").select("doc", "node", F.lit("option").alias("preamble"), F.lit(0).alias("rank"))
    c = c.unionByName(n.where("r % 3 = 0").select("doc", "node", F.concat(F.lit("preamble_"), "lang").alias("preamble"), F.lit(1).alias("rank")))
    return segment.choose_preamble(c.unionByName(n.select("doc", "node", F.lit("preamble_doc").alias("preamble"), F.lit(2).alias("rank"))))


@query(f"WITH {cte('fx_markup')} SELECT n.doc, n.node, x.name, CASE WHEN x.name = 'bib' || (n.r % 3) AND n.r % 3 > 0 THEN n.r % 3 END AS target FROM fx_markup n, LATERAL (SELECT 'bib' || (n.r % 3) AS name UNION ALL SELECT 'amsrefs') x")
def seg_references(spark: SparkSession, d: str) -> DataFrame:
    """SEG-11: bibliographies in whole texts, local and external."""
    m = view(spark, d, "fx_markup")
    files = m.select("doc", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).distinct().select("doc", F.format_string("bib%d", "k").alias("name"), F.col("k").cast("long").alias("target"))
    return segment.references(segment.explode_markers(m), files, "bibliography")


@query(f"WITH {cte('fx_environ')} SELECT doc, node, CASE WHEN environ = 'graphic_file' THEN 'zxx' ELSE 'eng' END AS lang, CASE WHEN environ = 'E_theorem' THEN 'private' ELSE 'open' END AS access, '.' || string_split(substr(exts, 2), ',')[1] AS extension, 'file' || r AS alias, 'ann,bob' AS authors FROM fx_environ")
def seg_init(spark: SparkSession, d: str) -> DataFrame:
    """SEG-14: default fields of new nodes."""
    path = F.concat(F.lit("folder/file"), F.col("r").cast("string"), F.get(F.split("exts", ","), F.lit(0)))
    return segment.init_nodes(view(spark, d, "fx_environ").withColumn("path", path), ("E_theorem",), ["bob", "ann"], "eng")


@query(f"WITH {cte('fx_node')} SELECT doc, node, CASE WHEN lang = 'de' THEN 'nl' ELSE lang END AS lang FROM fx_node WHERE lang <> 'fr' UNION ALL SELECT doc, node, 'it' FROM fx_node WHERE lang = 'en' UNION ALL SELECT doc, node, 'fr' FROM fx_node WHERE lang = 'fr'")
def lang_versions(spark: SparkSession, d: str) -> DataFrame:
    """LNG-9: versions copied, relabelled and dropped (a node's last version stays)."""
    s = view(spark, d, "fx_node").select("doc", "node", "lang")
    return languages.drop_language(languages.relabel(languages.add_language(s, "en", "it"), "de", "nl"), "fr")


@query(f"""WITH {cte('fx_node', 'fx_member')}, b AS (SELECT doc, node, row_number() OVER (PARTITION BY doc ORDER BY node) AS k FROM fx_node WHERE r % 20 = 0),
u AS (SELECT user_id, doc, bool_or(grp = 'editors') AS e FROM fx_member GROUP BY user_id, doc) SELECT u.user_id, u.doc, b.node FROM u JOIN b ON b.doc = u.doc WHERE u.e OR b.k = 1""")
def index_bibliographies(spark: SparkSession, d: str) -> DataFrame:
    """IDX-7: bibliographies that users see."""
    n = view(spark, d, "fx_node").withColumn("environ", F.when(F.col("r") % 20 == 0, "bibliography").otherwise("section"))
    return index.bibliography_nodes(n, access.staff(view(spark, d, "fx_member"), view(spark, d, "fx_local_author").limit(0)))


@query(f"WITH {cte('fx_attr')}, q AS (SELECT DISTINCT regexp_extract(text, '([A-Za-z]+)', 1) AS token FROM benchmark), e AS (SELECT doc, node, CASE key WHEN 'M_index' THEN '' ELSE substr(key, 9) END AS lang, string_split(substr(value, 2, length(value) - 2), '|')[1] AS s FROM fx_attr WHERE key LIKE 'M_index%') SELECT DISTINCT q.token, e.doc, e.node, e.lang, replace(coalesce(string_split(s, '@')[2], s), '!', ', ') AS key FROM e JOIN q ON contains(replace(coalesce(string_split(s, '@')[2], s), '!', ', '), q.token) WHERE q.token <> ''")
def search_index(spark: SparkSession, d: str) -> DataFrame:
    """SRCH-3: index entries that contain a token."""
    tokens = view(spark, d, "benchmark").select(F.regexp_extract("text", "([A-Za-z]+)", 1).alias("token")).distinct()
    return index.search_index(index.entries(view(spark, d, "fx_attr")), tokens)


@query(f"""WITH {cte('fx_markup')} SELECT n.doc, n.node, v.number, CASE v.number WHEN 1 THEN 'first ' || n.r ELSE 'second' END AS text FROM fx_markup n CROSS JOIN (VALUES (1), (2)) v(number)""")
def seg_items(spark: SparkSession, d: str) -> DataFrame:
    """SEG-4: list items of whole texts."""
    found = segment.items(segment.explode_deep(view(spark, d, "fx_markup")))
    return found.select("doc", "node", "number", F.regexp_replace("text", "\n$", "").alias("text"))


@query(f"WITH {cte('fx_node')} SELECT n.doc, t.node, n.node AS parent FROM fx_node n JOIN fx_node t ON t.doc = n.doc AND t.r = 1 WHERE n.r % 9 = 0")
def seg_recursive(spark: SparkSession, d: str) -> DataFrame:
    """SEG-10: inputs that lead back to where they came from."""
    n, e = view(spark, d, "fx_node"), view(spark, d, "fx_edge")
    top = tree.roots_of(n)
    back = n.where("r % 9 = 0").select("doc", "node").join(top, "doc").select("doc", "node", F.col("root").alias("target"))
    i = e.select("doc", F.col("parent").alias("node"), F.col("child").alias("target")).unionByName(back)
    return segment.recursive_inputs(i, top)


@query()
def lang_translate(spark: SparkSession, d: str) -> DataFrame:
    """UDF-3: a translator between protection and restoring (here one that shouts), over whole texts (tested against a
    loop)."""
    s = view(spark, d, "fx_markup").select("doc", "node", F.lit("eng").alias("lang"), "text")
    return languages.translate(s, lambda t, old, new: t.upper(), "eng", "xxx")

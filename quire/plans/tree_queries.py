"""Queries on ids, trees and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.fixtures import cte, view
from quire.functions import ids
from quire.operators import attrs, audit, hashes, tree
from quire.plans.registry import query
from quire.plans.rules import SECTIONS, child_rules, child_rules_sql, extension_rules, extension_rules_sql, kind_sql
from quire.scratch import shared_path


def _id_sql(x: str) -> str:
    """Base 30 of a number below 30**5, with the alphabet of ids, in SQL."""
    d = "'0123456789BCDFGHJKMNPQRSTVWXYZ'"
    digit = lambda k: f"substr({d}, CAST(({x} // {30**k}) % 30 AS INTEGER) + 1, 1)"
    low = " || ".join(digit(k) for k in (2, 1, 0))
    return f"(CASE WHEN {x} >= {30**4} THEN {digit(4)} || {digit(3)} WHEN {x} >= {30**3} THEN {digit(3)} ELSE '' END || {low})"


@query(f"SELECT doc_id, {_id_sql('doc_id')} AS id, doc_id AS back, 'UUID/' || substr({_id_sql('doc_id')}, 1, 1) || '/' || substr({_id_sql('doc_id')}, 2, 1) || '/' || substr({_id_sql('doc_id')}, 3) AS path, {_id_sql('doc_id')} AS from_path FROM documents")
def ids_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """IDS-1, IDS-2, IDS-4: number to id, id to number, id to directory and back."""
    i = ids.int_to_id(F.col("doc_id"))
    return view(spark, d, "documents").select("doc_id", i.alias("id"), ids.id_to_int(i).alias("back"), ids.id_to_path(i).alias("path"), ids.path_to_id(F.concat(ids.id_to_path(i), F.lit("/blob_eng.tex"))).alias("from_path"))


_WORDS = "w AS (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split_regex(text, '[^A-Za-z0-9]+') AS l FROM documents) q)"


@query(f"""WITH {_WORDS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN regexp_matches(t, '^[0-9BCDFGHJKMNPQRSTVWXYZ]+$') THEN t END AS id FROM
 (SELECT doc_id, pos, lpad(s, CAST(greatest(3, length(s)) AS INTEGER), '0') AS t FROM (SELECT doc_id, pos, translate(upper(word), 'ILO', '110') AS s FROM w WHERE length(word) BETWEEN 3 AND 8) a) b""")
def ids_normalize(spark: SparkSession, d: str) -> DataFrame:
    """IDS-3: every word of the texts that could be an id, as people write them; null where a symbol is not of the
    alphabet."""
    words = view(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "[^A-Za-z0-9]+", -1)).alias("pos", "word")).where("length(word) between 3 and 8")
    return words.select("doc_id", F.col("pos").cast("long").alias("pos"), ids.normalize_id(F.col("word")).alias("id"))


@query(f"""WITH {cte('fx_node')} SELECT doc, doc_id, (SELECT max(node) FROM fx_node m WHERE m.doc = n.doc) + row_number() OVER (PARTITION BY doc ORDER BY r) AS new_node FROM fx_node n WHERE r % 3 = 0""")
def ids_allocate(spark: SparkSession, d: str) -> DataFrame:
    """IDS-5: new ids after a document's greatest, in order."""
    n = view(spark, d, "fx_node")
    return audit.allocate_ids(n.where("r % 3 = 0"), n).select("doc", "doc_id", "new_node")


@query()
def ids_slugify(spark: SparkSession, d: str) -> DataFrame:
    """IDS-6: slugs of whole texts (tested against a loop over Unicode's decompositions)."""
    return view(spark, d, "documents").select("doc_id", ids.slugify(F.col("text")).alias("slug"))


@query(f"""WITH {_WORDS} SELECT w.doc_id, CAST(w.pos AS BIGINT) AS pos, d.source IN ('src3', 'src7') AS reserved, NOT regexp_matches(lower(word), '^[a-z]{{3}}$') AS "language", NOT regexp_matches(word, '^[-a-zA-Z0-9_]+$') AS slug
FROM w JOIN documents d ON d.doc_id = w.doc_id WHERE d.source IN ('src3', 'src7') OR NOT regexp_matches(lower(word), '^[a-z]{{3}}$') OR NOT regexp_matches(word, '^[-a-zA-Z0-9_]+$')""")
def ids_validate(spark: SparkSession, d: str) -> DataFrame:
    """IDS-7: rejected rows with all that is wrong with them, words standing for slugs and language codes."""
    words = view(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "[^A-Za-z0-9]+", -1)).alias("pos", "word"))
    _, rejected = audit.validate(words, name=F.col("source"), language=F.lower("word"), slug=F.col("word"), reserved=("src3", "src7"))
    return rejected.select("doc_id", F.col("pos").cast("long").alias("pos"), *[F.array_contains("reasons", x).alias(x) for x in ("reserved", "language", "slug")])


@query("""SELECT doc_id, CASE lang WHEN 'de' THEN 'deu' WHEN 'en' THEN 'eng' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' END AS lang3, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang END AS lang2, CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' END AS name, '{' || source || '}' AS wrapped, source AS bare FROM documents""")
def ids_languages(spark: SparkSession, d: str) -> DataFrame:
    """IDS-8, IDS-9: three-letter codes of `ll-LL`, their two-letter codes and names; delimiters put on and taken off."""
    three = ids.normalize_lang(F.concat("lang", F.lit("-XX")))
    w = ids.parenthesize(F.col("source"))
    return view(spark, d, "documents").select("doc_id", three.alias("lang3"), ids.two_letter_lang(three).alias("lang2"), ids.name_of_lang(three).alias("name"), w.alias("wrapped"), ids.strip_delims(w).alias("bare"))


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def src_md5(spark: SparkSession, d: str) -> DataFrame:
    """SRC-12: content fingerprints."""
    return view(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))


# Visits by plain enumeration of paths that stop at nodes seen on the least path: the tree fixture has no cycles.
def _walk_sql(edges: str) -> str:
    return f"""WITH RECURSIVE {cte('fx_node', edges)},
root AS (SELECT doc, min(node) AS node FROM fx_node GROUP BY doc),
w(doc, node, parent, path, depth) AS (
  SELECT doc, node, CAST(NULL AS BIGINT), '', 0 FROM root
  UNION ALL SELECT e.doc, e.child, e.parent, w.path || lpad(CAST(e.ordinal AS VARCHAR), 8, '0') || '.' || lpad(CAST(e.child AS VARCHAR), 10, '0') || '/', w.depth + 1
  FROM w JOIN {edges} e ON e.doc = w.doc AND e.parent = w.node)"""


@query(f"{_walk_sql('fx_edge')} SELECT doc, node, parent, depth, row_number() OVER (PARTITION BY doc ORDER BY path) AS place, TRUE AS is_first FROM w")
def tree_walk(spark: SparkSession, d: str) -> DataFrame:
    """TREE-1: depth-first visits in order."""
    n = view(spark, d, "fx_node")
    v = tree.walk(view(spark, d, "fx_edge"), tree.roots_of(n))
    return v.select("doc", "node", "parent", F.col("depth").cast("int").alias("depth"), (F.col("place") + 1).alias("place"), "is_first")


@query(f"{_walk_sql('fx_edge')} SELECT n.doc, n.node, CAST(coalesce(p, 2147483647) AS BIGINT) AS order_in_document FROM fx_node n LEFT JOIN (SELECT doc, node, row_number() OVER (PARTITION BY doc ORDER BY path) - 1 AS p FROM w) x ON x.doc = n.doc AND x.node = n.node")
def tree_order(spark: SparkSession, d: str) -> DataFrame:
    """TREE-2: order numbers."""
    n = view(spark, d, "fx_node")
    return tree.order_in_document(n, tree.walk(view(spark, d, "fx_edge"), tree.roots_of(n))).withColumn("order_in_document", F.col("order_in_document").cast("long"))


_CLOSURE = """WITH RECURSIVE {c}, c(doc, ancestor, descendant) AS (SELECT doc, parent, child FROM fx_edge UNION SELECT c.doc, c.ancestor, e.child FROM c JOIN fx_edge e ON e.doc = c.doc AND e.parent = c.descendant)"""


@query(f"{_CLOSURE.format(c=cte('fx_edge'))} SELECT doc, ancestor, descendant FROM c")
def tree_closure(spark: SparkSession, d: str) -> DataFrame:
    """TREE-3: ancestors and descendants."""
    return tree.closure(view(spark, d, "fx_edge"))


@query(f"""WITH {cte('fx_edge')}, new AS (SELECT doc, parent, child FROM fx_edge WHERE ordinal % 2 = 0 UNION SELECT doc, parent, child + 500000 FROM fx_edge WHERE ordinal % 3 = 0)
SELECT n.doc, n.parent, n.child, (SELECT max(ordinal) FROM fx_edge e WHERE e.doc = n.doc AND e.parent = n.parent) + row_number() OVER (PARTITION BY n.doc, n.parent ORDER BY n.child) AS ordinal
FROM new n WHERE NOT EXISTS (SELECT 1 FROM fx_edge e WHERE e.doc = n.doc AND e.parent = n.parent AND e.child = n.child)""")
def tree_append(spark: SparkSession, d: str) -> DataFrame:
    """TREE-4: children appended after the existing ones."""
    e = view(spark, d, "fx_edge")
    new = e.where("ordinal % 2 = 0").select("doc", "parent", "child").unionByName(e.where("ordinal % 3 = 0").select("doc", "parent", (F.col("child") + 500000).alias("child")))
    return tree.append_children(e, new)


@query(f"WITH {cte('fx_edge')} SELECT doc, parent, string_agg(CAST(child AS VARCHAR), ',' ORDER BY ordinal, child) AS children FROM fx_edge GROUP BY doc, parent")
def tree_children(spark: SparkSession, d: str) -> DataFrame:
    """TREE-5: ordered children."""
    return tree.children(view(spark, d, "fx_edge")).withColumn("children", F.concat_ws(",", F.col("children").cast("array<string>")))


@query(f"WITH {cte('fx_edge_defect')} SELECT doc, child, string_agg(DISTINCT CAST(parent AS VARCHAR), ',' ORDER BY CAST(parent AS VARCHAR)) AS parents FROM fx_edge_defect GROUP BY doc, child")
def tree_parents(spark: SparkSession, d: str) -> DataFrame:
    """TREE-5: parents."""
    return tree.parents(view(spark, d, "fx_edge_defect")).withColumn("parents", F.concat_ws(",", F.sort_array(F.col("parents").cast("array<string>"))))


@query(f"WITH {cte('fx_edge_defect')} SELECT doc, parent, child FROM fx_edge_defect e WHERE NOT EXISTS (SELECT 1 FROM fx_node n WHERE n.doc = e.doc AND n.node = e.child)")
def tree_missing_children(spark: SparkSession, d: str) -> DataFrame:
    """TREE-8: edges to nodes that don't exist."""
    return tree.missing_children(view(spark, d, "fx_node"), view(spark, d, "fx_edge_defect"))


_REACH = f"""WITH RECURSIVE {cte('fx_edge_defect', 'fx_attr')}, reach(doc, node) AS (SELECT doc, min(node) FROM fx_node GROUP BY doc UNION SELECT e.doc, e.child FROM reach x JOIN fx_edge_defect e ON e.doc = x.doc AND e.parent = x.node)"""


@query(f"{_REACH} SELECT n.doc, n.node, CASE WHEN n.node % 3 = 0 THEN n.node - 2 END AS replaced_by FROM fx_node n WHERE NOT EXISTS (SELECT 1 FROM reach x WHERE x.doc = n.doc AND x.node = n.node)")
def tree_disconnected(spark: SparkSession, d: str) -> DataFrame:
    """TREE-9: nodes out of reach, in a graph with loops and second parents, and what took their place."""
    n, e = view(spark, d, "fx_node"), view(spark, d, "fx_edge_defect")
    by = n.where("node % 3 = 0").select("doc", "node", (F.col("node") - 2).alias("by"))
    return tree.disconnected(n, tree.reachable(e, tree.roots_of(n)), by)


@query(f"""WITH {cte('fx_attr')} SELECT DISTINCT doc, replaced AS node, node AS by FROM (SELECT doc, node, node % 10 AS replaced FROM fx_node WHERE node % 11 = 0 UNION ALL SELECT doc, node, 10 FROM fx_node WHERE node % 11 = 0) q""")
def tree_replaced_by(spark: SparkSession, d: str) -> DataFrame:
    """TREE-10: what took a node's place."""
    return attrs.replaced_by(attrs.replaces(view(spark, d, "fx_attr")))


@query(f"""{_REACH}, root AS (SELECT doc, min(node) AS root FROM fx_node GROUP BY doc)
SELECT e.doc, e.child AS node, e.parent FROM fx_edge_defect e JOIN reach x ON x.doc = e.doc AND x.node = e.parent JOIN root ON root.doc = e.doc AND root.root = e.child""")
def tree_loops(spark: SparkSession, d: str) -> DataFrame:
    """TREE-6: visits that close a loop (the fixture's go back to the roots)."""
    n, e = view(spark, d, "fx_node"), view(spark, d, "fx_edge_defect")
    return tree.loops(tree.walk(e, tree.roots_of(n))).drop("depth")


@query(f"""{_REACH}, v AS (SELECT e.doc, e.child AS node, e.parent FROM fx_edge_defect e JOIN reach x ON x.doc = e.doc AND x.node = e.parent)
SELECT doc, node, CAST(count(*) + max(CASE WHEN root THEN 1 ELSE 0 END) - 1 AS BIGINT) AS again FROM (SELECT v.doc, v.node, v.node = (SELECT min(node) FROM fx_node n WHERE n.doc = v.doc) AS root FROM v) z GROUP BY doc, node HAVING count(*) + max(CASE WHEN root THEN 1 ELSE 0 END) > 1""")
def tree_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """TREE-7: how often nodes are visited again."""
    n, e = view(spark, d, "fx_node"), view(spark, d, "fx_edge_defect")
    return tree.duplicates(tree.walk(e, tree.roots_of(n))).groupBy("doc", "node").agg(F.count(F.lit(1)).alias("again"))


_BAD_LINK = f"""NOT CASE WHEN c.exts NOT IN (SELECT ext FROM exts) THEN c.environ = 'graphic_file' ELSE EXISTS (SELECT 1 FROM rules r WHERE r.parent = {kind_sql('p.environ')} AND r.child = {kind_sql('c.environ')})
 AND EXISTS (SELECT 1 FROM exts x WHERE x.ext = c.exts AND x.child = {kind_sql('c.environ')}) END"""
_RULES = f"{child_rules_sql()}, {extension_rules_sql()}"


@query(f"""WITH {cte('fx_edge', 'fx_environ')}, {_RULES}
SELECT e.doc, e.parent, e.child, p.environ AS parent_environ, c.environ AS child_environ FROM fx_edge e JOIN fx_environ p ON p.node = e.parent JOIN fx_environ c ON c.node = e.child WHERE {_BAD_LINK}""")
def tree_check_links(spark: SparkSession, d: str) -> DataFrame:
    """TREE-11, AUD-2: edges that the rules don't allow."""
    return tree.check_links(view(spark, d, "fx_environ"), view(spark, d, "fx_edge"), child_rules(spark), extension_rules(spark))


@query(f"""WITH {cte('fx_environ')}, {child_rules_sql()}, own AS (SELECT DISTINCT doc, environ FROM fx_environ WHERE {kind_sql('environ')} = 'E_*')
SELECT n.doc, n.node, coalesce((SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT CASE WHEN r.child = 'E_*' THEN o.environ ELSE r.child END AS x FROM rules r LEFT JOIN own o ON o.doc = n.doc AND r.child = 'E_*' WHERE r.parent = {kind_sql('n.environ')}) z WHERE x IS NOT NULL), '') AS allowed FROM fx_environ n""")
def tree_allowed_children(spark: SparkSession, d: str) -> DataFrame:
    """TREE-12: what may stand under each node."""
    return tree.allowed_children(view(spark, d, "fx_environ"), child_rules(spark))


@query(f"""WITH {cte('fx_edge')} SELECT e.doc, e.child AS node, e.parent AS up, lag(e.child) OVER w AS "left", lead(e.child) OVER w AS "right",
(SELECT min(child) FROM fx_edge f WHERE f.doc = e.doc AND f.parent = e.child) AS first_child FROM fx_edge e WINDOW w AS (PARTITION BY e.doc, e.parent ORDER BY e.ordinal, e.child)""")
def tree_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """TREE-14: up, left, right, first child."""
    return tree.neighbours(view(spark, d, "fx_edge"))


@query()
def tree_subtree_hash(spark: SparkSession, d: str) -> DataFrame:
    """TREE-15: hashes of subtrees (tested against a recursive function)."""
    n, e = view(spark, d, "fx_node"), view(spark, d, "fx_edge")
    return tree.subtree_hash(n, e, tree.walk(e, tree.roots_of(n)))


@query(f"""WITH RECURSIVE {cte('fx_node', 'fx_edge')}, up(doc, node) AS (SELECT doc, node FROM fx_node WHERE r % 50 = 3 UNION SELECT e.doc, e.parent FROM up u JOIN fx_edge e ON e.doc = u.doc AND e.child = u.node)
SELECT up.doc, up.node, md5(n.text) AS before, md5(CASE WHEN n.r % 50 = 3 THEN n.text || ' new' ELSE n.text END) AS after FROM up JOIN fx_node n ON n.doc = up.doc AND n.node = up.node""")
def tree_hash_changes(spark: SparkSession, d: str) -> DataFrame:
    """TREE-15: kept hashes after some nodes have new texts: nodes whose hash is another, which are the changed ones and
    those above them, with their own texts' hashes."""
    n, e = view(spark, d, "fx_node"), view(spark, d, "fx_edge")
    visits = tree.walk(e, tree.roots_of(n))
    kept = hashes.Hashes(spark, shared_path(spark, "hashes"))
    kept.update(hashes.tree_of(n, visits).withColumn("gone", F.lit(False)), 0)
    old = kept.rows().select("doc", "node", F.col("own").alias("before"), F.col("hash").alias("h"))
    now = n.withColumn("text", F.when(F.col("r") % 50 == 3, F.concat("text", F.lit(" new"))).otherwise(F.col("text")))
    kept.update(kept.changes(hashes.tree_of(now, visits)), 1)
    new = kept.rows().select("doc", "node", F.col("own").alias("after"), "hash")
    return old.join(new, ["doc", "node"]).where("h <> hash").select("doc", "node", "before", "after")


@query("SELECT doc_id AS key, md5(text) AS hash, min(doc_id) OVER (PARTITION BY md5(text)) AS canonical FROM documents")
def tree_dedup_content(spark: SparkSession, d: str) -> DataFrame:
    """TREE-16: equal contents and their canonical member."""
    return tree.dedup_content(view(spark, d, "documents"), "doc_id", "text")


_ALIASES = """a AS (SELECT doc_id, 'f' || doc_id || '.png' AS name, 'f' || min(doc_id) OVER (PARTITION BY text) || '--' || md5(text) || '.png' AS stored FROM documents)"""


@query(f"""WITH {_ALIASES} SELECT doc_id AS id, '<img src="' || stored || '">' || text || '<img src="none.png"><img src="' || stored || '">' AS text FROM a JOIN documents USING (doc_id)""")
def tree_rewrite_references(spark: SparkSession, d: str) -> DataFrame:
    """TREE-16: references to copies pointed at the one that is stored."""
    files = view(spark, d, "documents").withColumn("name", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".png")))
    aliases = tree.dedup_content(files, "doc_id", "text", "name")
    image = F.concat(F.lit('<img src="'), "name", F.lit('">'))
    pages = files.select("doc_id", F.concat(image, "text", F.lit('<img src="none.png">'), image).alias("html"))
    return tree.rewrite_references(pages, aliases, "doc_id", "html")


@query(f"""WITH {cte('fx_node')} SELECT DISTINCT md5(text) AS hash FROM fx_node n WHERE NOT EXISTS (SELECT 1 FROM fx_node m WHERE m.r % 2 = 0 AND md5(m.text) = md5(n.text))""")
def tree_orphans(spark: SparkSession, d: str) -> DataFrame:
    """TREE-18: stored copies that nothing refers to."""
    n = view(spark, d, "fx_node").select("r", F.md5("text").alias("hash"))
    return tree.orphans(n.select("hash").distinct(), n.where("r % 2 = 0"))


@query(f"""{_walk_sql('fx_edge').replace(cte('fx_node', 'fx_edge'), cte('fx_edge', 'fx_environ'))}
SELECT w.doc, w.node, w.depth, n.environ, string_split(n.text, chr(10))[1] AS title FROM w JOIN fx_environ n ON n.doc = w.doc AND n.node = w.node WHERE n.environ IN ('section', 'input')""")
def tree_contents(spark: SparkSession, d: str) -> DataFrame:
    """TREE-17: the contents list: sections and inputs with their titles."""
    n = view(spark, d, "fx_environ")
    v = tree.walk(view(spark, d, "fx_edge"), tree.roots_of(n))
    return audit.contents(n, v, F.substring_index("text", "\n", 1))


_COMMAND = """NOT CASE WHEN c.environ LIKE 'E%' THEN i.macro = 'input' AND coalesce(i.context = c.environ, FALSE) WHEN c.environ = 'graphic_file' THEN i.macro = 'includegraphics'
 ELSE i.macro IN ('input', 'include') OR (c.environ IN ('usepackage', 'bibliography', 'include') AND i.macro = c.environ) END"""
_HEADERS = f"""h AS (SELECT v.doc, v.node, v.lang FROM fx_version v WHERE environ IN {SECTIONS} AND NOT starts_with(coalesce(list_filter(string_split(v.text, chr(10)), lambda x: NOT starts_with(ltrim(x, ' '), '%') AND trim(x) <> '')[1], ''), chr(92) || environ))"""
_WRONG_INPUT = "i.target IS NULL OR regexp_extract(i.path, '_([a-z]{3})(\\.tex)?$', 1) <> i.lang"


@query(f"""{_REACH.replace(cte('fx_edge_defect', 'fx_attr'), cte('fx_edge_defect', 'fx_input'))}, {_RULES}, {_HEADERS},
root AS (SELECT doc, min(node) AS root FROM fx_node GROUP BY doc),
g AS (SELECT doc, node, lang, target, count(*) AS n FROM fx_input GROUP BY ALL)
SELECT doc, code, count(*) AS n FROM (
 SELECT v.doc, 'DUPLICATE' AS code FROM (SELECT e.doc, e.child, count(*) AS n FROM fx_edge_defect e JOIN reach x ON x.doc = e.doc AND x.node = e.parent GROUP BY e.doc, e.child) v JOIN root ON root.doc = v.doc WHERE v.n > CASE WHEN v.child = root.root THEN 0 ELSE 1 END
 UNION ALL SELECT e.doc, 'LOOP' FROM fx_edge_defect e JOIN reach x ON x.doc = e.doc AND x.node = e.parent JOIN root ON root.doc = e.doc AND root.root = e.child
 UNION ALL SELECT doc, 'MISSING_CHILD' AS code FROM fx_edge_defect e WHERE NOT EXISTS (SELECT 1 FROM fx_node n WHERE n.doc = e.doc AND n.node = e.child)
 UNION ALL SELECT doc, CASE WHEN node % 3 = 0 THEN 'DISCONNECTED_REPLACED' ELSE 'DISCONNECTED' END FROM fx_node n WHERE NOT EXISTS (SELECT 1 FROM reach x WHERE x.doc = n.doc AND x.node = n.node)
 UNION ALL SELECT e.doc, 'WRONG_LINK' FROM fx_edge_defect e JOIN fx_environ p ON p.node = e.parent JOIN fx_environ c ON c.node = e.child WHERE {_BAD_LINK}
 UNION ALL SELECT i.doc, 'CMD_PARENT_CHILD' FROM fx_input i JOIN fx_environ c ON c.node = i.target WHERE {_COMMAND}
 UNION ALL SELECT doc, 'WRONG_ACCESS' FROM fx_environ WHERE environ LIKE 'E%' AND (environ = 'E_theorem') <> (access = 'private')
 UNION ALL SELECT doc, 'WRONG_HEADER' FROM h
 UNION ALL SELECT doc, 'WRONG_INPUT' FROM fx_input i WHERE {_WRONG_INPUT}
 UNION ALL SELECT doc, 'DUP_INPUT' FROM g WHERE n > 1 AND target IS NOT NULL
 UNION ALL SELECT v.doc, 'MISSING_INPUT' FROM (SELECT DISTINCT doc, node, lang FROM fx_version) v JOIN (SELECT DISTINCT node, target FROM g WHERE target IS NOT NULL) t ON t.node = v.node WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.node = v.node AND g.lang = v.lang AND g.target = t.target)
 UNION ALL SELECT doc, 'UNTRANSLATED' FROM (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY node) AS k FROM fx_node WHERE node % 2 = 0) q WHERE k <= 16) p GROUP BY doc, code""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """AUD-1 to AUD-10 and AUD-12: problems by document and code, loops included."""
    n = view(spark, d, "fx_environ").withColumn("langs", F.when(F.col("node") % 2 == 0, F.array(F.lit("eng"))).otherwise(F.array(F.lit("eng"), F.lit("ita"))))
    by = n.where("node % 3 = 0").select("doc", "node", (F.col("node") - 2).alias("by"))
    p = audit.check_corpus(n, view(spark, d, "fx_edge_defect"), view(spark, d, "fx_input"), view(spark, d, "fx_version"), by, child_rules(spark), extension_rules(spark), ["eng", "ita"], ("E_theorem",))
    return p.groupBy("doc", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {cte('fx_environ')}, p AS (SELECT doc, node, environ, access FROM fx_environ WHERE environ LIKE 'E%' AND (environ = 'E_theorem') <> (access = 'private'))
SELECT doc, 'WRONG_ACCESS' AS code, node, environ || ',' || access AS args, FALSE AS flagged FROM p UNION ALL SELECT DISTINCT doc, 'OK', CAST(NULL AS BIGINT), '', FALSE FROM fx_environ WHERE doc NOT IN (SELECT doc FROM p)""")
def audit_wrong_access(spark: SparkSession, d: str) -> DataFrame:
    """AUD-5, AUD-12: private environs and private access must agree; documents where they do are reported as fine."""
    n = view(spark, d, "fx_environ")
    return audit.rendered(audit.wrong_access(n, ("E_theorem",)), n).withColumn("args", F.array_join("args", ","))


@query(f"""WITH {cte('fx_environ')}, a AS (SELECT doc, node, environ FROM fx_environ WHERE r % 13 <> 0 UNION ALL SELECT doc, node, 'extra' FROM fx_environ WHERE r % 11 = 0)
SELECT n.doc, n.node, (SELECT count(*) FROM a WHERE a.doc = n.doc AND a.node = n.node) AS n FROM fx_environ n WHERE (SELECT count(*) FROM a WHERE a.doc = n.doc AND a.node = n.node) <> 1""")
def audit_wrong_environ(spark: SparkSession, d: str) -> DataFrame:
    """AUD-3: nodes without exactly one environ."""
    n = view(spark, d, "fx_environ")
    a = n.where("r % 13 <> 0").select("doc", "node", F.col("environ").alias("value")).unionByName(n.where("r % 11 = 0").select("doc", "node", F.lit("extra").alias("value")))
    return audit.wrong_environ(n, a)


@query(f"""WITH {cte('fx_version')}, {_HEADERS} SELECT h.doc, h.node, n.environ FROM h JOIN fx_environ n ON n.node = h.node""")
def audit_wrong_header(spark: SparkSession, d: str) -> DataFrame:
    """AUD-6: sectioning nodes of which a version doesn't begin with their command."""
    return audit.wrong_header(view(spark, d, "fx_version")).select("doc", "node", F.get("args", F.lit(0)).alias("environ"))


@query(f"WITH {cte('fx_input')} SELECT doc, node, lang, target, count(*) AS n FROM fx_input WHERE target IS NOT NULL GROUP BY doc, node, lang, target HAVING count(*) > 1")
def audit_dup_input(spark: SparkSession, d: str) -> DataFrame:
    """AUD-8: the same input twice in one language."""
    return audit.dup_input(view(spark, d, "fx_input"))


@query(f"""WITH {cte('fx_input')} SELECT v.doc, v.node, v.lang, t.target FROM (SELECT DISTINCT doc, node, lang FROM fx_version) v JOIN (SELECT DISTINCT node, target FROM fx_input WHERE target IS NOT NULL) t ON t.node = v.node
WHERE NOT EXISTS (SELECT 1 FROM fx_input i WHERE i.node = v.node AND i.lang = v.lang AND i.target = t.target)""")
def audit_missing_input(spark: SparkSession, d: str) -> DataFrame:
    """AUD-9: versions of a node that lack an input that another has."""
    return audit.missing_input(view(spark, d, "fx_input"), view(spark, d, "fx_version"))


@query(f"WITH {cte('fx_input')} SELECT doc, node, lang, path FROM fx_input i WHERE {_WRONG_INPUT}")
def audit_wrong_input(spark: SparkSession, d: str) -> DataFrame:
    """AUD-7: inputs of a wrong language, or of nothing."""
    return audit.wrong_input(view(spark, d, "fx_input")).select("doc", "node", F.get("args", F.lit(0)).alias("lang"), F.get("args", F.lit(1)).alias("path"))


@query(f"WITH {cte('fx_input')} SELECT i.doc, i.node, i.macro, coalesce(i.context, '') AS context, c.environ FROM fx_input i JOIN fx_environ c ON c.node = i.target WHERE {_COMMAND}")
def audit_commands(spark: SparkSession, d: str) -> DataFrame:
    """TREE-13, AUD-4: commands that don't fit what they bring in."""
    bad = audit.check_commands(view(spark, d, "fx_input"), view(spark, d, "fx_environ"))
    arg = lambda i: F.coalesce(F.get("args", F.lit(i)), F.lit(""))
    return bad.select("doc", "node", arg(0).alias("macro"), arg(1).alias("context"), arg(2).alias("environ"))


@query(f"""WITH {cte('fx_node')}, u AS (SELECT doc, node, row_number() OVER (PARTITION BY doc ORDER BY node) AS k, count(*) OVER (PARTITION BY doc) AS n FROM fx_node WHERE node % 2 = 0 AND node % 10 <> 0)
SELECT doc, node, n FROM u WHERE k <= 16""")
def audit_untranslated(spark: SparkSession, d: str) -> DataFrame:
    """AUD-10: nodes that lack one of the document's languages: the first 16, and how many there are."""
    exempt = F.when(F.col("node") % 3 == 0, "mul").when(F.col("node") % 3 == 1, "und").otherwise("zxx")
    langs = F.when(F.col("node") % 10 == 0, F.array(exempt)).when(F.col("node") % 2 == 0, F.array(F.lit("eng"))).otherwise(F.array(F.lit("eng"), F.lit("ita")))
    n = view(spark, d, "fx_node").select("doc", "node", langs.alias("langs"))
    return audit.untranslated(n, ["eng", "ita"])


@query(f"""WITH {cte('fx_node')} SELECT doc, node FROM fx_node n WHERE NOT (r % 2 = 0 AND r % 3 <> 0)""")
def audit_skip_checked(spark: SparkSession, d: str) -> DataFrame:
    """AUD-11: nodes to check again: not checked yet, or changed since."""
    n = view(spark, d, "fx_node")
    done = n.where("r % 2 = 0").select("doc", "node", F.when(F.col("r") % 3 == 0, F.lit("old")).otherwise(F.md5("text")).alias("md5"))
    return audit.unchecked(n, done).select("doc", "node")

"""A corpus derived from the driver's tables: documents become nodes, sources become documents, and so on.

The views are plain SQL that means the same to Spark and to the oracle, so a query's SQL can begin with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.numbering import number_within
from quire.scratch import moved, written

N = "(SELECT count(*) FROM documents)"

VIEWS = {
    "fx_rank": """
SELECT doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents""",
    "fx_node": """
SELECT d.source AS doc, d.doc_id, d.doc_id + 1 AS node, d.lang, d.text, k.r,
       CASE WHEN l.toxic = 1 THEN 'private' WHEN l.quality = 1 THEN 'open' ELSE 'public' END AS access
FROM documents d JOIN fx_rank k ON k.id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "fx_local": """
SELECT doc, r AS node, lang, text, access FROM fx_node""",
    "fx_edge": """
SELECT c.doc, p.node AS parent, c.node AS child, c.r AS ordinal
FROM fx_node c JOIN fx_node p ON p.doc = c.doc AND p.r = CAST(floor((c.r + 1) / 3) AS BIGINT)
WHERE c.r > 1""",
    "fx_edge_defect": """
SELECT e.doc, e.parent, e.child, e.ordinal FROM fx_edge e JOIN fx_node n ON n.node = e.child WHERE n.r % 8 <> 0
UNION ALL SELECT n.doc, n.node, t.node, 1000 FROM fx_node n JOIN fx_node t ON t.doc = n.doc AND t.r = 1 WHERE n.r % 9 = 0
UNION ALL SELECT n.doc, t.node, n.node, 2000 + n.r FROM fx_node n JOIN fx_node t ON t.doc = n.doc AND t.r = 2 WHERE n.r % 10 = 0
UNION ALL SELECT n.doc, n.node, n.node + 1000000, 3000 FROM fx_node n WHERE n.r % 7 = 0""",
    "fx_environ": """
SELECT doc, node, r, lang, text, access,
       CASE WHEN r = 1 THEN 'main_file' WHEN r = 2 THEN 'E_document' WHEN r % 11 = 0 THEN 'graphic_file' WHEN r % 5 = 0 THEN 'E_theorem' WHEN r % 7 = 0 THEN 'input'
            WHEN r % 13 = 0 THEN 'paragraph' WHEN r % 3 = 0 THEN 'subsection' ELSE 'section' END AS environ,
       CASE WHEN r % 22 = 0 THEN '.pdf,.png' WHEN r % 11 = 0 THEN '.png' WHEN r % 17 = 0 THEN '.sty' WHEN r % 19 = 0 THEN '.pdf,.tex' ELSE '.tex' END AS exts
FROM fx_node""",
    "fx_version": """
SELECT doc, node, 'eng' AS lang, environ, CASE WHEN r % 4 = 0 THEN concat(chr(92), environ, '{t}', chr(10), text) WHEN r % 4 = 1 THEN concat('% c', chr(10), chr(92), 'section{t}', chr(10), text) ELSE text END AS text FROM fx_environ
UNION ALL SELECT doc, node, 'ita', environ, concat(' % c', chr(10), chr(10), chr(92), 'subsection{t}', chr(10), text) FROM fx_environ WHERE node % 2 = 1""",
    "fx_input": """
SELECT e.doc, e.parent AS node, v.lang, CASE WHEN c.environ = 'graphic_file' AND e.child % 2 = 0 THEN 'includegraphics' WHEN e.child % 9 = 0 THEN 'usepackage' ELSE 'input' END AS macro,
       CASE WHEN c.environ LIKE 'E%' AND e.child % 3 <> 0 THEN c.environ END AS context,
       concat('UUID/', e.child, '/blob_', CASE WHEN e.child % 13 = 0 THEN 'fra' ELSE v.lang END, '.tex') AS path, CASE WHEN e.child % 17 <> 0 THEN e.child END AS target
FROM fx_edge e JOIN fx_environ c ON c.node = e.child JOIN fx_version v ON v.node = e.parent JOIN (SELECT 1 AS k UNION ALL SELECT 2) t ON t.k = 1 OR e.child % 12 = 0
WHERE NOT (v.lang = 'ita' AND e.child % 7 = 0)""",
    "fx_word": """
SELECT doc, node, regexp_extract(text, '([A-Za-z]+)', 1) AS w1,
       regexp_extract(text, '[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1) AS w2 FROM fx_node""",
    "fx_attr": f"""
SELECT doc, node, 'M_label' AS key, concat('{{doc:', node, '}}') AS value FROM fx_word
UNION ALL SELECT doc, node, 'M_ref', concat('{{doc:', (node * 7) % {N} + 1, '}}') FROM fx_word
UNION ALL SELECT doc, node, 'M_cite', concat('{{a', node % 5, ',b', node % 3, '}}') FROM fx_word
UNION ALL SELECT doc, node, 'M_replaces', concat('{{00', node % 10, ', 00B}}') FROM fx_word WHERE node % 11 = 0
UNION ALL SELECT doc, node, CASE node % 3 WHEN 0 THEN 'M_indexLeng' WHEN 1 THEN 'M_indexLita' ELSE 'M_index' END,
       CASE node % 4 WHEN 0 THEN concat('{{', w1, '!', w2, '|textbf}}') WHEN 1 THEN concat('{{', w1, '|see{{', w2, '}}}}')
                     WHEN 2 THEN concat('{{', w2, '@', w1, '}}') ELSE concat('{{', w1, '|(}}') END FROM fx_word
UNION ALL SELECT doc, node, CASE node % 3 WHEN 0 THEN 'M_indexLeng' WHEN 1 THEN 'M_indexLita' ELSE 'M_index' END,
       concat('{{', w1, '|)}}') FROM fx_word WHERE node % 8 = 3""",
    "fx_markup": f"""
SELECT n.doc, n.node, n.r, n.lang, concat(
  chr(92), 'section{{', n.doc, ' ', chr(92), 'emph{{', n.lang, '}}}}', chr(10), chr(92), 'label{{doc:', n.node, '}}', chr(10),
  chr(92), 'begin{{theorem}}[', n.lang, ']', chr(10), n.text, chr(10),
  chr(92), 'index{{', w.w1, '!', w.w2, '}}', chr(10), '% note ', chr(92), 'label{{no}}', chr(10),
  chr(92), 'begin{{verbatim}}', chr(92), 'section{{no}}% $x$', chr(10), chr(92), 'end{{verbatim}}', chr(10),
  chr(92), 'begin{{equation}}', chr(92), 'label{{eq:', n.node, '{{}}{{a{{b{{c{{d{{e}}}}}}}}}}}} $x_', n.r, '$ ', chr(92), 'end{{equation}}', chr(10),
  chr(92), 'end{{theorem}}', chr(10), 'See ', chr(92), 'ref{{doc:', (n.node * 7) % {N} + 1, '}} and $$y$$ ', chr(92), 'verb|$z$ ', chr(92), 'ref{{no}}|.', chr(10),
  chr(92), 'begin{{itemize}}', chr(92), 'item first ', n.r, chr(10), chr(92), 'item second', chr(92), 'end{{itemize}}', chr(10),
  chr(92), 'input{{f', (n.r * 3) % 50, '.tex}}%', chr(10), chr(92), 'includegraphics[width=1cm]{{pic', n.r % 9, '.png}}', chr(10), chr(92), 'bibliography{{bib', n.r % 3, ' , amsrefs}}', chr(10),
  CASE WHEN n.r % 6 = 0 THEN concat(chr(92), 'end{{lost}}', chr(10)) WHEN n.r % 8 = 1 THEN concat(chr(92), 'begin{{a}}', chr(92), 'end{{b}}', chr(92), 'input{{/etc/f}}', chr(10)) ELSE '' END,
  CASE WHEN n.r % 97 = 5 THEN concat(chr(92), 'label{{', repeat('{{g}}', 5000), '}}', chr(10)) WHEN n.r % 10 = 3 THEN concat(chr(92), 'label{{open', chr(10)) ELSE '' END) AS text
FROM fx_node n JOIN fx_word w ON w.node = n.node""",
    "fx_user": """
SELECT c_custkey AS user_id, c_name AS username, c_acctbal >= 0 AS is_active, c_custkey % 40 = 7 AS is_superuser FROM customer""",
    "fx_member": """
SELECT c_custkey AS user_id, concat('src', c_custkey % 20) AS doc, CASE WHEN c_custkey % 3 = 1 THEN 'editors' ELSE 'authors' END AS grp FROM customer WHERE c_custkey % 5 < 3
UNION ALL SELECT c_custkey, concat('src', (c_custkey * 7 + 3) % 20), CASE WHEN c_custkey % 2 = 1 THEN 'editors' ELSE 'authors' END FROM customer WHERE c_custkey % 4 = 1""",
    "fx_author": """
SELECT n.doc, n.node, u.user_id FROM fx_node n JOIN fx_user u ON u.user_id = n.node % 50""",
    "fx_local_author": """
SELECT n.doc, n.node, u.user_id FROM fx_local n JOIN fx_user u ON u.user_id = n.node % 50""",
    "fx_grant": """
SELECT DISTINCT o_custkey AS user_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'view_view' WHEN 1 THEN 'view_blob' ELSE 'download' END AS perm,
       CASE WHEN o_orderkey % 50 = 0 THEN 'global' WHEN o_orderkey % 10 = 0 THEN 'doc' ELSE 'node' END AS scope,
       concat('src', o_orderkey % 20) AS doc, CAST(floor(o_orderkey / 20) AS BIGINT) % 40 + 1 AS node FROM orders""",
    "fx_edit": f"""
SELECT n.doc, n.node, n.lang, e.event_id, e.user_id, e.ts, e.event_type,
       CASE WHEN e.event_id % 3 = 0 THEN n.text ELSE concat(n.text, ' edited ', e.event_id) END AS content,
       CASE WHEN e.event_id % 4 = 0 THEN 'stale' ELSE md5(n.text) END AS base_md5
FROM events e JOIN fx_node n ON n.node = e.event_id % {N} + 1""",
    "fx_conv": """
SELECT conv_id AS node, turn, CASE role WHEN 'user' THEN 'eng' WHEN 'assistant' THEN 'ita' ELSE 'fra' END AS lang, text FROM conversations""",
}
NEEDS = {
    "fx_node": ["fx_rank"],
    "fx_local": ["fx_node"],
    "fx_local_author": ["fx_local", "fx_user"],
    "fx_edge": ["fx_node"],
    "fx_edge_defect": ["fx_node", "fx_edge"],
    "fx_environ": ["fx_node"],
    "fx_version": ["fx_environ"],
    "fx_input": ["fx_edge", "fx_environ", "fx_version"],
    "fx_word": ["fx_node"],
    "fx_attr": ["fx_word"],
    "fx_markup": ["fx_node", "fx_word"],
    "fx_author": ["fx_node", "fx_user"],
    "fx_edit": ["fx_node"],
}
TABLES = ("documents", "labels", "pages", "customer", "orders", "events", "conversations", "benchmark")


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for x in [*_closure(tuple(NEEDS.get(name, ()))), name]:
            if x not in out:
                out.append(x)
    return out


def cte(*names: str) -> str:
    """`name AS (...), ...` for the views and what they need, to put after WITH."""
    return ",\n".join(f"{x} AS ({VIEWS[x]})" for x in _closure(names))


_ranks: dict[tuple[str, str], DataFrame] = {}


def _rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_rank without a window over a whole source; written once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ranks:
        ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.col("doc_id").alias("id"))
        _ranks[key] = written(number_within(ids, ["source"], ["id"], "r").select("id", "r"), "ranks")
    return _ranks[key]


_links: dict[tuple[str, str], DataFrame] = {}


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_edge, whose sides are both moved; written once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _links:
        n = view(spark, sf_dir, "fx_node")
        up = n.select("doc", F.col("node").alias("parent"), "r")
        down = n.where("r > 1").select("doc", F.col("node").alias("child"), F.col("r").alias("ordinal"), F.floor((F.col("r") + 1) / 3).alias("r"))
        _links[key] = written(down.join(moved(up), ["doc", "r"]).select("doc", "parent", "child", "ordinal"), "links")
    return _links[key]


#: Given tables that have a row for each document or nearly: what they meet is moved, and they don't go through the driver.
LARGE = ("labels",)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view (or a given table) over the tables of ``sf_dir``."""
    if name == "fx_edge":
        return _edges(spark, sf_dir)
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needed = _closure((name,))
    if "fx_rank" in needed:
        needed.remove("fx_rank")
        moved(_rank(spark, sf_dir)).createOrReplaceTempView("fx_rank")
    if "fx_edge" in needed:
        needed.remove("fx_edge")
        moved(_edges(spark, sf_dir)).createOrReplaceTempView("fx_edge")
    for t in TABLES:
        if any(t in VIEWS[x] for x in needed):
            given = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (moved(given) if t in LARGE else given).createOrReplaceTempView(t)
    text = "WITH " + ",\n".join(f"{x} AS ({VIEWS[x]})" for x in needed) + f" SELECT * FROM {name}"
    if N in text:
        text = text.replace(N, str(spark.read.parquet(f"{sf_dir}/documents.parquet").count()))
    return spark.sql(text)

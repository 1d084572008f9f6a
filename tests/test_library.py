"""Golden values, invariants and small graphs for the document-tree library."""

import hashlib
import json
import os
import random
import re
import unicodedata
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__
from quire import fixtures
from quire.functions import ids
from quire.functions import text as T
from quire.operators import activity, attrs, index, languages, segment, tree
from quire.plans import registry
from quire.sources import files

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_ids_round_trip(spark):
    df = spark.range(0, 30**4 + 30**3, 331).select("id", ids.int_to_id(F.col("id")).alias("s"))
    df = df.select("id", "s", ids.id_to_int(F.col("s")).alias("back"), ids.id_to_int(ids.path_to_id(ids.id_to_path(F.col("s")))).alias("path"))
    assert df.where("id <> back or id <> path or length(s) < 3").count() == 0
    assert one(spark, ids.id_to_int(F.col("s")), s="OOO1") == 1
    assert one(spark, ids.id_to_int(F.col("s")), s="A/1") is None


def test_slug_and_delimiters(spark):
    assert one(spark, ids.slugify(F.col("s")), s=" Crème Brûlée -- 2! ") == "creme-brulee-2"
    assert one(spark, ids.strip_delims(F.col("s")), s="{a{b}}") == "a{b}"
    assert one(spark, ids.strip_delims(F.col("s")), s="{a") == "{a"
    assert one(spark, ids.normalize_lang(F.col("s")), s="en-US") == "eng"


@pytest.mark.parametrize("a,b", [("$\\cos$", "\\(\\cos\\)"), ("$$\\cos$$", "\\[\\cos\\]"), ("$${\\cos\\text{$\\sin$}}$$", "\\[{\\cos\\text{\\(\\sin\\)}}\\]"), ("5\\$ and $x$", "5\\$ and \\(x\\)")])
def test_dedollarize(spark, a, b):
    assert one(spark, T.dedollarize(F.col("s")), s=a) == b


def test_accents_and_symbols(spark):
    assert one(spark, T.accents_to_unicode(F.col("s")), s="\\~u\\`{e}") == "ũè"
    assert one(spark, T.symbols_to_unicode(F.col("s")), s="\\alpha+\\epsilon \\etax") == "α+ϵ \\etax"
    with pytest.raises(KeyError, match="known: accents"):
        T.apply_filters(F.col("s"), ["missing"])


def test_html(spark):
    page = "<html><head><style>p{}</style><script>var t='</p>';</script></head><body><p>a &amp; b</p><!-- c --><b>d</b></body></html>"
    assert one(spark, T.html_to_text(F.col("s")), s=page) == "a & b d"


def test_packed_lines_against_a_loop(spark):
    r = random.Random(0)
    lines = ["".join(r.choice("ab ") for _ in range(r.randrange(1, 80))) for _ in range(60)]
    want: list[str] = []
    for x in lines:
        if want and len(want[-1]) + 1 + len(x) <= 60:
            want[-1] += " " + x
        else:
            want.append(x)
    assert one(spark, T.packed_lines(F.col("s")), s=lines) == want


def recursive_walk(edges, root):
    seen, out = set(), []

    def go(node, parent, branch):
        first = node not in seen
        seen.add(node)
        out.append((node, parent, len(branch), first))
        if first:
            for o, c in sorted((o, c) for p, c, o in edges if p == node):
                go(c, node, [*branch, node])

    go(root, None, [])
    return out


def test_walk_on_random_graphs(spark):
    r = random.Random(7)
    graphs = {}
    for g in range(60):
        n = r.randrange(1, 8)
        pairs = {(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(0, 12))}
        graphs[f"g{g}"] = [(p, c, r.randrange(3)) for p, c in pairs]
    edges = spark.createDataFrame([(g, p, c, o) for g, es in graphs.items() for p, c, o in es], "doc string, parent long, child long, ordinal long")
    roots = spark.createDataFrame([(g, 0) for g in graphs], "doc string, root long")
    got: dict = {g: [] for g in graphs}
    for v in tree.walk(edges, roots).collect():
        got[v.doc].append((v.place, v.size, (v.node, v.parent, v.depth, v.is_first)))
    for g, es in graphs.items():
        rows = sorted(got[g])
        assert [x for _, _, x in rows] == recursive_walk(es, 0), g
        assert [p for p, _, _ in rows] == list(range(len(rows)))
        for p, size, (_, _, depth, _) in rows:
            assert size == next((q - p for q, _, x in rows[p + 1 :] if x[2] <= depth), len(rows) - p)


def test_walk_of_a_deep_chain(spark):
    n = 3000
    chain = spark.range(1, n).select(F.lit("d").alias("doc"), (F.col("id") - 1).alias("parent"), F.col("id").alias("child"), F.lit(1).cast("long").alias("ordinal"))
    back = spark.createDataFrame([("d", n - 1, 5, 1), ("d", 7, 2000, 2)], chain.schema)
    visits = tree.walk(chain.unionByName(back), spark.createDataFrame([("d", 0)], "doc string, root long"))
    got = sorted((r.place, r.node, r.is_first) for r in visits.collect())
    assert got == [*((k, k, True) for k in range(n)), (n, 5, False), (n + 1, 2000, False)]


def reach(es, start):
    seen, todo = set(), [start]
    while todo:
        u = todo.pop()
        for p, c, _ in es:
            if p == u and c not in seen:
                seen.add(c)
                todo.append(c)
    return seen


def test_below_and_closure_on_random_graphs(spark):
    r = random.Random(13)
    graphs = {}
    for g in range(40):
        n = r.randrange(1, 9)
        graphs[f"g{g}"] = [(p, c, r.randrange(3)) for p, c in {(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(0, 14))}]
    edges = spark.createDataFrame([(g, p, c, o) for g, es in graphs.items() for p, c, o in es], "doc string, parent long, child long, ordinal long")
    roots = spark.createDataFrame([(g, 0) for g in graphs], "doc string, root long")
    assert {tuple(x) for x in tree.closure(edges).collect()} == {(g, a, d) for g, es in graphs.items() for a in {p for p, _, _ in es} for d in reach(es, a)}
    visits = tree.walk(edges, roots)
    marks = spark.createDataFrame([(g, k) for g in graphs for k in (0, 1, 3)], "doc string, node long")
    want = {(g, k, d) for g, es in graphs.items() for k in (0, 1, 3) if k == 0 or k in reach(es, 0) for d in reach(es, k) - {k}}
    assert {tuple(x) for x in tree.below(marks, visits).collect()} == want
    assert {tuple(x) for x in tree.reachable(edges, roots).collect()} == {(g, d) for g, es in graphs.items() for d in reach(es, 0) | {0}}
    near = {(x.doc, x.node): x["at"] for x in tree.nearest(visits, marks.where("node = 1")).collect()}
    up = {(x.doc, x.node): x.parent for x in visits.where("is_first").collect()}
    for doc, node in up:
        k = node
        while k is not None and k != 1:
            k = up[doc, k]
        assert near[doc, node] == k


def test_subtree_hash(spark):
    nodes = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 3, "c")], "doc string, node long, text string")
    edges = spark.createDataFrame([("d", 1, 2, 1), ("d", 1, 3, 0)], "doc string, parent long, child long, ordinal long")
    got = {r.node: r.hash for r in tree.subtree_hash(nodes, edges, tree.walk(edges, tree.roots_of(nodes))).collect()}
    m = lambda s: hashlib.md5(s.encode()).hexdigest()
    b, c = m(m("b")), m(m("c"))
    assert got == {2: b, 3: c, 1: m(m("a") + c + b)}


def test_lookahead_keeps_every_line():
    r = random.Random(1)
    for _ in range(200):
        sources = [[r.choice("abcd") for _ in range(r.randrange(0, 12))] for _ in range(3)]
        merged = languages.lookahead(sources, 4)
        assert [[t for own, t in merged if k in own] for k in range(3)] == sources
    assert len(languages.lookahead([["x", "y"], ["x", "y"]])) == 2


def test_language_lines(spark):
    t = "\\CDLeng one\n  \\CDLita due\nboth\n"
    assert one(spark, languages.language_lines(F.col("s"), F.lit("eng")), s=t) == "one\nboth\n"
    assert one(spark, languages.language_lines(F.col("s"), F.lit("ita")), s=t) == "due\nboth\n"
    assert one(spark, languages.language_lines(F.col("s"), F.lit("ita")), s="a \\CDLeng b") == "a \\CDLeng b%misplaced language header\n"
    assert one(spark, languages.retarget_inputs(F.col("s"), F.lit("mul"), F.lit("eng")), s="\\input{UUID/0/0/1/blob_mul.tex}") == "\\input{UUID/0/0/1/blob_eng.tex}"


TEXT = "\\begin{A}\\label{a}\\begin{B}\\label{b}\\index{x}\\end{B}\\ref{c}\\end{A}\\label{d} % \\label{no}\n"


def test_attributes_and_environments(spark):
    f = spark.createDataFrame([("d", 1, TEXT)], "doc string, node long, text string")
    deep = segment.with_depth(segment.explode_markers(f))
    assert sorted((r.key, r.value) for r in segment.attributes(deep).collect()) == [("M_label", "{d}"), ("S_E_A_M_label", "{a}"), ("S_E_A_M_ref", "{c}"), ("S_E_B_M_index", "{x}"), ("S_E_B_M_label", "{b}")]
    assert [(r.env, r.body) for r in segment.environments(deep, ("A",)).collect()] == [("A", "\\label{a}\\begin{B}\\label{b}\\index{x}\\end{B}\\ref{c}")]
    assert segment.unbalanced(deep).count() == 0


def test_sections_nest(spark):
    f = spark.createDataFrame([("d", 1, "\\chapter{a}\\section{b}\\subsection{c}\\section{d}\\chapter{e}\\subsection{f}")], "doc string, node long, text string")
    got = {r.title: r.parent_pos for r in segment.sections(segment.explode_markers(f)).collect()}
    assert got == {"a": None, "b": 1, "c": 2, "d": 1, "e": None, "f": 5}


def test_front_matter_is_the_text(spark):
    t = "% x\n\\documentclass{a}\npre\n\\begin{document}body\\end{document}\nafter"
    for s in (t, "no document at all", ""):
        r = segment.front_matter(spark.createDataFrame([(1, s)], "k int, text string"), "k").first()
        assert r.prologue + r.preamble + r.body + r.epilogue == s


@pytest.mark.parametrize(
    "value,want",
    [("{a!b}", ("a, b", "a, b", "", "", "")), ("{s@k}", ("s", "k", "", "", "")), ("{k|see{z}}", ("k", "k", "z", "", "")), ("{k|(}", ("k", "k", "", "(", "")), ('{a"!b"|c}', ("a!b|c", "a!b|c", "", "", "")), ("{k|textbf}", ("k", "k", "", "", "font-weight-bold")), ("{k|emph}", ("k", "k", "", "", "font-italic"))],
)
def test_parse_index(spark, value, want):
    row = index.entries(spark.createDataFrame([("d", 1, "M_index", value)], "doc string, node long, key string, value string")).first()
    assert (row.sortkey, row.key, row.see, row.value, row.text_class) == want


def test_log_errors(spark):
    log = "start\n./a.tex:12: Undefined control sequence.\nl.12 \\foo\n\nmore\n\nnot this\nb.tex:3: Other\nlast"
    got = activity.log_errors(spark.createDataFrame([(1, log)], "id int, text string"), "id", "text").orderBy("line").collect()
    assert [(r.path, r["at"], r.message, r.context) for r in got] == [("./a.tex", 12, "Undefined control sequence.", "l.12 \\foo\n\nmore"), ("b.tex", 3, "Other", "last")]


def test_file_sources(spark, tmp_path):
    d = tmp_path / "doc1" / "UUID" / "0" / "0" / "1"
    d.mkdir(parents=True)
    (d / "blob_eng.tex").write_text("hello\nworld\n")
    (d / "metadata.txt").write_text("a=b=c\tsecond\nbad\n")
    (d / "blob_eng_7_editstate.json").write_text(json.dumps({"base_md5": "m", "content": "c"}))
    for k in (1, 2):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "main_eng.aux").write_text(f"\\newlabel{{k}}{{{{{k}.2}}{{3}}}}\n\\@input{{sub.aux}}\n\\@input{{../none.aux}}\n")
        (tmp_path / f"d{k}" / "sub.aux").write_text("\\newlabel{q}{{2}{3}{\\it a}}\n\\@input{main_eng.aux}\n")
    (tmp_path / "sym.json").write_text(json.dumps({"\\alpha": 945, "bad1": 3}))
    (tmp_path / "rules.json").write_text(json.dumps({"split": ["theorem", "lemma"]}))
    p = str(tmp_path)
    s = files.read_segments(spark, p).where("ext = '.tex'").first()
    assert (s.doc, s.node, s.lang, s.text) == ("doc1", 1, "eng", "hello\nworld\n")
    assert [(r.key, r.value, r.value2, r.bad) for r in files.read_metadata(spark, p).orderBy("pos").collect()] == [("a", "b=c", "second", None), (None, None, None, "bad")]
    labels = {("/".join(r.path.split("/")[-2:]), r.key, r.value, r.value2) for r in files.read_labels(spark, p).collect()}
    assert labels == {(f"d{k}/{f}", key, v, w) for k in (1, 2) for f, key in (("main_eng.aux", "AUX_label_eng"), ("sub.aux", "AUX_label_")) for v, w in (("{k}", f"{k}.2\t3"), ("{q}", "2\t3\t\\it a"))}
    e = files.read_edits(spark, p).first()
    assert (e.doc, e.node, e.lang, e.user_id, e.base_md5, e.content) == ("doc1", 1, "eng", 7, "m", "c") and e.ts
    assert [tuple(r) for r in files.read_symbol_map(spark, f"{p}/sym.json").collect()] == [("\\alpha", "α")]
    assert sorted(r.value for r in files.read_rules(spark, f"{p}/rules.json").collect()) == ["lemma", "theorem"]
    segs = spark.createDataFrame([("a", 1, "eng", ".tex", "x"), ("b", 2, "eng", ".tex", "y")], "doc string, node long, lang string, ext string, text string")
    files.write_segments(segs, f"{p}/out")
    assert sorted((r.doc, r.text) for r in spark.read.parquet(f"{p}/out").collect()) == [("a", "x"), ("b", "y")]
    files.save_corpus({"segments": segs}, f"{p}/corpus")
    assert files.load_corpus(spark, f"{p}/corpus", ["segments"])["segments"].count() == 2
    assert files.segment_paths(segs).orderBy("doc").first().path == "a/UUID/0/0/1/blob_eng.tex"


def test_upsert_and_replaces(spark):
    a = spark.createDataFrame([("d", 1, "k", "old"), ("d", 1, "m", "x")], "doc string, node long, key string, value string")
    adds = spark.createDataFrame([("d", 1, "k", "n1", 1), ("d", 1, "k", "n2", 2), ("d", 1, "m", "x", 1), ("d", 1, "m", "y", 1)], "doc string, node long, key string, value string, seq int")
    assert sorted((r.key, r.value) for r in attrs.upsert(a, adds, ("k",)).collect()) == [("k", "n2"), ("m", "x"), ("m", "y")]


@needs_data
def test_sql_names_queries_and_the_entry_runs(spark):
    q = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(q) and set(registry.QUERIES) <= set(q)
    assert __spark_entry__.entry(spark).columns == ["user_id", "token", "doc", "node", "lang", "line", "text"]


@needs_data
def test_masked_corpus_shows_no_private_text(spark):
    from quire.fixtures import view

    n = view(spark, DATA, "fx_node")
    shown = segment.mask(n, view(spark, DATA, "fx_edge")).join(n.where("access = 'private'").select("node", F.col("text").alias("secret")), "node")
    assert shown.count() and shown.where(F.col("text").contains(F.col("secret"))).count() == 0


@needs_data
def test_loops_and_federated_search(spark):
    from quire.fixtures import view

    es = view(spark, DATA, "fx_edge_defect").collect()
    want = set()
    for d in {e.doc for e in es}:
        own = [(e.parent, e.child, e.ordinal) for e in es if e.doc == d]
        root = min(r.node for r in view(spark, DATA, "fx_node").where(F.col("doc") == d).collect())
        seen = set()

        def go(node, branch, own=own, d=d, seen=seen):
            if node in branch:
                want.add((d, node, branch[-1]))
            if node not in seen:
                seen.add(node)
                for _, c in sorted((o, c) for p, c, o in own if p == node):
                    go(c, [*branch, node])

        go(root, [])
    got = {(r.doc, r.node, r.parent) for r in registry.QUERIES["tree_loops"](spark, DATA).collect()}
    assert got == want


@needs_data
def test_federated_search_against_brute_force(spark):
    view = lambda name: [r.asDict() for r in fixtures.view(spark, DATA, name).collect()]
    nodes, attributes, grants, authors, members = view("fx_node"), view("fx_attr"), view("fx_grant"), view("fx_author"), view("fx_member")
    users = {u["user_id"]: u for u in view("fx_user")}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    tokens = set()
    for i, t in bench:
        m = re.search("[A-Za-z]+ [A-Za-z]+", t or "")
        tokens |= {m[0] if m else "", f"doc:{i}}}", str(i % 1000).zfill(3)}
    tokens = {t for t in tokens if len(t) > 1}
    indexed = {(r.doc, r.node, r.key) for r in index.entries(fixtures.view(spark, DATA, "fx_attr")).collect()}

    def may(u, perm, n):
        if not users[u]["is_active"]:
            return False
        own = [g for g in grants if g["user_id"] == u and g["perm"] == perm]
        wide = any(g["scope"] == "global" or g["doc"] == n["doc"] and (g["scope"] == "doc" or g["node"] == n["node"]) for g in own)
        word = perm in {"open": ("view_view", "view_blob"), "public": ("view_view",)}.get(n["access"], ())
        editor = perm == "view_view" and any(m["user_id"] == u and m["doc"] == n["doc"] and m["grp"] == "editors" for m in members)
        return wide or word or editor or users[u]["is_superuser"] or any(a["user_id"] == u and a["node"] == n["node"] for a in authors)

    digits = "0123456789BCDFGHJKMNPQRSTVWXYZ"
    want = set()
    for t in tokens:
        own = sum(digits.index(c) * 30**k for k, c in enumerate(reversed(t))) if 3 <= len(t) <= 8 and t.isdigit() else None
        for n in nodes:
            kinds = {"id"} if own == n["node"] else set()
            kinds |= {"text"} if any(t.lower() in line.lower() for line in n["text"].split("\n")) else set()
            kinds |= {"index"} if any(d == n["doc"] and k == n["node"] and t in key for d, k, key in indexed) else set()
            for a in attributes:
                if a["node"] == n["node"] and t in a["value"] and "M_index" not in a["key"]:
                    kinds.add({"M_label": "label", "M_ref": "ref"}.get(a["key"], "meta"))
            for u in (1, 2):
                for kind in kinds:
                    if kind == "id" or kind in ("text", "index") and may(u, "view_view", n) or u == 1 and kind in ("label", "ref", "meta") and may(u, "view_blob", n):
                        want.add((u, t, kind, n["doc"], n["node"]))
    got = registry.QUERIES["search_federated"](spark, DATA).collect()
    assert {(r.user_id, r.token, r.kind, r.doc, r.node) for r in got} == want and len(got) == len(want)
    per = {}
    for w in want:
        per.setdefault(w[:2], []).append(w[2])
    assert all(r.jump == (per[r.user_id, r.token] == ["id"]) for r in got)


def test_protection_leaves_no_text_out(spark):
    from quire.functions import protect

    many = " ".join(f"word{k} \\ref{{x{k}}}" for k in range(7000))
    texts = [many, "a \uE000\uE005 \\b{c} $x$ d% \uF8FF e\n\uE000\\f{\uE001}", "", "plain", "\\a\\b\\a$$y$$", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("toks", protect.tokens(F.col("text")))
    df = df.withColumn("p", protect.protect(F.col("text"), F.col("toks")))
    got = df.select("k", "p", protect.restore(F.col("p"), F.col("toks")).alias("back"), protect.restore(F.upper("p"), F.col("toks")).alias("loud")).orderBy("k").collect()
    assert [r.back for r in got] == texts
    assert not any(x in (r.p or "") for r in got for x in "\\$%")
    assert got[0].loud == many.replace("word", "WORD") and got[1].loud == texts[1].replace("a ", "A ", 1).replace(" d", " D")


@needs_data
def test_protection_query_agrees_with_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(registry.SQL["text_protect"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["text_protect"](spark, DATA).collect())) == sorted(want)


MARKED = ("seg_markers", "seg_environments", "seg_problems", "attr_reparse", "attr_reparse_all", "asm_squash", "text_break", "text_protect", "text_headers")


@needs_data
@pytest.mark.parametrize("name", MARKED)
def test_marked_up_texts_are_whole(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    marked = fixtures.view(spark, DATA, "fx_markup").join(spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 1).alias("node"), F.col("text").alias("whole")), "node")
    assert marked.count() == 200 and marked.where(~F.contains("text", "whole")).count() == 0
    got = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    pick = lambda r, own: tuple(r[own.index(c)] for c in columns)
    assert sorted(str(pick(r, got.columns)) for r in got.collect()) == sorted(str(pick(r, want.columns)) for r in want.fetchall())


def test_markers_skip_verbatim_and_take_braces(spark):
    t = "\\begin{verbatim}\\section{no}\\label{no} % stays\n\\end{verbatim}\\section{A \\emph{b {c}}}% \\label{no}\n5\\% \\label{x{y}}\\verb|\\label{no}|\\includegraphics[w=1]{p.png}"
    rows = segment.explode_markers(spark.createDataFrame([("d", 1, t)], "doc string, node long, text string")).orderBy("pos").collect()
    assert [(r.macro, r.arg) for r in rows[1:]] == [("verbatim", "verbatim"), ("section", "A \\emph{b {c}}"), ("label", "x{y}"), ("verb", ""), ("includegraphics", "p.png")]
    assert "".join(r.raw for r in rows) == t.replace("% \\label{no}", "")
    own = segment.marker_pattern(commands=("mark",), verbatim=("asis",))
    rows = segment.explode_markers(spark.createDataFrame([("d", 1, "\\label{a}\\mark{b}\\begin{asis}\\mark{c}\\end{asis}")], "doc string, node long, text string"), pattern=own, verbatim=("asis",)).orderBy("pos").collect()
    assert [(r.macro, r.arg) for r in rows[1:]] == [("mark", "b"), ("verbatim", "asis")]


def file_of(spark, text, doc="d"):
    return spark.createDataFrame([(doc, 1, text)], "doc string, node long, text string")


def test_markers_with_any_number_and_depth_of_groups(spark):
    deep, wide = "{" * 50 + "x" + "}" * 50, "{g}" * 200_000
    t = f"a\\label{{{deep}}}b\\section*[s]{{{wide}\\label{{in}}}}c\\index{{}}"
    rows = segment.explode_markers(file_of(spark, t)).orderBy("pos").collect()
    assert [(r.macro, r.arg, r.unclosed) for r in rows] == [("", "", ""), ("label", deep, ""), ("section", wide + "\\label{in}", ""), ("index", "", "")]
    assert "".join(r.raw for r in rows) == t
    assert [r.raw[r.size :] for r in rows[1:]] == ["b", "c", ""]


def test_markers_without_an_end_are_told(spark):
    t = "} \\label{a \\ref{b} \\{ \\} {c} % }\n \\index{i{j}"
    deep = segment.with_depth(segment.explode_markers(file_of(spark, t)))
    rows = deep.orderBy("pos").collect()
    assert [(r.macro, r.arg, r.unclosed) for r in rows] == [("", "", "label"), ("ref", "b", "index")]
    assert "".join(r.raw for r in rows) == t.replace("% }", "")
    none = spark.createDataFrame([], "doc string, path string")
    assert sorted((r.code, r.detail) for r in segment.problems(deep, none).collect()) == [("unclosed", "index"), ("unclosed", "label")]


def brace_loop(text):
    """Markers \\label{...} that end, outermost ones only, by a stack."""
    stack, found = [], []
    for k, c in enumerate(text):
        if c == "{":
            stack.append(k)
        elif c == "}" and stack:
            b = stack.pop()
            if text[:b].endswith("\\label"):
                found.append((b - 6, k, text[b + 1 : k]))
    return [a for s, e, a in sorted(found) if not any(x < s and e < y for x, y, _ in found)]


def test_markers_against_a_stack(spark):
    r = random.Random(12)
    texts = ["".join(r.choice(["{", "}", "\\label{", "x", " ", "}"]) for _ in range(r.randrange(0, 40))) for _ in range(200)]
    rows = segment.explode_markers(spark.createDataFrame(list(enumerate(texts)), "node long, text string").withColumn("doc", F.lit("d"))).orderBy("node", "pos").collect()
    for k, t in enumerate(texts):
        own = [x for x in rows if x.node == k]
        assert [x.arg for x in own[1:]] == brace_loop(t)
        assert "".join(x.raw for x in own) == t


def test_each_document_goes_by_its_own_rules(spark):
    rules = spark.createDataFrame([("a", "metadata_command", "mark"), ("a", "metadata_command", "bad(name"), ("b", "verbatim_environment", "raw"), ("b", "split_environment", "thm")], "doc string, name string, value string")
    table = segment.document_rules(rules)
    assert sorted((r.doc, r.commands, r.verbatim, r.splits) for r in table.collect()) == [("a", ["mark"], None, None), ("b", None, ["raw"], ["thm"])]
    t = "\\mark{1}\\label{2}\\begin{raw}\\mark{3}\\label{4}\\end{raw}\\begin{verbatim}\\label{5}\\end{verbatim}"
    rows = segment.explode_markers(reduce(DataFrame.unionByName, [file_of(spark, t, x) for x in "abc"]), rules=table).orderBy("pos").collect()
    found = {x: [r.arg for r in rows if r.doc == x and r.macro in ("mark", "label")] for x in "abc"}
    assert found == {"a": ["1", "3"], "b": ["2", "5"], "c": ["2", "4"]}


def test_attributes_of_the_innermost_environment(spark):
    t = "\\input{a}\\begin{A}\\begin{B}\n\\label{ese:tabelle_verita}\\index{table_of_truth}\n\\end{B}\\end{A}"
    deep = segment.with_depth(segment.explode_markers(spark.createDataFrame([("d", 1, t)], "doc string, node long, text string")))
    assert sorted((r.key, r.value) for r in segment.attributes(deep).collect()) == [("S_E_B_M_index", "{table_of_truth}"), ("S_E_B_M_label", "{ese:tabelle_verita}")]


def test_numbers_of_one_large_group(spark):
    from quire.operators.numbering import last_before, number_within

    r = random.Random(5)
    rows = [("a" if r.random() < 0.8 else r.choice(["b", None]), k, r.choice([None, k])) for k in r.sample(range(100_000), 3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    got = {(x.g, x.k): x.n for x in number_within(df, ["g"], ["k"]).collect()}
    last = {(x.g, x.k): x.last_v for x in last_before(df, ["g"], ["k"], ["v"]).collect()}
    for g in ("a", "b", None):
        before = None
        for n, (_, k, v) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1]), 1):
            assert got[g, k] == n and last[g, k] == before
            before = v if v is not None else before
    assert number_within(df.limit(0), ["g"], ["k"]).count() == 0


def test_rights_stay_in_their_document(spark):
    from quire.operators import access

    users = spark.createDataFrame([(1, True, False), (2, True, False), (3, False, True), (4, True, True)], "user_id long, is_active boolean, is_superuser boolean")
    members = spark.createDataFrame([(2, "A", "editors"), (2, "B", "authors")], "user_id long, doc string, grp string")
    nodes = spark.createDataFrame([("A", 5, "private"), ("B", 5, "private")], "doc string, node long, access string")
    grants = spark.createDataFrame([(1, "view_view", "node", "A", 5), (2, "view_blob", "doc", "B", None)], "user_id long, perm string, scope string, doc string, node long")
    authors = spark.createDataFrame([("B", 5, 1)], "doc string, node long, user_id long")
    asked = spark.createDataFrame([(u, p, d, 5) for u in (1, 2, 3, 4, 9) for p in ("view_view", "view_blob") for d in "AB"], "user_id long, perm string, doc string, node long")
    got = {(r.user_id, r.perm, r.doc) for r in access.allowed(asked, users, members, nodes, grants, authors).where("ok").collect()}
    assert got == {(1, "view_view", "A"), (1, "view_view", "B"), (1, "view_blob", "B"), (2, "view_view", "A"), (2, "view_blob", "B")} | {(4, p, d) for p in ("view_view", "view_blob") for d in "AB"}
    assert access.allowed(asked, users, members, nodes, grants, authors).count() == 20


def test_status_takes_repeated_results(spark):
    before = spark.createDataFrame([("d", 1, {"latex": False, "html": False})], "doc string, node long, status map<string,boolean>")
    results = spark.createDataFrame([("d", 1, "latex", False, 1), ("d", 1, "latex", True, 2), ("d", 2, "html", True, 1), ("d", 2, "html", False, 2)], "doc string, node long, prog string, ok boolean, seq int")
    assert {r.node: r.status for r in attrs.merge_status(before, results).collect()} == {1: {"html": False}, 2: {"html": False}}


def test_terms_are_found_everywhere(spark, monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("abAB \n") for _ in range(r.randrange(0, 60))) for _ in range(80)] + [None, ""]
    terms = ["".join(r.choice("abAB ") for _ in range(r.randrange(1, 4))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    want = sorted({(k, t) for k, x in enumerate(texts) for t in terms if x and t in x})
    for block in (1 << 22, 5):
        monkeypatch.setattr(index, "TERM_BLOCK", block)
        got = index.find_terms(df, F.col("text"), spark.createDataFrame([(t,) for t in [*terms, "", None]], "term string"))
        assert sorted((x.k, x.term) for x in got.collect()) == want


def greedy(sources, depth):
    """The look-ahead rule written down plainly, for versions named a, b, c..."""
    left = {chr(97 + k): list(s) for k, s in enumerate(sources) if s}
    out = []
    while left:
        if len({s[0] for s in left.values()}) == 1 and len(left) > 1:
            out.append(("".join(sorted(left)), next(iter(left.values()))[0]))
            own = list(left)
        else:
            if len(left) == 1:
                own = list(left)
            else:
                far = []
                for head in left:
                    for other in left:
                        if other != head:
                            ahead = left[other][1:depth]
                            far.append((ahead.index(left[head][0]) if left[head][0] in ahead else depth + 1, other, head))
                own = [min(far)[1]]
            out.append((own[0], left[own[0]][0]))
        for k in own:
            left[k].pop(0)
        left = {k: s for k, s in left.items() if s}
    return out


def test_lookahead_against_the_plain_rule():
    r = random.Random(4)
    for _ in range(300):
        sources = [[r.choice("abcde") for _ in range(r.randrange(0, 10))] for _ in range(3)]
        assert [("".join(chr(97 + k) for k in own), t) for own, t in languages.lookahead(sources, 5)] == greedy(sources, 5)


def test_mixed_texts_give_their_versions_back(spark):
    r = random.Random(6)
    rows = []
    for node in range(60):
        base = [r.choice(["a", "b", "", "  c", "\\input{UUID/a/blob_LLL}", "\\CDLeng x", "y \\CDLfra z"]) for _ in range(r.randrange(0, 12))]
        for lang in r.sample(["eng", "ita", "fra", "deu", "spa"], r.randint(1, 5)):
            own = [x.replace("LLL", lang) for x in base if r.random() < 0.8 for _ in range(r.choice([1, 1, 1, 2]))]
            rows.append(("d", node, lang, "\n".join(own)))
    versions = spark.createDataFrame(rows, "doc string, node long, lang string, text string")
    back = {(x.node, x.lang): x.text for x in languages.from_mul(languages.to_mul(versions), versions.select("doc", "lang").distinct()).collect()}
    for _, node, lang, text in rows:
        assert back[node, lang] == text.removesuffix("\n") + "\n"


def test_lookahead_with_owners_keeps_every_line():
    r = random.Random(8)
    for _ in range(300):
        sources = [[r.choice("abcd") for _ in range(r.randrange(0, 9))] for _ in range(4)]
        merged = languages.lookahead(sources, 6, together=True)
        assert [[t for own, t in merged if k in own] for k in range(4)] == sources


@needs_data
def test_queries_without_sql_against_loops(spark):
    from quire.functions import protect

    marked = {r.node: r.text for r in fixtures.view(spark, DATA, "fx_markup").collect()}
    shouted = {r.node: r.text for r in registry.QUERIES["lang_translate"](spark, DATA).collect()}
    for node, t in marked.items():
        parts, at = [], 0
        for m in protect.TOKEN.finditer(t):
            parts += [t[at : m.start()].upper(), m[0]]
            at = m.end()
        assert shouted[node] == "".join(parts) + t[at:].upper()
    docs = {r.node: r.doc for r in fixtures.view(spark, DATA, "fx_markup").collect()}
    chars: dict = dict.fromkeys(docs.values(), 0)
    for node, t in marked.items():
        if node % 2 == 0:
            chars[docs[node]] += len(protect.TOKEN.sub("__", t))
    assert {r.doc: r.chars for r in registry.QUERIES["lang_untranslated"](spark, DATA).collect()} == chars
    for r in registry.QUERIES["ids_slugify"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect():
        plain = unicodedata.normalize("NFKD", r.text).encode("ascii", "ignore").decode()
        assert r.slug == re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", plain).strip().lower())


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from quire.streaming import jobs

    source, folder = tmp_path / "in", f"file://{tmp_path}/job"
    source.mkdir()
    schema = "doc string, node long, event_id long, ts long, content string"
    put = lambda k, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{source}/{k}")
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    derived = []

    def make(t):
        if t.count():
            derived.append(sorted(r.node for r in t.collect()))
        return t.select("doc", "node", F.upper("content").alias("up"))

    called = []
    put(0, [("d", k, k, k, f"v{k}") for k in range(50)])
    jobs.derived_stream(read(), ["doc", "node"], ["ts", "event_id"], make, "t", folder)
    put(1, [("d", 3, 60, 60, "new"), ("d", 4, 61, 1, "older"), ("e", 3, 62, 62, "other")])
    out = jobs.derived_stream(read(), ["doc", "node"], ["ts", "event_id"], make, "t", folder)
    want = {("d", k): f"V{k}" for k in range(50)} | {("d", 3): "NEW", ("e", 3): "OTHER"}
    assert {(r.doc, r.node): r.up for r in out.collect()} == want and out.count() == len(want)
    assert derived[-1] == [3, 3] and len(derived) == 2
    jobs.run_available(read(), lambda b, e: None, f"file://{tmp_path}/hook", after=lambda b, e: called.append(b.count()))
    assert sum(called) == 53


def test_paragraphs_and_their_parents(spark):
    f = spark.createDataFrame([("d", 1, "short\n\nlong enough to go\n \n\nx\n\n")], "doc string, node long, text string")
    assert [(r.text, r.child) for r in segment.paragraphs(f, 10).orderBy("pos").collect()] == [("short", False), ("long enough to go", True), ("x", False), ("", False)]
    assert segment.without_paragraphs(f, 10).first().text == "short\n\n\\input{PAR/1}%\n\nx\n\n"


def test_entities_and_verbatim(spark):
    assert one(spark, T.html_to_text(F.col("s")), s="<p>&eacute;&#233;&#x27; &amp;lt; &copy; a&b</p>") == "éé' &lt; © a&b"
    assert one(spark, T.dedollarize(F.col("s")), s="$a$ \\begin{verbatim}$x$\\end{verbatim} $$b$$ \\verb+$y$+ 5\\$") == "\\(a\\) \\begin{verbatim}$x$\\end{verbatim} \\[b\\] \\verb+$y$+ 5\\$"

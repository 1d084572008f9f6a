"""Jobs whose memory, shuffles or tasks may not grow with batches of rows, copies of texts or scans that are repeated."""

import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F
from test_round3 import plan_of

from quire.functions import protect
from quire.functions import text as T
from quire.operators import audit, languages, tree
from quire.scratch import written


def test_markup_is_protected_without_python(spark):
    r = random.Random(5)
    parts = ["\\a", "\\b*[o]{x}{y}", "$x$", "$$y$$", "\\[z\\]", "%c\n", "\\%", "w", " ", "\n", "é", "\ue000", "\uf8ff", "{", "}", "\U0001d538", "$"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 25))) for _ in range(300)] + [" ".join(f"\\r{{{k}}}" for k in range(6500)), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("toks", protect.tokens(F.col("text")))
    shown = df.select("k", "toks", protect.protect(F.col("text"), F.col("toks")).alias("p"), protect.protected_length(F.col("text"), F.col("toks")).alias("n"))
    shown = shown.withColumn("back", protect.restore(F.col("p"), F.col("toks")))
    assert "Python" not in plan_of(shown)
    for x in shown.collect():
        text = texts[x.k]
        if text is None:
            assert x.p is x.n is x.back is None
            continue
        own = list(dict.fromkeys(m[0] for m in protect.TOKEN.finditer(text)))
        digits = lambda i: chr(0xE001 + i) if i < 6399 else digits(i // 6399) + digits(i % 6399)
        wanted = protect.TOKEN.sub(lambda m: "\ue000" + digits(own.index(m[0])), text)
        assert (x.toks, x.p, x.n, x.back) == (own, wanted, len(wanted), text)


def test_accents_are_composed_without_python(spark):
    marks = "".join(map(re.escape, T.ACCENTS))
    pattern = re.compile(rf"\\([{marks}])\s*(?:\{{\s*(\\?[A-Za-z])\s*\}}|(\\?[A-Za-z]))")

    def one(m):
        if m[1].isalpha() and m[2] is None and not m[0][2:3].isspace():
            return m[0]
        return unicodedata.normalize("NFC", (m[2] or m[3]).lstrip("\\") + T.ACCENTS[m[1]])

    r = random.Random(9)
    parts = ["\\", "`", "^", '"', "u", "v", "c", "=", "{", "}", " ", "\u2003", "\xa0", "\n", "e", "A", "i", "\\i", "é", "."]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 30))) for _ in range(2000)] + ["\\u x \\u{\\v{a}} \\c\xa0c", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", T.accents_to_unicode(F.col("text")).alias("text"))
    assert "Python" not in plan_of(got)
    assert {x.k: x.text for x in got.collect()} == {k: t if t is None else pattern.sub(one, t) for k, t in enumerate(texts)}


def test_translator_gets_some_texts_at_a_time(spark):
    run = languages.translate(spark.createDataFrame([("d", k, "eng", f"a{k} \\b") for k in range(3)] + [("d", 3, "eng", None), ("d", 4, "ita", "x")], "doc string, node long, lang string, text string"), lambda t, old, new: t and t.upper(), "eng", "xxx")
    assert "InArrow" in plan_of(run) and "Pandas" not in plan_of(run)
    assert sorted(map(tuple, run.collect())) == [("d", 0, "xxx", "A0 \\b"), ("d", 1, "xxx", "A1 \\b"), ("d", 2, "xxx", "A2 \\b"), ("d", 3, "xxx", None)]


def test_lines_of_edits_are_counted_in_their_rows(spark):
    r = random.Random(2)
    text = lambda: None if r.random() < 0.05 else "\n".join(r.choice(["a", "b", "", "c\t1", "a "]) for _ in range(r.randrange(0, 9)))
    rows = [(k, a := text(), a if r.random() < 0.2 else text()) for k in range(500)]
    got = T.line_changes(spark.createDataFrame(rows, "k long, old string, new string"), ["k"], "old", "new")
    assert "Generate" not in plan_of(got) and "Union" not in plan_of(got)
    count = lambda t: Counter() if t is None else Counter(t.split("\n"))
    wanted = {(k, (count(b) - count(a)).total(), (count(a) - count(b)).total()) for k, a, b in rows if a is not None or b is not None}
    assert {(x.k, x.added, x.removed) for x in got.collect()} == wanted


def test_versions_of_a_node_come_together_once(spark):
    rows = [("d", 1, "eng", "a\nb"), ("d", 1, "ita", "a\nc"), ("d", 2, "fra", "x\n \ny")]
    mixed = languages.to_mul(spark.createDataFrame(rows, "doc string, node long, lang string, text string"))
    assert {x.node: x.text for x in mixed.collect()} == {1: "a\n\\CDLeng b\n\\CDLita c", 2: "\\CDLfra x\n \n\\CDLfra y"}
    assert "Join" not in plan_of(mixed) and "Pandas" not in plan_of(mixed)


def test_walks_send_no_table_through_the_driver(spark):
    edges = written(spark.range(2, 60).selectExpr("'d' as doc", "id div 2 as parent", "id as child", "id as ordinal"), "given").unionByName(spark.createDataFrame([("d", 40, 3, 9), ("d", 50, 1, 9)], "doc string, parent long, child long, ordinal long"))
    asked = spark.sparkContext.accumulator(0)

    def seen(batches):
        asked.add(1)
        yield from batches

    roots = spark.createDataFrame([("d", 1)], "doc string, root long").coalesce(1).mapInArrow(seen, "doc string, root long")
    visits = tree.walk(edges, roots)
    assert asked.value == 1
    looped = tree.loops(visits)
    assert "Broadcast" not in plan_of(looped) and "SortMergeJoin" in plan_of(looped)
    assert sorted((x.node, x.parent) for x in looped.collect()) == [(1, 50)]
    found = audit.missing_input(written(edges.selectExpr("doc", "parent as node", "'eng' as lang", "child as target"), "given"), written(edges.selectExpr("doc", "parent as node", "'ita' as lang").distinct(), "given"))
    assert "Broadcast" not in plan_of(found)

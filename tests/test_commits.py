"""Commits over several tables, and the job that parses a corpus again."""

import pytest
from pyspark.sql import functions as F

from quire.operators import reparse
from quire.sources.commits import Conflict, CorpusTables


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def values(df):
    return sorted(r.v for r in df.collect())


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path):
    t = CorpusTables(spark, f"file://{tmp_path}/corpus")
    assert t.version() == 0 and t.done("a") is None
    assert t.commit({"x": frame(spark, 1), "y": frame(spark, 2)}, job="a") == 1
    assert t.commit({"x": frame(spark, 9)}, job="a") == 1 and values(t.read("x")) == [1]
    broken = frame(spark, 3).select(F.raise_error(F.lit("lost")).cast("long").alias("v"))
    with pytest.raises(Exception, match="lost"):
        t.commit({"x": frame(spark, 3), "y": broken}, job="b")
    assert t.version() == 1 and values(t.read("x")) == [1] and values(t.read("y")) == [2]
    assert t.commit({"x": frame(spark, 3), "y": frame(spark, 4)}, job="b") == 2
    assert values(t.read("x")) == [3] and values(t.read("x", 1)) == [1]
    with pytest.raises(Conflict):
        t.commit({"x": frame(spark, 5)}, base=1)
    assert t.commit({"y": frame(spark, 6)}) == 3 and values(t.read("x")) == [3] and values(t.read("y")) == [6]
    assert len(t.clean()) >= 4 and values(t.read("x")) == [3] and values(t.read("y")) == [6]
    assert t.version() == 3 and t.commit({"x": frame(spark)}) == 4 and values(t.read("x")) == []


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = (CorpusTables(spark, f"file://{tmp_path}/corpus") for _ in range(2))
    a.commit({"x": frame(spark, 1)})
    base = b.version()
    a.commit({"x": frame(spark, 2)})
    with pytest.raises(Conflict):
        b.commit({"x": frame(spark, 3)}, base)
    assert values(b.read("x")) == [2]


def test_reparse_of_a_small_corpus(spark, tmp_path):
    t = CorpusTables(spark, f"file://{tmp_path}/corpus")
    texts = {
        1: "\\cite{a, b}\\label{x}\\index{k|(}\\index{k|)}\\input{f3}\\input{f2}\\input{f3}\\input{none}",
        2: "\\begin{eq}\\label{x}\\label{y}\\end{eq}\\uuid{003}\\index{q|)}\\label{open",
        3: "\\label{x}\\input{f1}",
        4: "\\label{new}",
    }
    environ = {4: "graphic_file"}
    segments = spark.createDataFrame([("d", k, environ.get(k, "section"), s) for k, s in texts.items()], "doc string, node long, environ string, text string")
    old = [(1, "M_label", "{x}"), (1, "M_label", "{gone}"), (2, "rangeindexLeng", "k"), (3, "lang", "eng"), (4, "M_label", "{kept}"), (9, "M_label", "{other}")]
    stored = spark.createDataFrame([("d", *x) for x in old], "doc string, node long, key string, value string")
    edges = spark.createDataFrame([("d", 1, 2, 5), ("d", 1, 4, 6), ("d", 9, 1, 1)], "doc string, parent long, child long, ordinal long")
    files = spark.createDataFrame([("d", f"f{k}", k) for k in (1, 2, 3)], "doc string, path string, target long")
    roots = spark.createDataFrame([("d", 1)], "doc string, root long")
    t.commit({"segments": segments, "attrs": stored, "edges": edges})
    assert reparse.reparse_corpus(t, files, roots, job="first") == 2
    got = sorted(tuple(r)[1:] for r in t.read("attrs").collect())
    assert got == sorted(
        [(1, "M_cite", "{a}"), (1, "M_cite", "{b}"), (1, "M_label", "{x}"), (1, "M_index", "{k|(}"), (1, "M_index", "{k|)}"), (2, "S_E_eq_M_label", "{x}"), (2, "S_E_eq_M_label", "{y}"), (2, "M_index", "{q|)}")]
        + [(2, "rangeindex", "k"), (3, "rangeindex", "k"), (3, "lang", "eng"), (4, "M_label", "{kept}"), (9, "M_label", "{other}")]
    )
    assert sorted(tuple(r)[1:] for r in t.read("edges").collect()) == [(1, 2, 2), (1, 3, 1), (3, 1, 1), (9, 1, 1)]
    assert {r.node: r.order_in_document for r in t.read("orders").collect()} == {1: 2, 2: 3, 3: 1, 4: 2147483647}
    report = sorted((r.node, r.code, r.detail) for r in t.read("report").collect() if r.code not in ("NEW",))
    assert report == sorted([(1, "DELETED", "M_label {gone}"), (1, "CHILD_NEW", "3"), (1, "CHILD_GONE", "4"), (3, "CHILD_NEW", "1"), (2, "WRONG_UUID", "{003}"), (3, "DUPLICATE_LABEL", "M_label {x}"), (2, "RANGE_CLOSE", " q"), (2, "UNCLOSED", "label")])
    version = t.version()
    assert reparse.reparse_corpus(t, files, roots, job="first") == version == t.version()
    again = reparse.reparse_corpus(t, files, roots)
    assert sorted(tuple(r)[1:] for r in t.read("attrs").collect()) == got
    assert {r.code for r in t.read("report", again).collect()} == {"WRONG_UUID", "DUPLICATE_LABEL", "RANGE_CLOSE", "UNCLOSED"}

"""Queries against their SQL, and jobs whose rows may not be multiplied or moved more than they need."""

import contextlib
import glob
import io
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire.operators import access, segment
from quire.plans import stream_queries
from quire.sources import files

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def against_sql(spark, name):
    """The rows of a query and those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    df = __spark_entry__.queries()[name](spark, DATA)
    base = duckdb.connect()
    for t in glob.glob(f"{DATA}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t}'")
    cols = ", ".join(f'"{c}"' for c in df.columns)
    return Counter(map(tuple, df.collect())), Counter(base.execute(f"SELECT {cols} FROM ({__spark_entry__.oracle_sql()[name]}) q").fetchall())


@needs_data
def test_metadata_files_hold_extensions(spark):
    got, wanted = against_sql(spark, "src_metadata")
    assert got == wanted and any(key == "extension" for _, _, key, _, _ in wanted)


def plan_of(df):
    """The physical plan of a query, as text."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def test_pieces_of_a_text_move_nowhere(spark):
    r = random.Random(7)
    parts = ["\\begin{A}", "\\end{A}", "\\begin{B}[o]", "\\end{B}", "{", "}", "\\label{", "\\begin{verbatim}\\end{verbatim}", "\\item ", "é", "\\section*[s]{"]
    texts = [(k, "".join(r.choice(parts) for _ in range(r.randrange(0, 30)))) for k in range(300)] + [(300, None), (301, "")]
    given = spark.createDataFrame(texts, "node long, text string").withColumn("doc", F.lit("d"))
    deep = segment.explode_deep(given)
    plan = plan_of(deep)
    assert "Window" not in plan and "Exchange" not in plan and "Sort" not in plan
    windows = segment.with_depth(segment.explode_markers(given)).select(*deep.columns)
    assert Counter(map(tuple, deep.collect())) == Counter(map(tuple, windows.collect()))
    assert {r.node for r in deep.select("node").distinct().collect()} == set(range(300)) | {301}


def test_pairs_have_the_rights_of_requests_and_are_not_moved(spark):
    r = random.Random(3)
    perms = ["view_view", "view_blob", "download", "add_blob", "view_log"]
    users = spark.createDataFrame([(u, r.random() < 0.8, r.random() < 0.1, u % 3) for u in range(40)], "user_id long, is_active boolean, is_superuser boolean, k long")
    members = spark.createDataFrame([(r.randrange(45), r.choice("AB"), r.choice(["editors", "authors"])) for _ in range(20)], "user_id long, doc string, grp string")
    nodes = spark.createDataFrame([(d, n, r.choice(["open", "public", "private"]), n % 3) for d in "ABC" for n in range(8)], "doc string, node long, access string, k long")
    grants = spark.createDataFrame([(r.randrange(45), r.choice(perms), r.choice(["global", "doc", "node", "node", "node"]), r.choice("ABC"), r.randrange(9)) for _ in range(80)], "user_id long, perm string, scope string, doc string, node long")
    authors = spark.createDataFrame([(r.choice("ABC"), r.randrange(9), r.randrange(45)) for _ in range(30)], "doc string, node long, user_id long")
    pairs = access.paired(nodes, users, members, grants, authors, "k")
    got = pairs.select("user_id", "doc", "node", F.explode(F.array(*[F.struct(F.lit(p).alias("perm"), access.may(F.lit(p)).alias("ok")) for p in perms])).alias("q")).select("user_id", "q.perm", "doc", "node", "q.ok")
    asked = nodes.drop("access").join(users.select("user_id", "k"), "k").select("user_id", F.explode(F.array(*map(F.lit, perms))).alias("perm"), "doc", "node")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, access.allowed(asked, users, members, nodes, grants, authors).collect()))
    # from the top of the plan to the join of pairs nothing is exchanged
    assert "Exchange" not in plan_of(pairs).split("Join", 1)[0]
    assert len({(x.user_id, x.doc, x.node) for x in pairs.collect()}) == pairs.count()

    docs = spark.createDataFrame([("A", True), ("B", False), ("C", True)], "doc string, author_can_add boolean")
    adds = access.paired_to_add(nodes, users, members, grants, authors, docs, "k").select("user_id", "doc", "node", access.may(F.lit("add_blob")).alias("ok"))
    wanted = access.can_add(asked.drop("perm").distinct(), users, members, nodes, grants, authors, docs)
    assert Counter(map(tuple, adds.collect())) == Counter(map(tuple, wanted.collect()))


def test_people_to_tell_are_not_grouped_by_pair(spark):
    users = spark.createDataFrame([(u, u != 4, True) for u in range(6)], "user_id long, is_active boolean, verified boolean")
    members = spark.createDataFrame([(u, "A", "editors") for u in (1, 2, 2, 4)] + [(5, "A", "authors")], "user_id long, doc string, grp string")
    authors = spark.createDataFrame([("A", 1, 2), ("A", 1, 3), ("A", 2, 4)], "doc string, node long, user_id long")
    asked = spark.createDataFrame([("A", 1), ("A", 1), ("A", 2), ("B", 1)], "doc string, node long")
    told = access.interested(asked, authors, users, members)
    assert sorted(map(tuple, told.collect())) == [("A", 1, 1, 1), ("A", 1, 2, 0), ("A", 1, 3, 0), ("A", 2, 1, 1), ("A", 2, 2, 1)]
    assert "Aggregate" not in plan_of(told).split("Union", 1)[0]


def test_folders_of_many_nodes_are_listed_in_a_job(spark, tmp_path):
    for k in range(200):
        folder = tmp_path / f"d{k % 3}" / "UUID" / str(k % 7) / str(k)
        folder.mkdir(parents=True)
        (folder / f"blob_eng_{k}_editstate.json").write_text('{"base_md5": "m", "content": "c"}')
    (tmp_path / "d0" / "top.tex").write_text("a")
    (tmp_path / "top.tex").write_text("b")
    (tmp_path / "_hidden.tex").write_text("c")
    given = files._folders(spark, str(tmp_path))
    assert len(given) >= 200 and len(given) == len(set(given))
    assert sorted(r.text for r in files.read_sources(spark, str(tmp_path)).collect()) == ["a", "b"]
    assert sorted(r.user_id for r in files.read_edits(spark, str(tmp_path)).collect()) == list(range(200))
    assert files._folders(spark, f"{tmp_path}/d*") == [f"{tmp_path}/d*"]


@needs_data
def test_state_of_edits_holds_no_texts(spark):
    assert "content" not in stream_queries._events(spark, DATA).columns
    got, wanted = against_sql(spark, "stream_edit_state")
    assert got == wanted

"""Texts that are empty or missing, and files that no driver lists."""

import glob
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_round3 import plan_of

import __spark_entry__
from quire.operators import access
from quire.sources import files

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TEXTS = ["", None, " ", "\n\n", "\t.\x0b ; a] b", "\xa0a.  ", "x)  y} z;", ".", "é\r\nb. ", "\u3000", "c. "]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables, with odd texts in every third document."""
    root = tmp_path_factory.mktemp("odd")
    for t in glob.glob(f"{DATA}/*.parquet"):
        os.symlink(t, root / os.path.basename(t))
    os.unlink(root / "documents.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = F.get(F.array(*map(F.lit, TEXTS)), (F.col("doc_id") / 3 % len(TEXTS)).cast("int"))
    docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, text).otherwise(F.col("text"))).toPandas().to_parquet(root / "documents.parquet")
    return str(root)


def against_sql(spark, name, root):
    """The rows of a query over the tables of a folder and those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    df = __spark_entry__.queries()[name](spark, root)
    base = duckdb.connect()
    for t in glob.glob(f"{root}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t}'")
    cols = ", ".join(f'"{c}"' for c in df.columns)
    return Counter(map(tuple, df.collect())), Counter(base.execute(f"SELECT {cols} FROM ({__spark_entry__.oracle_sql()[name]}) q").fetchall())


@needs_data
def test_an_empty_text_is_an_empty_catalog_line(spark, odd):
    got, wanted = against_sql(spark, "text_catalog_lines", odd)
    assert got == wanted and any(line == 0 and text == "" for _, line, text in got)


@needs_data
@pytest.mark.parametrize("name", ["src_files", "src_segments"])
def test_files_of_empty_and_null_texts_are_read(spark, odd, name):
    got, wanted = against_sql(spark, name, odd)
    assert got == wanted and {None, "d41d8cd98f00b204e9800998ecf8427e"} <= {x[-1] for x in got}


def test_files_of_any_folders_are_read_as_they_are(spark, tmp_path):
    rows = [(f"d{k % 3}/x {k}%2 [é]/f{k}.tex", t) for k, t in enumerate(["", None, "a", "\r\nb\n", "\ufeffé", "c" * 100] * 5)] + [(f"flat/{k}.tex", str(k)) for k in range(2 * files.MANY)]
    root = f"file://{tmp_path}/all"
    sizes = files.write_texts(spark.createDataFrame(rows, "path string, text string"), root).collect()
    assert {x.path: x.bytes for x in sizes} == {p: None if t is None else len(t.encode()) for p, t in rows}
    (tmp_path / "all" / "_hidden").mkdir()
    (tmp_path / "all" / "_hidden" / "x.tex").write_text("x")
    (tmp_path / "all" / "d0" / "other.log").write_text("x")
    read = lambda path: sorted((x.path, x.text) for x in files.read_sources(spark, path).collect())
    assert read(root) == read(str(tmp_path / "all")) == sorted((f"{root}/{p}", t) for p, t in rows)
    assert read(f"{tmp_path}/a*/d?") == sorted((f"{root}/{p}", t) for p, t in rows if p.startswith("d"))
    # a folder of many files is named once, and neither it nor its files are listed by the driver
    assert len(files._folders(spark, root)) < 100
    # what is written again takes the place of what was there, null or not
    files.write_texts(spark.createDataFrame([(rows[1][0], "now"), (rows[2][0], None)], "path string, text string"), root)
    assert [(p, t) for p, t in read(f"{root}/d1") if "f1." in p] == [(f"{root}/{rows[1][0]}", "now")]
    assert [(p, t) for p, t in read(f"{root}/d2") if "f2." in p] == [(f"{root}/{rows[2][0]}", None)]
    (tmp_path / "raw.tex").write_bytes(b"\xffz")
    assert [bytes(x.b) for x in files.read_files(spark, f"{tmp_path}/raw.tex", "x$").select(F.col("text").cast("binary").alias("b")).collect()] == [b"\xffz"]
    with pytest.raises(Exception, match="(?i)not.exist"):
        files.read_sources(spark, f"{tmp_path}/none").collect()


def test_metadata_of_a_node_is_a_file(spark, tmp_path):
    nodes = spark.createDataFrame([("a/b", 1, "eng", "open", None, ".tex,.png"), ("a/b", 2, None, None, None, None), ("c", 1, "ita", None, "input", ".tex")], "doc string, node long, lang string, access string, environ string, exts string")
    edges = spark.createDataFrame([("a/b", 1, 2)], "doc string, parent long, child long")
    attrs = spark.createDataFrame([("a/b", 1, "k", "v=w", "x"), ("a/b", 1, "k", "v=w", None), ("c", 1, "k", None, None)], "doc string, node long, key string, value string, value2 string")
    root = f"{tmp_path}/m"
    for _ in range(2):
        files.write_metadata(nodes, edges, attrs, root)
        (tmp_path / "m" / "doc=old").mkdir()
        (tmp_path / "m" / "doc=old" / "x.txt").write_text("k=v\n")
    (tmp_path / "m" / "doc=old" / "x.txt").unlink()
    told = {os.path.relpath(p, root): open(p).read() for p in glob.glob(f"{root}/*/*/*.txt")}
    assert {p.rpartition("/")[0]: sorted(text.splitlines()) for p, text in told.items()} == {
        "doc=a%2Fb/node=1": sorted(["lang=eng", "access=open", "extension=.tex", "extension=.png", "child_uuid=2", "k=v=w\tx", "k=v=w"]),
        "doc=a%2Fb/node=2": ["parent_uuid=1"],
        "doc=c/node=1": sorted(["lang=ita", "environ=input", "extension=.tex", "k="]),
    }
    assert len(told) == 3
    assert {(x.doc, x.node) for x in spark.read.text(root).collect()} == {("a/b", 1), ("a/b", 2), ("c", 1)}
    read = files.read_metadata(spark, root).where("key = 'k' and path like '%b/node=1/%'")
    assert {(x.value, x.value2) for x in read.collect()} == {("v=w", None), ("v=w", "x")}


@needs_data
def test_metadata_is_not_moved_when_it_is_written(spark, odd):
    root = f"file://{odd}/metadata"
    nodes = spark.createDataFrame([("a", k, "eng", "open", "x", ".tex") for k in range(50)], "doc string, node long, lang string, access string, environ string, exts string")
    files.write_metadata(nodes, nodes.select("doc", F.col("node").alias("parent"), F.col("node").alias("child")).limit(0), nodes.select("doc", "node", F.lit("k").alias("key"), F.lit("v").alias("value")), root)
    # Spark's own writer leaves check sums of files that it has moved
    assert not glob.glob(f"{odd}/metadata/*/*/.*.crc") and len(glob.glob(f"{odd}/metadata/*/*/*")) == 50


def test_rights_that_no_pair_asks_for_are_not_moved(spark):
    r = random.Random(4)
    users = spark.createDataFrame([(u, r.random() < 0.8, u == 7) for u in range(40)], "user_id long, is_active boolean, is_superuser boolean").withColumn("k", F.col("user_id") % 5)
    nodes = spark.createDataFrame([(d, n, r.choice(["open", "public", "private"])) for d in "AB" for n in range(20)], "doc string, node long, access string").withColumn("k", F.col("node") % 5)
    members = spark.createDataFrame([(u, r.choice("AB"), r.choice(["editors", "authors"])) for u in range(40)], "user_id long, doc string, grp string")
    given = [(r.randrange(44), r.choice(["view_view", "view_blob", "download", "add_blob"]), r.choice(["global", "doc", "node", "node"]), r.choice("ABC"), r.randrange(24)) for _ in range(300)] + [(None, "download", "node", "A", 1)]
    grants = spark.createDataFrame(given, "user_id long, perm string, scope string, doc string, node long")
    authors = spark.createDataFrame([(r.choice("AB"), r.randrange(20), r.randrange(40)) for _ in range(60)], "doc string, node long, user_id long")
    perms = ("view_view", "view_blob", "download", "add_blob")
    told = lambda pairs: Counter(map(tuple, pairs.select("user_id", "doc", "node", *[access.may(F.lit(p)).alias(p) for p in perms]).collect()))
    meets = F.expr("user_id % 5 = node % 5")
    assert told(access.paired(nodes, users, members, grants, authors, "k", meets)) == told(access.paired(nodes, users, members, grants, authors, "k"))
    asked = nodes.select("doc", "node", "k").join(users.select("user_id", "k"), "k").select("user_id", F.explode(F.array(*map(F.lit, perms))).alias("perm"), "doc", "node")
    wanted = {(x.user_id, x.perm, x.doc, x.node): x.ok for x in access.allowed(asked, users, members, nodes, grants, authors).collect()}
    assert {(u, p, d, n): ok for u, d, n, *oks in told(access.paired(nodes, users, members, grants, authors, "k", meets)) for p, ok in zip(perms, oks, strict=True)} == wanted


@needs_data
@pytest.mark.parametrize("name", ["access_allowed"])
def test_pairs_leave_rights_out_where_they_are_read(spark, odd, name):
    got, wanted = against_sql(spark, name, odd)
    assert got == wanted
    # grants of nodes are scanned with the condition that a user and a node meet by
    plan = plan_of(__spark_entry__.queries()[name](spark, odd))
    assert any("% 100" in x and "Filter" in x and "o_custkey" in x for x in plan.splitlines())


def test_pairs_come_in_runs_of_one_row_and_value(spark):
    left, right = spark.range(60).select("id", (F.col("id") % 2).alias("k")), spark.range(900).select(F.col("id").alias("other"), (F.col("id") % 3).alias("k"))
    wanted = Counter((a % 2, a, b, e) for a in range(60) for b in range(900) if a % 2 == b % 3 for e in "xyz")
    for n, lists in ((1, 1), (4, 1), (16, 1), (4, 3)):
        pairs = access.meet(left, right, "k", ["id"], ["other"], n, lists, F.array(*map(F.lit, "xyz")))
        plan = plan_of(pairs)
        assert "Sort [" in plan and plan.count("Exchange") == 2
        rows = [(x.k, x.id, x.other, x["__each"]) for x in pairs.collect()]
        assert Counter(rows) == wanted
        # a left row is in as many shares as the right rows of its key are dealt to
        starts = sum(i == 0 or rows[i - 1][1] != x[1] or rows[i - 1][3] != x[3] for i, x in enumerate(rows))
        assert starts <= 60 * 3 * (access.SHARES // n) * lists
    assert (access.runs(900000, 100, 4), access.runs(15000, 100, 16), access.runs(10**9, 1, 1), access.runs(0, 0, 4)) == (4, 1, 8, 1)


@pytest.mark.parametrize("read", [files.read_segments, files.read_sources, files.read_edits, files.read_rules], ids=["src_segments", "src_labels", "src_edits", "src_rules"])
def test_files_are_listed_by_tasks(spark, tmp_path, read):
    root = f"file://{tmp_path}"
    files.write_texts(spark.createDataFrame([("d/UUID/0/0/1/blob_eng.tex", "a"), ("d/UUID/0/0/1/blob_eng_7_editstate.json", '{"base_md5": "m", "content": "c"}'), ("d/x.json", '{"name": ["v"]}')], "path string, text string"), root)
    df = read(spark, root)
    assert df.count() >= 1 and "FileScan" not in plan_of(df) and "MapInArrow" in plan_of(df)


@needs_data
@pytest.mark.parametrize("name", ["src_rules", "src_edits", "src_labels"])
def test_files_of_nodes_with_odd_texts(spark, odd, name):
    got, wanted = against_sql(spark, name, odd)
    assert got == wanted

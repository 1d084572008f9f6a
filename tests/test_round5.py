"""Large tables are copied no more than they have to be, and don't go through the driver."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_round3 import plan_of

from quire.fixtures import view
from quire.operators import access
from quire.operators.numbering import running_sum


def test_the_larger_side_of_pairs_is_copied_least(spark):
    # sixteen shares of each key: rows of one side are sent to the shares of the other
    moved = lambda a, b: (lambda n: a * (access.SHARES // n) + b * n)(access.shares(a, b))
    assert moved(51282, 900000) < 2.2e6 and moved(512820, 15000) < 0.8e6 and moved(512820, 900000) < 5.7e6
    assert (access.shares(10**9, 1), access.shares(1, 10**9)) == (16, 1)
    left, right = spark.range(60).select("id", (F.col("id") % 2).alias("k")), spark.range(90).select(F.col("id").alias("other"), (F.col("id") % 3).alias("k"))
    wanted = Counter((a % 2, a, b) for a in range(60) for b in range(90) if a % 2 == b % 3)
    for n in (1, 2, 4, 8, 16):
        pairs = access.meet(left, right, "k", ["id"], ["other"], n)
        assert Counter(map(tuple, pairs.select("k", "id", "other").collect())) == wanted
        assert "Exchange" not in plan_of(pairs).split("Join", 1)[0]


def test_users_without_need_of_lists_send_none(spark):
    users = spark.createDataFrame([(1, True, False, 0), (2, True, True, 0), (3, False, True, 0), (4, True, None, 0), (5, None, False, 0)], "user_id long, is_active boolean, is_superuser boolean, k long")
    members = spark.createDataFrame([(u, "A", "editors") for u in range(1, 6)], "user_id long, doc string, grp string")
    nodes = spark.createDataFrame([("A", 1, "private", 0), ("A", 2, "public", 0), (None, 3, None, 0)], "doc string, node long, access string, k long")
    grants = spark.createDataFrame([(u, "download", s, "A", 1) for u in range(1, 6) for s in ("global", "doc", "node")], "user_id long, perm string, scope string, doc string, node long")
    authors = spark.createDataFrame([("A", 2, 1), ("A", 2, 4), ("A", 2, 3)], "doc string, node long, user_id long")
    pairs = access.paired(nodes, users, members, grants, authors, "k")
    perms = ("view_view", "view_blob", "download", "add_blob", "view_log")
    got = pairs.select("user_id", "doc", "node", *[access.may(F.lit(p)).alias(p) for p in perms])
    asked = nodes.drop("access").crossJoin(users.select("user_id")).select("user_id", F.explode(F.array(*map(F.lit, perms))).alias("perm"), "doc", "node")
    wanted = {(x.user_id, x.perm, x.doc, x.node): x.ok for x in access.allowed(asked, users, members, nodes, grants, authors).collect()}
    assert {(x.user_id, p, x.doc, x.node): x[p] for x in got.collect() for p in perms} == wanted
    for x in pairs.collect():
        assert x.user_id in (1, 4) or (x["__anywhere"], x["__here"]) == (None, None)


def test_nodes_and_edges_are_joined_without_the_driver(spark):
    for name in ("fx_node", "fx_edge", "fx_local"):
        assert "Broadcast" not in plan_of(view(spark, "/root/testdata/sf0.001", name))
    # what stays are the roots, one for each document
    assert plan_of(view(spark, "/root/testdata/sf0.001", "fx_edge_defect")).count("BroadcastHashJoin") <= 2


def test_sums_carry_only_groups_that_begin_in_another_partition(spark):
    r = random.Random(2)
    rows = [(g, k, r.randrange(9) if r.random() < 0.9 else None) for g in [0] * 400 + list(range(1, 300)) for k in [r.random()]] + [(None, 0.5, 1), (None, 0.7, 2)]
    got = running_sum(spark.createDataFrame(rows, "g long, k double, v long").repartition(7), ["g"], ["k"], "v")
    seen, wanted = {}, []
    for g, k, v in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        wanted.append((g, k, v, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + (v or 0)
    assert Counter(map(tuple, got.collect())) == Counter(wanted)
    assert "LeftOuter" in plan_of(got)

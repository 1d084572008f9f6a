"""Hashes of subtrees against a recursive function, made whole and kept up over random changes."""

import hashlib
import random

from pyspark.sql import functions as F

from quire.operators import hashes

TREE = "doc string, node long, parent long, ordinal long, own string, depth long"


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def wanted(tree):
    """{(doc, node): hash} of {(doc, node): [parent, ordinal, own]}."""
    kids = {}
    for (doc, node), (parent, ordinal, _) in tree.items():
        kids.setdefault((doc, parent), []).append((ordinal, node))
    out = {}

    def walk(doc, node):
        out[doc, node] = md5(tree[doc, node][2] + "".join(walk(doc, k) for _, k in sorted(kids.get((doc, node), []))))
        return out[doc, node]

    for doc, node in list(tree):
        if tree[doc, node][0] is None:
            walk(doc, node)
    return out


def table(spark, tree):
    def depth(doc, node):
        parent = tree[doc, node][0]
        return 0 if parent is None else 1 + depth(doc, parent)

    return spark.createDataFrame([(doc, node, *row, depth(doc, node)) for (doc, node), row in tree.items()], TREE)


def got(df):
    rows = df.collect()
    assert len({(r.doc, r.node) for r in rows}) == len(rows)
    return {(r.doc, r.node): r.hash for r in rows}


def random_tree(r, n):
    out = {}
    for doc in "de":
        for k in range(n):
            parent = None if k == 0 else max(0, k - 1 - r.choice((0, 0, 1, 4, 9)))
            out[doc, k] = [parent, r.randrange(4), md5(f"{doc}{r.randrange(5)}")]
    return out


def test_whole_trees_against_recursion(spark):
    for seed in range(2):
        tree = random_tree(random.Random(seed), 25)
        assert got(hashes.subtree_hashes(table(spark, tree))) == wanted(tree)
    assert got(hashes.subtree_hashes(spark.createDataFrame([], TREE))) == {}


def test_kept_hashes_over_changes(spark, tmp_path):
    r = random.Random(9)
    tree = {k: v for k, v in random_tree(r, 9).items() if k[0] == "d"}
    kept = hashes.Hashes(spark, f"file://{tmp_path}/h")
    kept.update(table(spark, tree).withColumn("gone", F.lit(False)), 0)
    assert got(kept.rows()) == wanted(tree)
    for epoch in range(1, 4):
        if epoch == 1:  # a text; nothing but the node and those above it is written
            leaf = max(k for k in tree)
            tree[leaf][2] = md5("new")
        elif epoch == 2:  # a subtree goes elsewhere, a node comes, and a leaf goes
            tree["d", 4][0] = 0
            tree["d", 90] = [2, 1, md5("added")]
            leaves = [k for k in tree if k[1] not in {v[0] for v in tree.values()} and k != ("d", 90)]
            del tree[leaves[0]]
        else:  # an order
            tree["d", 2][1] += 7
        kept.update(kept.changes(table(spark, tree)), epoch)
        assert got(kept.rows()) == wanted(tree), epoch
    before = kept.rows().select("doc", "node", "hash").collect()
    kept.update(spark.createDataFrame([], TREE + ", gone boolean"), 4)
    assert sorted(kept.rows().select("doc", "node", "hash").collect()) == sorted(before)
    kept.update(kept.changes(table(spark, {})), 4)  # an epoch that is done does nothing
    assert sorted(kept.rows().select("doc", "node", "hash").collect()) == sorted(before)


def test_a_leaf_writes_its_ancestors_alone_and_a_repeated_epoch_starts_anew(spark, tmp_path, monkeypatch):
    tree = {("d", 0): [None, None, md5("r")]} | {("d", k): [(k - 1) // 5, k, md5(str(k))] for k in range(1, 30)}
    kept = hashes.Hashes(spark, f"file://{tmp_path}/h")
    kept.update(table(spark, tree).withColumn("gone", F.lit(False)), 0)
    old = wanted(tree)
    tree["d", 29][2] = md5("new")
    change = kept.changes(table(spark, tree))
    assert [(x.node, x.gone) for x in change.collect()] == [(29, False)]
    change = spark.createDataFrame(change.collect(), change.schema)

    class Lost(Exception):
        pass

    def lose(*_):
        raise Lost

    monkeypatch.setattr(kept, "_done", lose)
    try:
        kept.update(change, 1)
    except Lost:
        pass
    assert got(kept.rows()) == old
    monkeypatch.undo()
    kept.update(change, 1)
    assert got(kept.rows()) == wanted(tree)
    written = [spark.read.parquet(f"file://{tmp_path}/h/level-{d}/rows/__epoch=1").count() for d in range(3)]
    assert written == [1, 1, 1]

"""State tables of streams: a base and a log of changes, against a dictionary."""

import os
import random

from quire.streaming import jobs

SCHEMA = "doc string, node long, v long"


def test_table_against_a_dictionary(spark, tmp_path):
    r = random.Random(4)
    table, want = jobs.Table(spark, ["doc", "node"], f"file://{tmp_path}/t", log_rows=12), {}
    states = []
    for epoch in range(14):
        keys = {(r.choice("ab"), r.randrange(6)) for _ in range(r.randrange(0, 5))}
        new = [(*k, epoch * 100 + i) for k in keys if r.random() < 0.8 for i in range(r.randrange(1, 3))]
        changed, rows = (spark.createDataFrame(x, s) for x, s in ((sorted(keys), "doc string, node long"), (new, SCHEMA)))
        for _ in range(1 + (epoch % 5 == 3)):  # some batches are repeated
            table.merge(changed, rows, epoch)
        for k in keys:
            want[k] = sorted(v for *x, v in new if tuple(x) == k)
        states.append({k: list(v) for k, v in want.items()})
        if epoch % 3 == 1:
            again = jobs.Table(spark, ["doc", "node"], f"file://{tmp_path}/t", log_rows=12)
            assert sorted(tuple(x) for x in again.rows(rows.schema).collect()) == sorted((*k, v) for k, vs in want.items() for v in vs)
            asked = {tuple(x)[:2] for x in again.rows(rows.schema, changed).collect()}
            assert {k for k in keys if want[k]} <= asked
    assert sorted(tuple(x) for x in table.rows(rows.schema, epoch=13).collect()) == sorted((*k, v) for k, vs in states[12].items() for v in vs)
    assert table.state()["base"] is not None
    assert len(os.listdir(f"{tmp_path}/t/lists")) == jobs.GRACE and len(os.listdir(f"{tmp_path}/t/base")) <= jobs.GRACE


def test_a_batch_writes_its_own_keys_alone(spark, tmp_path):
    table = jobs.Table(spark, ["doc", "node"], f"file://{tmp_path}/t")
    many = spark.range(30_000).selectExpr("'d' AS doc", "id AS node", "id AS v")
    table.merge(many, many, 0)
    assert table.state() == {"base": 0, "buckets": 1, "rows": 30_000, "log": [], "logged": 0}
    few = spark.createDataFrame([("d", 5, 7)], SCHEMA)
    table.merge(few, few, 1)
    assert table.state()["log"] == [1] and table.state()["logged"] == 2
    assert spark.read.parquet(f"file://{tmp_path}/t/rows/__epoch=1").count() == 1
    assert table.rows(few.schema).where("node = 5").first().v == 7 and table.rows(few.schema).count() == 30_000

"""The change feed against its batch twin, with events out of order over many batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quire.streaming import jobs

SCHEMA = "doc string, node long, event_id long, ts timestamp, content string, extra int"
START = dt.datetime(2024, 1, 1)


def batch_twin(rows):
    out, by = set(), {}
    for doc, node, event, ts, content, _ in rows:
        by.setdefault((doc, node), set()).add((ts, event, content or ""))
    for key, events in by.items():
        last = None
        for _, event, content in sorted(events):
            if content != last:
                out.add((*key, event, content))
            last = content
    return out


def feed(spark, source, folder, rows, k, delay):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{source}/{k}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
    return jobs.appended(jobs.changes(stream, delay), "changes", folder)


def as_set(spark, df, rows):
    texts = spark.createDataFrame(sorted({(r[4] or "",) for r in rows}), "content string").withColumn("md5", F.md5("content"))
    return sorted((tuple(r) for r in jobs.settled(df).join(texts, "md5").select("doc", "node", "event_id", "content").collect()), key=repr)


def test_late_events_are_put_in_order_across_batches(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for i in range(240):
        node = None if i % 40 == 7 else r.choice((1, 1, 1, 2, 3))
        rows.append((r.choice("de"), node, i, START + dt.timedelta(minutes=i), r.choice(("a", "b", None, "")), i))
    rows += rows[100:110]
    shuffled = sorted(enumerate(rows), key=lambda x: x[0] + r.randrange(0, 50))  # at most 50 minutes and a bit out of order
    shuffled = [x for _, x in shuffled]
    seen = []
    for k in range(6):
        part = shuffled[k * 42 : (k + 1) * 42]
        seen += part
        out = feed(spark, str(tmp_path / "in"), f"file://{tmp_path}/job", part, k, "300 minutes")
        got = as_set(spark, out, seen)
        assert got and set(got) == batch_twin(seen) and len(got) == len(set(got))
    assert out.where("change = -1").count() > 0


def test_events_after_the_delay_are_left_out_and_state_is_let_go(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    batches = [
        [("d", 1, 0, None, "z", 0), ("d", 1, 1, at(0), "a", 0), ("d", 1, 3, at(2), "a", 0), ("d", 2, 9, at(2), "x", 0)],
        [("d", 1, 4, at(10), "b", 0)],
        [("d", 1, 2, at(1), "late", 0), ("d", 1, 7, None, "late", 0), ("d", 1, 5, at(9.5), "a", 0), ("d", 1, None, at(11), None, 0)],
        [("d", 2, 8, at(50), "x", 0)],
    ]
    for k, part in enumerate(batches):
        out = feed(spark, str(tmp_path / "in"), f"file://{tmp_path}/job", part, k, "1 hour")
    rows = [x for part in batches for x in part]
    assert as_set(spark, out, rows) == [("d", 1, -1, ""), ("d", 1, 0, "z"), ("d", 1, 1, "a"), ("d", 1, 4, "b"), ("d", 2, 9, "x")]
    state = spark.read.format("statestore").option("path", f"file://{tmp_path}/job/progress").option("stateVarName", "held").load()
    assert state.select("key").distinct().count() == 2 and state.count() == 3  # node 1 settled on one row; of node 2 the last two


def test_an_empty_stream(spark, tmp_path):
    out = feed(spark, str(tmp_path / "in"), f"file://{tmp_path}/job", [], 0, "1 hour")
    assert jobs.settled(out).count() == 0

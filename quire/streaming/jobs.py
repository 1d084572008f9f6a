"""Structured Streaming forms of the incremental jobs; each equals its batch twin once the stream has been read.

A job has a folder: what the stream has been read to, and its state tables. Started again on the same folder, it goes on
where it stopped. A state table is a base, dealt out by keys over buckets, and a log of what later batches have changed:
a batch writes the rows of its own keys alone, whatever the table's size. When the log has grown as large as the base,
the two are written together as a new base, with as many buckets as its rows need. A small list that names the present
base and log is written last, so a batch that is repeated after a failure starts from the list before it.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quire.operators.activity import newest
from quire.scratch import shared_path

#: Rows in a bucket of a base, about; the least size of a log that is worth a new base, and the most batches in one.
BUCKET_ROWS, LOG_ROWS, LOG_BATCHES = 1_000_000, 20_000, 64
#: Lists whose files are kept.
GRACE = 3
#: Where keyed state stands.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Read what there is, batch by batch, and stop; the progress is kept in ``folder``. ``after`` is a callback of the
    caller's that gets each batch once it has been written."""

    def both(batch: DataFrame, epoch: int) -> None:
        write(batch, epoch)
        if after is not None:
            after(batch, epoch)

    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    given = conf.get(key)
    conf.set(key, ROCKS)
    try:
        q = stream.writeStream.foreachBatch(both).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).outputMode("append").start()
    finally:
        conf.set(key, given)
    q.awaitTermination()


class _Changes(StatefulProcessor):
    """Of each key: the events that may still get others before them, in order, and the last one before those."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", "ts long, event_id long, md5 string")

    def _keep(self, rows: list[tuple], timers: TimerValues) -> None:
        mark = timers.getCurrentWatermarkInMs() * 1000
        settled = bisect_left(rows, True, key=lambda x: x[0] > mark)  # a later event can't come before these
        rows = rows[max(0, settled - 1) :]
        self._held.put(rows)
        if len(rows) > 1:
            self._handle.registerTimer(rows[-1][0] // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self._held.get()] if self._held.exists() else []
        come = {x for part in rows for x in zip(part["ts"].tolist(), part["event_id"].tolist(), part["md5"], strict=True)}
        if held and held[0][0] <= timerValues.getCurrentWatermarkInMs() * 1000:
            come = {x for x in come if x > held[0]}  # what was before it may be gone
        changed = lambda all_: {x for x, last in zip(all_, [None, *all_]) if last is None or x[2] != last[2]}
        before = changed(held)
        now = sorted(come.union(held))
        after = changed(now)
        out = [(*key, x[1], x[2], -1) for x in sorted(before - after)] + [(*key, x[1], x[2], 1) for x in sorted(after - before)]
        self._keep(now, timerValues)
        yield pd.DataFrame(out, columns=["key", "event_id", "md5", "change"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep([tuple(x) for x in self._held.get()], timerValues)
        return iter(())


def changes(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """(doc, node, event_id, md5, change) of versions(doc, node, event_id, ts, content): 1 for a version whose
    fingerprint differs from that of the version before it by (ts, event_id), and -1 for one that was told so and isn't
    any more, because an event in between came later. The sum of a version's changes is 1 or 0, as in the batch twin,
    however the events are spread over batches, as long as none comes over ``delay`` after a later one; what comes after
    that is left out. A first version counts as a change. Null contents count as empty, null ids as -1, and null times
    as the first. Repeated events count once.

    State: for each node the events within the delay, without their texts, and the one before them. They are kept by
    RocksDB, which ``run_available`` sets; those of one node in one batch are in memory together (some 100 bytes each), so a
    source that is far behind should be read with ``maxFilesPerTrigger``."""
    known = stream.select("doc", "node", F.coalesce("event_id", F.lit(-1)).cast("long").alias("event_id"), "ts", F.md5(F.coalesce("content", F.lit(""))).alias("md5"))
    timed = known.withColumnRenamed("ts", "at").withWatermark("at", delay)
    # as one string, since a null among a batch's keys would turn whole numbers into floats
    rows = timed.select(F.to_json(F.struct("doc", "node")).alias("key"), "event_id", F.coalesce(F.unix_micros("at"), F.lit(-(1 << 62))).alias("ts"), "md5", "at")
    out = rows.groupBy("key").transformWithStateInPandas(_Changes(), "key string, event_id long, md5 string, change int", "append", "eventTime")
    return out.withColumn("k", F.from_json("key", "doc string, node long")).select("k.doc", "k.node", "event_id", "md5", "change")


def settled(feed: DataFrame) -> DataFrame:
    """(doc, node, event_id, md5) of a feed of changes as it is now."""
    return feed.groupBy("doc", "node", "event_id", "md5").agg(F.sum("change").alias("__n")).where("__n > 0").drop("__n")


class Table:
    """A table of rows by key: a base and a log of changes. ``merge`` replaces the rows of some keys."""

    def __init__(self, spark: SparkSession, keys: list[str], root: str, log_rows: int = LOG_ROWS):
        self.spark, self.keys, self.root, self.log_rows = spark, keys, root, log_rows
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, epoch: int):
        return self._path(f"{self.root}/lists/{epoch}/state.json")

    def _lists(self) -> list[int]:
        folder = self._path(f"{self.root}/lists")
        if not self._store.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._store.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit() and self._store.exists(self._list(n)))

    def state(self, epoch: int | None = None) -> dict:
        """The present list, or that before an epoch: the base's epoch (null if none), buckets and rows, and the log's epochs
        and rows."""
        before = [n for n in self._lists() if epoch is None or n < epoch]
        if not before:
            return {"base": None, "buckets": 1, "rows": 0, "log": [], "logged": 0}
        file = self._store.open(self._list(before[-1]))
        try:
            return json.loads(self.spark._jvm.java.util.Scanner(file, "UTF-8").useDelimiter("\\A").next())
        finally:
            file.close()

    def _put(self, epoch: int, state: dict) -> None:
        """A list appears whole, by renaming."""
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = self._store.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._store.delete(self._path(f"{self.root}/lists/{epoch}"), True)
        self._store.mkdirs(self._path(f"{self.root}/lists/{epoch}"))
        if not self._store.rename(draft, self._list(epoch)):
            raise OSError(f"no list for {epoch} in {self.root}")

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _read(self, kind: str, epochs: list[int], schema) -> DataFrame:
        """Files of some epochs, with ``__epoch``."""
        whole = StructType([*schema.fields, StructField("__epoch", LongType())])
        paths = [f"{self.root}/{kind}/__epoch={e}" for e in epochs]
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def rows(self, schema, asked: DataFrame | None = None, epoch: int | None = None) -> DataFrame:
        """The rows of all keys, or those of ``asked`` keys and some more; as they were before ``epoch``, if given."""
        return self._at(self.state(epoch), schema, asked)

    def _at(self, s: dict, schema, asked: DataFrame | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        if s["base"] is not None:
            whole = StructType([*schema.fields, StructField("__bucket", IntegerType())])
            out = self.spark.read.schema(whole).parquet(f"{self.root}/base/{s['base']}")
            if asked is not None:
                touched = [r[0] for r in asked.select(self._bucket(s["buckets"])).distinct().collect()]
                out = out.where(F.col("__bucket").isin(touched))
            out = out.drop("__bucket")
        if s["log"]:
            keys = StructType([schema[k] for k in self.keys])
            last = self._read("keys", s["log"], keys).groupBy(*self.keys).agg(F.max("__epoch").alias("__epoch"))
            logged = self._read("rows", s["log"], schema).join(last, [*self.keys, "__epoch"], "left_semi").select(*schema.names)
            out = out.join(last, self.keys, "left_anti").select(*schema.names).unionByName(logged)
        return out

    def merge(self, changed: DataFrame, new: DataFrame, epoch: int) -> None:
        """Put ``new`` in the place of the rows of the keys in ``changed``."""
        s, schema = self.state(epoch), new.schema
        new.write.mode("overwrite").parquet(f"{self.root}/rows/__epoch={epoch}")
        changed.select(*self.keys).distinct().write.mode("overwrite").parquet(f"{self.root}/keys/__epoch={epoch}")
        kinds = (("rows", schema), ("keys", changed.select(*self.keys).schema))
        parts = [self.spark.read.schema(x).parquet(f"{self.root}/{kind}/__epoch={epoch}").select(F.lit(1)) for kind, x in kinds]
        size = parts[0].union(parts[1]).count()
        now = s | {"log": [*s["log"], epoch], "logged": s["logged"] + size}
        if now["logged"] > max(self.log_rows, s["rows"]) or len(now["log"]) > LOG_BATCHES:
            whole = self._at(now, schema)
            n = max(1, -(-(s["rows"] + now["logged"]) // BUCKET_ROWS))
            whole.withColumn("__bucket", self._bucket(n)).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.root}/base/{epoch}")
            stored = StructType([*schema.fields, StructField("__bucket", IntegerType())])
            now = {"base": epoch, "buckets": n, "rows": self.spark.read.schema(stored).parquet(f"{self.root}/base/{epoch}").count(), "log": [], "logged": 0}
        self._put(epoch, now)
        self._clean()

    def _clean(self) -> None:
        """Delete files that none of the last lists names."""
        lists = self._lists()
        if len(lists) <= GRACE:
            return
        kept = [self.state(n + 1) for n in lists[-GRACE:]]
        named = {("base", str(s["base"])) for s in kept} | {(kind, f"__epoch={e}") for s in kept for e in s["log"] for kind in ("rows", "keys")}
        for kind in ("base", "rows", "keys"):
            folder = self._path(f"{self.root}/{kind}")
            for f in self._store.listStatus(folder) if self._store.exists(folder) else ():
                name = f.getPath().getName()
                if (kind, name) not in named and int(name.rsplit("=", 1)[-1]) <= lists[-1]:
                    self._store.delete(f.getPath(), True)
        for n in lists[:-GRACE]:
            self._store.delete(self._path(f"{self.root}/lists/{n}"), True)


def latest_stream(stream: DataFrame, keys: list[str], order: list[str], tag: str, folder: str | None = None) -> DataFrame:
    """The newest row of each key after all that the stream has now."""
    spark = stream.sparkSession
    folder = folder or shared_path(spark, tag)
    table = Table(spark, keys, f"{folder}/latest")

    def write(batch: DataFrame, epoch: int) -> None:
        changed = batch.select(*keys).distinct()
        old = table.rows(stream.schema, changed, epoch).join(changed, keys, "left_semi").select(*stream.columns)
        table.merge(changed, newest(old.unionByName(batch.select(*stream.columns)), keys, order).select(*stream.columns), epoch)

    run_available(stream, write, folder)
    return table.rows(stream.schema)


def derived_stream(stream: DataFrame, keys: list[str], order: list[str], derive: Callable[[DataFrame], DataFrame], tag: str, folder: str | None = None) -> DataFrame:
    """What ``derive`` makes of the newest row of each key, kept up batch by batch: only keys whose newest row a batch
    changes are derived anew, and their rows replaced. ``derive`` must keep the keys in its rows."""
    spark = stream.sparkSession
    folder = folder or shared_path(spark, tag)
    latest, made = Table(spark, keys, f"{folder}/latest"), Table(spark, keys, f"{folder}/made")
    schema = derive(spark.createDataFrame([], stream.schema)).schema

    def write(batch: DataFrame, epoch: int) -> None:
        asked = batch.select(*keys).distinct()
        old = latest.rows(stream.schema, asked, epoch).join(asked, keys, "left_semi").select(*stream.columns)
        now = newest(old.unionByName(batch.select(*stream.columns)), keys, order).select(*stream.columns)
        latest.merge(asked, now, epoch)
        same = old.select(*keys, *order)
        changed = latest.rows(stream.schema, asked).join(asked, keys, "left_semi").join(same, [*keys, *order], "left_anti").select(*stream.columns)
        made.merge(changed, derive(changed), epoch)

    run_available(stream, write, folder)
    return made.rows(schema)


def appended(stream: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """All rows of an append stream, as a table."""
    folder = folder or shared_path(stream.sparkSession, tag)
    run_available(stream, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}"), folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")

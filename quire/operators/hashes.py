"""Hashes of subtrees: made level by level from the deepest, and kept up when nodes change.

A node's hash is the md5 of its own text's md5 and its children's hashes in order (ordinal, then node), so equal hashes
tell equal subtrees. Levels follow the depth in the tree of first visits: as many rounds as the deepest node has
ancestors. All children's hashes of a node stand in one row, 32 bytes each, by definition of the hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.scratch import shared_path
from quire.streaming.jobs import Table

KEY = ["doc", "node"]
ROW = ["doc", "node", "parent", "ordinal", "own"]
STORED = "doc string, node bigint, parent bigint, ordinal bigint, own string, hash string"


def tree_of(nodes: DataFrame, visits: DataFrame, content: str = "text") -> DataFrame:
    """(doc, node, parent, ordinal, own, depth) of the nodes that a walk visits; a null text counts as empty."""
    own = nodes.select(*KEY, F.md5(F.coalesce(content, F.lit(""))).alias("own"))
    return visits.where("is_first").select(*KEY, "parent", "ordinal", "depth").join(own, KEY).select(*ROW, "depth")


def _hashed(rows: DataFrame, below: DataFrame | None) -> DataFrame:
    """Rows of one level with their hash; ``below`` has (at least) all children of theirs."""
    if below is None:
        return rows.select(*ROW, F.md5("own").alias("hash"))
    kids = below.groupBy("doc", F.col("parent").alias("node")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "node", "hash"))), lambda x: x["hash"]), "").alias("kids"))
    return rows.join(kids, KEY, "left").select(*ROW, F.md5(F.concat("own", F.coalesce("kids", F.lit("")))).alias("hash"))


def subtree_hashes(tree: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc, node, parent, ordinal, own, hash, depth) of a whole tree, written by depth: each level is read once for
    itself and once for the level above."""
    spark = tree.sparkSession
    folder = folder or shared_path(spark, "merkle")
    tree.write.partitionBy("depth").parquet(f"{folder}/tree")
    levels = spark.read.schema(tree.schema).parquet(f"{folder}/tree")
    deepest = levels.agg(F.max("depth")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], STORED + ", depth bigint")
    below = None
    for d in range(deepest, -1, -1):
        path = f"{folder}/hashes/depth={d}"
        _hashed(levels.where(F.col("depth") == d), below).write.parquet(path)
        below = spark.read.schema(STORED).parquet(path)
    return spark.read.schema(STORED + ", depth bigint").parquet(f"{folder}/hashes")


class Hashes:
    """Subtree hashes in a folder, a table for each depth. ``update`` reads the levels that changed nodes and their
    ancestors are on, and writes the rows of those nodes and ancestors alone. An epoch that is repeated after a failure
    starts from what was before it; readers see the last whole epoch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.schema = spark.createDataFrame([], STORED).schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _level(self, depth: int) -> Table:
        return Table(self.spark, KEY, f"{self.root}/level-{depth}")

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        at = self._path(folder)
        names = [s.getPath().getName() for s in self._store.listStatus(at)] if self._store.exists(at) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def _last(self) -> int:
        """The last whole epoch, -1 before the first."""
        return max((n for n in self._numbers(f"{self.root}/done", "") if self._store.exists(self._path(f"{self.root}/done/{n}/_SUCCESS"))), default=-1)

    def _done(self, epoch: int) -> None:
        self.spark.createDataFrame([(str(epoch),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/done/{epoch}")

    def rows(self) -> DataFrame:
        """(doc, node, parent, ordinal, own, hash, depth) after the last whole epoch."""
        upto = self._last() + 1
        levels = [self._level(d).rows(self.schema, epoch=upto).withColumn("depth", F.lit(d).cast("bigint")) for d in self._numbers(self.root, "level-")]
        return reduce(DataFrame.unionByName, levels) if levels else self.spark.createDataFrame([], STORED + ", depth bigint")

    def changes(self, tree: DataFrame) -> DataFrame:
        """(doc, node, parent, ordinal, own, depth, gone): how a whole tree differs from what is kept. A node that has
        come to another depth is gone from the one and new at the other, with all that is below it."""
        shape = [*ROW, "depth"]
        old, new = self.rows().select(*shape), tree.select(*shape)
        both = old.withColumn("n", F.lit(-1)).unionByName(new.withColumn("n", F.lit(1)))
        differ = both.groupBy(*shape).agg(F.sum("n").alias("n")).where("n <> 0")
        per = differ.groupBy(*KEY, "depth").agg(F.max("n").alias("n"), F.max(F.when(F.col("n") > 0, F.struct("parent", "ordinal", "own"))).alias("now"))
        return per.select(*KEY, "now.parent", "now.ordinal", "now.own", "depth", (F.col("n") < 0).alias("gone"))

    def update(self, changed: DataFrame, epoch: int) -> None:
        """Take in changed(doc, node, parent, ordinal, own, depth, gone): rows that are new or have changed, and rows
        that have gone. One row for each (doc, node, depth). Epochs grow; the first may bring the whole tree."""
        if epoch <= self._last():
            return
        folder = shared_path(self.spark, "merkle-change")
        changed.select(*ROW, "depth", "gone").write.partitionBy("depth").parquet(f"{folder}/changed")
        whole = self.spark.read.schema(STORED.replace(", hash string", ", gone boolean") + ", depth bigint").parquet(f"{folder}/changed")
        own = sorted(r[0] for r in whole.select("depth").distinct().collect())  # as many as the tree has levels
        up = None
        for d in range(own[-1] if own else -1, -1, -1):
            if up is None and d not in own:
                continue
            table, lower = self._level(d), self._level(d + 1)
            here = whole.where(F.col("depth") == d)  # of partitions by depth, one
            asked = here.select(*KEY) if up is None else here.select(*KEY).unionByName(up).distinct()
            old = table.rows(self.schema, asked, epoch).join(asked, KEY, "left_semi")
            rows = here.where("not gone").select(*ROW).unionByName(old.join(here, KEY, "left_anti").select(*ROW))
            kids = lower.rows(self.schema, epoch=epoch + 1).join(rows.select("doc", F.col("node").alias("parent")), ["doc", "parent"], "left_semi")
            path = f"{folder}/new/{d}"
            _hashed(rows, kids).write.parquet(path)
            new = self.spark.read.schema(STORED).parquet(path)
            # rows that are as they were tell nothing to their parents
            shape = [*KEY, "parent", "ordinal", "hash"]
            both = old.select(*shape).withColumn("n", F.lit(-1)).unionByName(new.select(*shape).withColumn("n", F.lit(1)))
            moved = both.groupBy(*shape).agg(F.sum("n").alias("n")).where("n <> 0")
            moved.where("parent is not null").select("doc", F.col("parent").alias("node")).distinct().write.parquet(f"{folder}/up/{d}")
            table.merge(asked, new, epoch)
            up = self.spark.read.schema("doc string, node bigint").parquet(f"{folder}/up/{d}")
            up = None if up.isEmpty() else up
        self._done(epoch)

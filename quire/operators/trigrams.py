"""An index of texts by trigrams, in which substrings are looked up without reading the texts that can't have them.

A posting tells that a segment holds three characters in a row within one of its lines. Segments are numbered and stand in
blocks; of a trigram and a block there is one row, the list of the block's segments that hold it. A term of three
characters or more is looked for among the segments that stand in the lists of its rarest trigrams, found by an equi-join;
only their texts are read. Lists of a trigram that most segments hold are dealt out over several cells.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.index import build_catalog, find_terms
from quire.scratch import moved, shared_path, written

#: Cells of each trigram, and how many of a term's trigrams are looked up.
CELLS, RAREST = 16, 3
#: Segments of a block, and texts that are gone through together.
BLOCK, TEXTS = 4096, 256
KEYS = ("doc", "node", "lang")


def _grams(texts: list[str | None]) -> pa.ListArray:
    """The distinct trigrams of each text's lines, as numbers: 21 bits for each character."""
    own = []
    for text in texts:
        c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        g = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        ends = c == 10
        g = np.sort(g[~(ends[:-2] | ends[1:-1] | ends[2:])])
        own.append(g[np.append(True, g[1:] != g[:-1])] if len(g) else g)
    starts = np.cumsum([0, *map(len, own)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([np.empty(0, np.int64), *own])))


def postings(segments: DataFrame, keys: tuple = KEYS, text: str = "text") -> DataFrame:
    """(keys..., grams): the distinct trigrams of each segment's lines, lower-cased. A segment's row is made from it alone, so
    that an index can be kept up by the segments that change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                made = _grams(batch.column("__low").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*keys, "grams"])

    rows = segments.select(*keys, F.lower(text).alias("__low"))
    of_keys = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{of_keys}, grams array<bigint>")


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block, held, segs) of (seg, grams): a block is named by its first segment, ``segs`` counts from that."""
    for whole in batches:
        segs = whole.column("seg").to_numpy()
        # numbers go on within a file alone
        cuts = np.flatnonzero(np.diff(segs) != 1) + 1
        for a, b in zip([0, *cuts], [*cuts, len(segs)], strict=True):
            for start in range(a, b, BLOCK):
                grams = whole.column("grams").slice(start, min(BLOCK, b - start))
                values = grams.flatten().to_numpy()
                at = np.repeat(np.arange(len(grams), dtype=np.int32), grams.value_lengths().to_numpy())
                order = np.argsort(values, kind="stable")
                found, first = np.unique(values[order], return_index=True)
                ends = np.append(first, len(values)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order]))
                block = np.full(len(found), segs[start])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(block), pa.array(np.diff(ends)), lists], names=["gram", "block", "held", "segs"])


@dataclass
class Index:
    """Lists in buckets by cell (gram, share), how many segments hold each trigram, and the segments' numbers."""

    rows: DataFrame
    counts: DataFrame
    segments: DataFrame
    keys: tuple


def build(made: DataFrame, keys: tuple = KEYS, root: str | None = None) -> Index:
    """Write postings, as ``postings`` makes them, so that looking terms up doesn't shuffle them again. Lists are made in the
    task that has the segments of a block; postings are not moved one by one."""
    spark: SparkSession = made.sparkSession
    root = root or shared_path(spark, "trigrams")
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"trigrams_{uuid.uuid4().hex}"
    numbered = made.select(*keys, "grams", F.monotonically_increasing_id().alias("seg"))
    numbered.write.parquet(f"{root}/segments")
    numbered = spark.read.schema(numbered.schema).parquet(f"{root}/segments")
    lists = numbered.select("seg", "grams").mapInArrow(_inverted, "gram bigint, block bigint, held int, segs array<int>")
    dealt = lists.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(CELLS)).cast("int")).repartition(n, "gram", "share")
    dealt.write.bucketBy(n, "gram", "share").sortBy("gram", "share").option("path", f"{root}/rows").format("parquet").saveAsTable(name)
    rows = spark.table(name)
    rows.groupBy("gram").agg(F.sum("held").alias("segments")).write.parquet(f"{root}/counts")
    return Index(rows, spark.read.parquet(f"{root}/counts"), numbered.select("seg", *keys), keys)


def _met(index: Index, terms: DataFrame) -> DataFrame:
    """(term, seg): the numbers of the segments that hold all of the rarest trigrams of terms."""
    asked = postings(terms.where(F.length("term") >= 3).select("term").distinct(), ("term",), "term").select("term", F.explode("grams").alias("gram"))
    known = asked.join(index.counts, "gram", "left")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.col("segments").asc_nulls_first(), "gram"))
    rare = written(known.withColumn("k", place).where(F.col("k") <= RAREST), "rare")
    lost = rare.where("segments is null").select("term").distinct()
    rare = rare.join(lost, "term", "left_anti").withColumn("wanted", F.count(F.lit(1)).over(Window.partitionBy("term")))
    spread = rare.select("term", "wanted", "gram", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("share"))
    lists = index.rows.join(spread, ["gram", "share"]).groupBy("term", "wanted", "block").agg(F.collect_list("segs").alias("lists")).where(F.size("lists") == F.col("wanted"))
    both = F.aggregate("lists", F.get("lists", F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    return lists.select("term", "block", F.explode(both).alias("at")).select("term", (F.col("block") + F.col("at")).alias("seg"))


def candidates(index: Index, terms: DataFrame) -> DataFrame:
    """(term, keys...): the segments that hold all of the rarest trigrams of terms(term), which are in lower case. Terms with
    a trigram that no segment holds have none; terms of fewer than three characters aren't answered."""
    return _met(index, terms).join(moved(index.segments), "seg").select("term", *index.keys)


def search(index: Index, segments: DataFrame, tokens: DataFrame, text: str = "text") -> DataFrame:
    """(keys..., line, text, term): the lines of segments that contain a token(term), without regard to case and number of
    spaces. Segments are those that the index was made of. Lines of a segment that may have a token are gone through once
    for all tokens. Tokens under three characters are looked for in all lines."""
    low = F.regexp_replace(F.lower("term"), r"\s+", " ")
    plain = tokens.where("term <> ''").select("term", low.alias("low")).distinct()
    lows = plain.select(F.col("low").alias("term")).distinct()
    long_, short = lows.where(F.length("term") >= 3), lows.where(F.length("term") < 3)
    texts = segments.select(*index.keys, F.col(text).alias("text"))
    found = _met(index, long_).select("seg").distinct().join(moved(index.segments), "seg").select(*[F.col(k).alias(f"__{k}") for k in index.keys])
    # a key may be null, as a language that isn't known
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in index.keys])
    lines = build_catalog(texts.join(moved(found), same, "left_semi"), list(index.keys), "text")
    hits = find_terms(lines, F.lower("text"), long_)
    if not short.isEmpty():
        hits = hits.unionByName(find_terms(build_catalog(texts, list(index.keys), "text"), F.lower("text"), short))
    hits = hits.withColumnRenamed("term", "low").join(F.broadcast(plain), "low")
    return hits.select(*index.keys, F.col("line").cast("long").alias("line"), "text", "term")

"""Ranked lexical search: every item of a query set against all documents, by blocked dense matrix products.

An item's distinct terms are a column of weights, a document's terms a row of impacts; their product is the score. Both
are cut into tiles over the vocabulary of a block of items, without terms that no document of the tile has. Weights and
impacts are whole numbers, and a tile is narrow enough for all partial sums to stay under 2**53, so that float64
products are exact whatever order BLAS adds in; tiles are then added as 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import text_of

TOP = 50
#: Columns of a vocabulary tile. A weight is under 1000 * ln(2**64) < 45,000 and an impact under 10**6, so a tile's sums are under 2048 * 4.5e10 < 2**47.
TILE_TERMS = 2048
TILE_DOCS, TILE_BYTES = 512, 8 << 20
#: Items go in blocks whose terms x items are at most so many weights (32 MB), which bounds what is broadcast; an item that is larger makes a block of its own.
BLOCK_WEIGHTS = 1 << 22
#: Ranks are settled within so many shares of the documents first, so that no task gets all tasks' candidates.
SHARES = 64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all bytes of other characters; A-Z lower-cased."""
    return text.translate(_FOLD).split()


class Block:
    """Items with a vocabulary of their own: the number of each term, and each item's term numbers."""

    def __init__(self, items: list[tuple[int | None, set[bytes]]]):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        self.terms = [[self.number.setdefault(t, len(self.number)) for t in sorted(own)] for _, own in items]

    def weights(self, df: np.ndarray, n: int) -> np.ndarray:
        """Terms x items in float64."""
        out = np.zeros((len(self.number), len(self.ids)))
        w = [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()]
        for column, own in enumerate(self.terms):
            for t in own:
                out[t, column] = w[t]
        return out


def blocks_of(items: DataFrame, item_col: str, item_text: str) -> Iterator[Block]:
    """Blocks of bounded size, read one after the other; rows that repeat an id are one item."""
    rows = items.select(F.col(item_col).cast("long").alias("i"), text_of(item_text).cast("binary").alias("t")).orderBy("i")
    block: list[tuple[int | None, set[bytes]]] = []
    seen: set[bytes] = set()
    for r in rows.toLocalIterator():
        own = set(terms_of(bytes(r.t)))
        if block and block[-1][0] == r.i:
            block[-1][1].update(own)
        else:
            if block and (len(seen | own)) * (len(block) + 1) > BLOCK_WEIGHTS:
                yield Block(block)
                block, seen = [], set()
            block.append((r.i, own))
        seen |= own
    if block:
        yield Block(block)


def _counted(texts: pa.Array, number: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text its number of terms, the numbers of those that the block has, and how often each occurs."""
    get = number.get
    for t in texts:
        words = terms_of(t.as_py())
        known = np.fromiter((k for k in map(get, words) if k is not None), np.int64)
        yield len(words), *np.unique(known, return_counts=True)


def _statistics(rows: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the number of documents of each term of the block."""
    shared = rows.sparkSession.sparkContext.broadcast(block.number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        out = np.zeros(len(number) + 2, np.int64)
        for batch in batches:
            for n, own, _ in _counted(batch.column("text"), number):
                out[0] += n > 0
                out[1] += n
                out[own + 2] += 1
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"at": at, "n": out[at]})

    out = np.zeros(len(block.number) + 2, np.int64)
    for r in rows.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.at] = r.n
    return int(out[0]), int(out[1]), out[2:]


class Best:
    """For each item the documents that are first so far: by score, then by id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.found = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)) for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        """A tile's scores, documents x items. Those equal to an item's last score are looked at too: ids settle them."""
        hits = scores >= self.least
        for k in np.flatnonzero(hits.any(axis=0)):
            own = np.flatnonzero(hits[:, k])
            joined = [np.concatenate(x) for x in zip(self.found[k], (scores[own, k], missing[own], ids[own]), strict=True)]
            order = np.lexsort((joined[2], joined[1], -joined[0]))[: self.top]
            self.found[k] = tuple(x[order] for x in joined)
            if len(order) == self.top:
                self.least[k] = self.found[k][0][-1]


def tile_scores(tile: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n: int, length: int) -> np.ndarray:
    """Exact scores, documents x items, of documents given as (terms, term numbers, counts)."""
    row = np.repeat(np.arange(len(tile)), [len(t[1]) for t in tile])
    term, tf = (np.concatenate([t[k] for t in tile]) for k in (1, 2))
    m = np.array([50 + 50 * t[0] * n // length for t in tile], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[row])
    out = np.zeros((len(tile), weights.shape[1]), np.int64)
    order = np.argsort(term, kind="stable")
    row, term, impact = row[order], term[order], impact[order]
    used, column = np.unique(term, return_inverse=True)
    for low in range(0, len(used), TILE_TERMS):
        a, b = np.searchsorted(column, [low, low + TILE_TERMS])
        dense = np.zeros((len(tile), min(TILE_TERMS, len(used) - low)))
        dense[row[a:b], column[a:b] - low] = impact[a:b]
        out += (dense @ weights[used[low : low + TILE_TERMS]]).astype(np.int64)
    return out


def _scored(rows: DataFrame, block: Block, n: int, length: int, df: np.ndarray, top: int) -> DataFrame:
    """(item_id, doc_id, score) of the first documents of each task."""
    shared = rows.sparkSession.sparkContext.broadcast((block.ids, block.number, block.weights(df, n)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, number, weights = shared.value
        best = Best(len(ids), top)
        for batch in batches:
            missing = np.asarray(batch.column("id").is_null())
            own = np.asarray(batch.column("id").fill_null(0))
            tile, begin, size = [], 0, 0
            for k, counted in enumerate(_counted(batch.column("text"), number)):
                tile.append(counted)
                size += len(counted[1]) * 16
                if len(tile) == TILE_DOCS or size >= TILE_BYTES or k == batch.num_rows - 1:
                    best.add(tile_scores(tile, weights, n, length), missing[begin : k + 1], own[begin : k + 1])
                    tile, begin, size = [], k + 1, 0
        for item, (scores, missing, docs) in zip(ids, best.found, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(scores), pa.int64()), pa.array(docs, pa.int64(), mask=missing), pa.array(scores)], ["item_id", "doc_id", "score"]
                )

    return rows.mapInArrow(score, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with the highest scores above 0 of each item.

    Null and empty texts have no terms: such documents aren't counted, such items give no rows. Equal scores are ranked
    by id, null ids last; rows that repeat an id are documents of their own and take a rank each. Rows of the query
    set that repeat an item's id (null ids are one) are one item with all their terms. An empty table on either
    side gives none; other columns are ignored, whatever their names. Ids are whole numbers.

    A block of items takes two passes over the whole texts: one for the corpus's counts, whose results are as many as
    the block's terms, one for the scores. Each task keeps its own first ``top`` for each item; these are ranked
    within shares of the documents and then together.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text"))
    found = None
    for block in blocks_of(items, item_col, item_text):
        n, length, df = _statistics(rows, block)
        if n:
            part = _scored(rows, block, n, length, df, top)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))
    own = found.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "share").orderBy(*order))).where(F.col("rank") <= top)
    last = own.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts
  FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
w AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
t AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, CAST(count(*) AS BIGINT) AS tf FROM w WHERE term IN (SELECT term FROM i) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
p AS (
  SELECT t.r, t.doc_id, t.term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT)
         * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))) AS score
  FROM t JOIN f USING (term), s),
q AS (SELECT i.item_id, p.r, any_value(p.doc_id) AS doc_id, CAST(sum(p.score) AS BIGINT) AS score FROM i JOIN p USING (term) GROUP BY i.item_id, p.r HAVING sum(p.score) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM q QUALIFY rank <= 50
"""

"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import free_name, materialise, text_of
from quire.llm.graph import components

#: 32 bands of 5 registers: a pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**32 < 4e-6.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Registers are floor(1 - log_BASE(least exponential variate of rate RATE)), clipped to 0..LIMIT.
BASE, RATE, LIMIT = 1.02, 20.0, 4095
#: A candidate pair goes on to verification unless the wanted similarity is less likely than the best by exp(-SLACK).
SLACK = 14.0
PERCENT = 80
KNOWN_WORDS = 150_000
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"register %d" % i) | 1 for i in range(REGISTERS)], np.uint64)


class _Words(dict):
    """64-bit fingerprints of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def forget_words() -> None:
    """Free the table at the end of a task; workers live on and go to other work."""
    _words.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58_476D_1CE4_E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D0_49BB_1331_11EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8").lower().split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the shingles; fewer words than ``size`` make one shingle, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    x = np.zeros(n, np.uint64)
    for k in range(size):
        x = _mix(x + h[k : k + n] + np.uint64(k + 1))
    return np.unique(x)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set (none may be empty). A register is a maximum over a set's elements, so the
    registers of a union are the maxima of its parts' registers."""
    out = np.empty((len(sets), REGISTERS), np.uint16)
    start = 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + len(sets[stop]) <= 1 << 15):
            total += len(sets[stop])
            stop += 1
        x = np.concatenate(sets[start:stop])
        at = np.cumsum([0, *(len(s) for s in sets[start : stop - 1])])
        least = np.empty((stop - start, REGISTERS), np.uint64)
        for j in range(REGISTERS):
            least[:, j] = np.minimum.reduceat(x * _MULTIPLIERS[j], at)
        variate = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0**-64) / RATE
        out[start:stop] = np.clip(np.floor(1 - np.log(variate) / math.log(BASE)), 0, LIMIT)
        start = stop
    return out


def log_likelihood_gap(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How much less likely the joint registers are at the wanted similarity or any above it than at the best one,
    as a difference of logarithms. Registers are compared as greater, less or equal; with the true set sizes their
    probabilities depend on the similarity alone."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    wanted = percent / 100
    grid = np.concatenate([np.linspace(0, wanted, 24, endpoint=False), np.linspace(wanted, 1, 10)])[None, :]
    top = np.minimum(u, 1 - u) / np.maximum(u, 1 - u)
    j = np.minimum(grid, top)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    over, under = p(u - (1 - u) * j), p(1 - u - u * j)
    tiny = 1e-9
    ll = more * np.log(over + tiny) + less * np.log(under + tiny) + same * np.log(np.maximum(1 - over - under, tiny))
    return ll.max(1) - ll[:, 24:].max(1)


def sketch(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n, sig) per row: a 128-bit key of the word sequence, the size of the shingle set, and the registers
    (null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 200):
                sets, keys = [], []
                for t in texts[at : at + 200]:
                    words = split_words(t)
                    keys.append(hashlib.blake2b(b"\0".join(words), digest_size=16).digest())
                    sets.append(shingle_set(words, size))
                full = [k for k, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                for k, row in zip(full, registers([sets[k] for k in full]), strict=True):
                    sig[k] = row.tobytes()
                yield pd.DataFrame({"id": batch["id"].iloc[at : at + 200].tolist(), "key": keys, "n": [len(s) for s in sets], "sig": sig})
        forget_words()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).where("id is not null")
    return rows.mapInPandas(run, "id long, key binary, n long, sig binary")


def _buckets(reps: DataFrame) -> DataFrame:
    """(bucket, id, n): a row for each band; a bucket is a hash of the band's number and registers."""
    width = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + i * width, width)) for i in range(BANDS)])
    return reps.select("id", F.col("n").cast("int").alias("n"), F.explode(bands).alias("bucket"))


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and registers allow the wanted similarity."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, REGISTERS) for c in ("sig_a", "sig_b"))
                gap = log_likelihood_gap(a, b, batch["n_a"].to_numpy(float), batch["n_b"].to_numpy(float), percent)
                yield batch.loc[gap <= SLACK, ["a", "b"]]

    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return joined.where(fits).select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInPandas(keep, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_text, last_set = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch["text_a"], batch["text_b"], strict=True):
                if x != last_text:
                    last_text, last_set = x, shingle_set(split_words(x), size)
                other = shingle_set(split_words(y), size)
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(last_set) + len(other) - both))
            yield batch.loc[keep, ["a", "b"]]
        forget_words()

    side = lambda x: docs.select(F.col(id_col).cast("long").alias(x), text_of(text_col).alias(f"text_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def _mixed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of buckets with members of several components, with ``label``, the member's component. What is known of
    a bucket is written first: then the join with its rows is one that Spark can split where a bucket is large."""
    labelled = materialise(rows.join(joined.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"), "labelled")
    several = materialise(labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket"), "several")
    return labelled.join(several, "bucket")


def _own_shingles(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, own): how many of its shingles a document has that no other of these documents has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                yield pd.DataFrame({"id": part["id"], "shingles": [shingle_set(split_words(t), size).view(np.int64) for t in part["text"]]})
        forget_words()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(ids, "id").dropDuplicates(["id", "text"])
    sets = texts.mapInPandas(run, "id long, shingles array<long>").select("id", F.explode("shingles").alias("s"))
    once = sets.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
    return once.groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def _sets(docs: DataFrame, marked: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(unit, id, label, stray, n, shingles): the sets of the marked documents; a unit is an id with one of its texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                sets = [shingle_set(split_words(t), size).view(np.int64) for t in part["text"]]
                yield part.drop(columns="text").assign(n=[len(x) for x in sets], shingles=sets)
        forget_words()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    units = texts.withColumn("unit", F.xxhash64("id", "text")).join(marked, "id").dropDuplicates(["unit"])
    return units.select("unit", "id", "label", "stray", "text").mapInPandas(run, "unit long, id long, label long, stray boolean, n long, shingles array<long>").where("n > 0")


def _block_links(docs: DataFrame, marked: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): all links between marked(id, label, stray) documents of different labels of which one is a stray.

    Shingles that stand in the same documents form a block, told by the xor of two hashes of those documents; a document
    is then a few blocks with weights, besides the shingles of its own, and a set has all of a block or nothing. Of two
    sets that are alike enough, the larger has all blocks that weigh more than the smaller may miss; with two such blocks
    or more, only sets that have the two rarest of them are looked at. Otherwise the two have a block in common that
    comes early in both: with the rarest first, what stands before the first common one can't weigh more than a set may
    miss, and the weights from there on must allow the link. The pairs that are left are counted exactly, block by block.
    """
    sets = materialise(_sets(docs, marked, size, id_col, text_col), "sets")
    members = sets.select("unit", F.explode("shingles").alias("s"))
    posting = members.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.bit_xor(F.xxhash64("unit")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "unit")).alias("y"))
    posting = posting.where("df > 1").select("s", "df", F.xxhash64("df", "x", "y").alias("block"))
    blocks = materialise(members.join(posting, "s").groupBy("unit", "block").agg(F.count(F.lit(1)).alias("w"), F.min("df").alias("df")), "blocks")
    info = ["unit", "id", "label", "stray", "n"]
    # a block that weighs more than the smaller set may miss is in the larger set too; so are the two rarest of such blocks
    need, have = F.lit(100 + percent) * F.col("w") > F.lit(100 - percent) * F.col("n"), F.lit(100 * (100 + percent)) * F.col("w") > F.lit(percent * (100 - percent)) * F.col("n")
    heavy = blocks.join(sets.drop("shingles"), "unit").where(have).withColumn("need", need)
    heavy = heavy.groupBy(*info).agg(F.array_sort(F.collect_list(F.struct("df", "block", "need"))).alias("h"))
    must = F.transform(F.filter("h", lambda v: v["need"]), lambda v: v["block"])
    heavy = materialise(heavy.select(*info, F.transform("h", lambda v: v["block"]).alias("h"), must.alias("must")), "heavy")
    two = heavy.where(F.size("must") > 1).select(*info, F.get("must", F.lit(0)).alias("one"), F.get("must", F.lit(1)).alias("other"))
    first = heavy.select(*info, "h", F.posexplode("h").alias("i", "one"))
    both = first.select(*info, "one", F.explode(F.slice("h", F.col("i") + 2, F.size("h"))).alias("other"))
    # for the other sets, blocks that come early: what stands before them can be missed
    order = Window.partitionBy("unit").orderBy("df", "block")
    later = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = blocks.select("unit", "block", later.alias("rest")).join(sets.drop("shingles"), "unit")
    rows = materialise(rows.where(F.lit(100) * F.col("rest") >= F.lit(percent) * F.col("n")), "prefixes")
    early = rows.where(F.lit(100 + percent) * F.col("rest") >= F.lit(2 * percent) * F.col("n")).join(two.select("unit"), "unit", "left_anti")
    named = lambda df, k, *on: df.select(*on, *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c not in on])
    lesser = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("unit_x") < F.col("unit_y")))
    wanted = lesser & (F.col("label_x") != F.col("label_y")) & (F.col("stray_x") | F.col("stray_y")) & (F.lit(100) * F.col("n_x") >= F.lit(percent) * F.col("n_y"))
    fits = F.lit(100 + percent) * F.least("rest_x", "rest_y") >= F.lit(percent) * (F.col("n_x") + F.col("n_y"))
    ends = ["unit_x", "unit_y", "id_x", "id_y", "n_x", "n_y"]
    met = named(two, "x", "one", "other").join(named(both, "y", "one", "other"), ["one", "other"]).where(wanted).select(*ends)
    met = met.unionByName(named(early, "x", "block").join(named(rows, "y", "block"), "block").where(wanted & fits).select(*ends))
    pairs = materialise(met.distinct(), "pairs")
    own = F.array_sort(F.collect_list(F.struct("block", "w")))
    vectors = materialise(blocks.groupBy("unit").agg(own.alias("v")).select("unit", F.col("v.block").alias("block"), F.col("v.w").alias("w")), "vectors")
    side = lambda k: vectors.select(F.col("unit").alias(f"unit_{k}"), F.col("block").alias(f"block_{k}"), F.col("w").alias(f"w_{k}"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = []
            for a, w, b in zip(batch["block_x"], batch["w_x"], batch["block_y"], strict=True):
                both.append(int(w[np.intersect1d(a, b, assume_unique=True, return_indices=True)[1]].sum()))
            both = np.array(both, np.int64)
            yield batch.loc[100 * both >= percent * (batch["n_x"].to_numpy() + batch["n_y"].to_numpy() - both), ["id_x", "id_y"]].set_axis(["a", "b"], axis=1)

    return pairs.join(side("y"), "unit_y").join(side("x"), "unit_x").select("id_x", "id_y", "n_x", "n_y", "block_x", "w_x", "block_y").mapInPandas(check, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of ``size`` words (white space is ASCII's, A-Z are lower-cased);
    with fewer words the whole sequence is the one shingle; null, empty and blank texts have an empty set and are
    linked with nothing. Documents are linked when 100 * intersection >= percent * union on their full sets, compared
    as 64-bit fingerprints of shingles. component_id is the least id reachable by links, kept is id = component_id.
    Rows with equal word sequences are one class from the start; rows that share an id are one node. A row without an
    id has component null and is kept. Other columns are ignored; an empty table gives none.

    Candidates come from buckets in three rounds, and what links have joined needs no further test with each other:
    1. each member against the bucket's most typical one, which has the smallest share of shingles of its own and so is
       nearest to the origin of a group of copies. A shingle is a document's own if no other document that shares any
       bucket has it; a document with over a fifth of its set of its own can't be linked, and leaves first;
    2. in buckets that still hold several components, the members outside the most frequent one against the most typical
       of themselves;
    3. of buckets that still do, each such member against the documents of other components, by exact prefixes of their
       sets (see ``_block_links``), without regard to buckets.
    So a bucket of many copies costs about its size, documents around one passage pair up only where they share more than
    the passage, and no candidate pair goes untested unless its documents are joined already or can't be linked.
    """
    sketches = materialise(sketch(docs, size, id_col, text_col), "sketch")
    reps = materialise(sketches.where("n > 0").groupBy("key", "n", "sig").agg(F.min("id").alias("id")), "classes")
    nodes = reps.select("id", "n", "sig")

    def tested(pairs: DataFrame) -> DataFrame:
        likely = materialise(_likely(pairs, nodes, percent), "likely")
        return materialise(_verified(likely, docs, size, percent, id_col, text_col), "tested")

    def star(rows: DataFrame) -> DataFrame:
        """All members of each bucket paired with its most typical one."""
        middle = materialise(rows.groupBy("bucket").agg(F.min_by("id", F.col("own") / F.col("n")).alias("a")), "middle")
        return rows.join(middle, "bucket").where("id <> a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()

    def outside(rows: DataFrame) -> DataFrame:
        """Rows with ``main``, the most frequent label of their bucket."""
        main = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
        return rows.join(materialise(main, "main"), "bucket")

    rows = _buckets(nodes)
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket")
    shared = materialise(rows.join(shared, "bucket"), "buckets")
    own = materialise(_own_shingles(docs, shared.select("id").distinct(), size, id_col, text_col), "own")
    able = shared.join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    able = materialise(able, "able")
    first = tested(star(able))
    joined = materialise(components(first), "components")

    left = materialise(outside(_mixed(able, joined)), "left")
    second = tested(star(left.where("label <> main")))
    links = first.unionByName(second)
    joined = materialise(components(links), "components")

    left = outside(_mixed(left.drop("label", "main"), joined))
    marked = materialise(left.groupBy("id").agg(F.min("label").alias("label"), F.max(F.col("label") != F.col("main")).alias("stray")), "marked")
    if not marked.isEmpty():
        third = materialise(_block_links(docs, marked, size, percent, id_col, text_col), "third")
        if not third.isEmpty():
            joined = components(links.unionByName(third))

    classes = reps.select("key", F.col("id").alias("node")).join(joined, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    whole = sketches.select("id", "key", "n").join(classes, "key", "left")
    out = whole.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    missing = docs.where(F.col(id_col).isNull()).select(text_of(text_col).alias("text"))
    if not missing.isEmpty():
        sets = sketch(missing.select(F.lit(0).alias("id"), "text"), size, "id", "text")
        out = out.unionByName(sets.select(F.lit(None).cast("long").alias("id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, with their own columns, whatever their names: one id of each group
    stays, with all rows that repeat it; rows without an id or without words stay; an empty table gives an empty one."""
    at = free_name(docs, "__gone")
    gone = near_duplicates(docs, size, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias(at)).distinct()
    return docs.join(gone, docs[id_col] == F.col(at), "left_anti")

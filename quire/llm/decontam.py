"""Benchmark decontamination: passages within a bounded edit distance of a benchmark item.

Words are compared; case (A-Z) and ASCII punctuation at a word's ends don't count. The CGK embedding walks over a word
sequence: step j emits the word it stands on and moves on if bit j of that word's random bits is set. Two sequences
a few edits apart soon walk in step again, so their embeddings are close in Hamming distance, and a few sampled
positions of the embeddings agree with fair probability. Several walks and samples give the wanted recall; every
candidate is then settled by the exact edit distance between the item and the text around the window.

Items are grouped by length, and documents are read in windows of about the items' length at a stride of a quarter of
it. The items' own windows are indexed at every offset, so a copy at any place of a document meets the grid in step.
Windows that several items have in common are indexed once; a text's window is compared with each of them once, and only
then with their items. Items too short for an edit within the bound are found by their words' exact sequence.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, text_of

#: Edits allowed, as a share of the item's words; items of fewer words than WALKED have to be there word for word.
EDITS, WALKED = 0.2, 5
#: Recall wanted for passages with as many edits as allowed; a size class takes as many samples as its trial needs.
RECALL, TRIALS = 0.93, 300
#: Independent walks, positions of each that samples are drawn from, most samples of each walk, and positions in a sample.
WALKS, POOL, SAMPLES, BITS = 2, 16, 24, 4
#: Candidates that are held at a time while they are gathered.
GATHERED = 1 << 20
#: Items are indexed and broadcast in blocks of so many words (an index takes about 400 bytes a word).
BLOCK_WORDS = 100_000
KNOWN_WORDS = 150_000
BATCH_WORDS = 40_000
PUNCTUATION = string.punctuation.encode()
END = np.uint64(0)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.strip(PUNCTUATION)) or 1
        return h


_words = _Words()


def forget_words() -> None:
    """Free the table at the end of a task; workers live on and go to other work."""
    _words.clear()


def fingerprints(text: str) -> np.ndarray:
    """64-bit fingerprints of the words; 0 stands for the end of a text."""
    words = text.encode("utf-8").lower().split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58_476D_1CE4_E5B9)
    return x ^ (x >> np.uint64(29))


@cache
def samples_for(low: int) -> int:
    """Samples of each walk by which trial passages of ``low`` random words, with as many random edits as allowed, are found
    with the wanted recall, at every place of the grid alike; the trial is the same every time."""
    r = np.random.default_rng(low + 1)
    c = SizeClass(low, SAMPLES)
    pad = np.zeros(c.steps + 1, np.uint64)
    first = []
    for _ in range(TRIALS):
        item = r.integers(1, 1 << 63, low, dtype=np.uint64)
        copy = item.tolist()
        for _ in range(int(EDITS * low)):
            k = r.integers(len(copy))
            copy[k : k + r.integers(2)] = r.integers(1, 1 << 63, r.integers(2), dtype=np.uint64).tolist()
        own = {(s, int(x)) for s, key in enumerate(c.keys(np.concatenate([item, pad]), np.arange(low - c.window + 1))) for x in key}
        text = np.concatenate([r.integers(1, 1 << 63, r.integers(c.stride), dtype=np.uint64), np.array(copy, np.uint64), r.integers(1, 1 << 63, low, dtype=np.uint64)])
        places = np.arange(0, len(text) - c.window + 1, c.stride)
        keys = enumerate(c.keys(np.concatenate([text, pad]), places))
        first.append(min((s % SAMPLES for s, key in keys if any((s, int(x)) in own for x in key)), default=SAMPLES))
    for n in range(2, SAMPLES):
        if sum(x < n for x in first) >= RECALL * TRIALS:
            return n
    return SAMPLES


class SizeClass:
    """Walk and sample plan for items of ``low`` words up to half as many again."""

    def __init__(self, low: int, samples: int):
        self.low, self.stride = low, max(1, low // 4)
        self.window = low - self.stride + 1
        self.steps = 2 * self.window
        r = np.random.default_rng(low)
        self.pools = [np.sort(r.choice(self.steps, min(POOL, self.steps), replace=False)) for _ in range(WALKS)]
        bits = BITS if low >= 2 * WALKED else BITS - 1
        self.samples = [[r.choice(len(pool), min(bits, len(pool)), replace=False) for _ in range(SAMPLES)][:samples] for pool in self.pools]
        self.factors = r.integers(1 << 62, size=(WALKS, POOL), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, words: np.ndarray, starts: np.ndarray, drawn: dict[tuple[int, int], np.ndarray] | None = None) -> Iterator[np.ndarray]:
        """For each sample the key of each start. ``words`` must go on with at least ``steps`` ends. ``drawn`` keeps the words'
        random bits for other size classes, which walk by the same ones."""
        drawn = {} if drawn is None else drawn
        for walk, pool in enumerate(self.pools):
            at, taken = starts.astype(np.int32), []
            for j in range(int(pool[-1]) + 1):
                if j % 64 == 0:
                    if (walk, j) not in drawn:
                        random = _mix(words * np.uint64(2 * (walk * 1009 + j) + 0x9E37_79B9_7F4A_7C15))
                        random[words == END] = 0
                        drawn[walk, j] = random.view(np.uint8).reshape(-1, 8).T.copy()
                    bits = drawn[walk, j]
                if len(taken) < len(pool) and pool[len(taken)] == j:
                    taken.append(words[at] * self.factors[walk, len(taken)])
                at += (bits[j % 64 // 8][at] >> np.uint8(j % 8)) & np.uint8(1)
            for s, places in enumerate(self.samples[walk]):
                key = np.full(len(at), walk * SAMPLES + s + 1, np.uint64)
                for k in places:
                    key += taken[k]
                yield (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8_FEB8_6659_FD93)


def size_classes() -> Iterator[int]:
    low = WALKED
    while True:
        yield low
        low = low + low // 2


def _mixed(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A fingerprint of the ``n`` words from each start on."""
    out = np.full(len(starts), n, np.uint64)
    for k in range(n):
        out = _mix((out ^ words[starts + k]) * np.uint64(0x9E37_79B9_7F4A_7C15))
    return out


class Index:
    """Keys of all distinct windows of a block of items, by size class, and the places of each window; whole short items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if len(w := fingerprints(t))]
        self.groups = []
        short: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) < WALKED:
                short.setdefault(len(w), []).append(k)
        self.short = []
        for n, own in sorted(short.items()):
            marks = np.array([_mixed(self.items[k][1], np.zeros(1, np.int64), n)[0] for k in own])
            order = np.argsort(marks, kind="stable")
            self.short.append((n, marks[order], np.array(own)[order]))
        left, lows = sorted((k for k, (_, w) in enumerate(self.items) if len(w) >= WALKED), key=lambda k: len(self.items[k][1])), size_classes()
        low = next(lows)
        while left:
            high = next(lows)
            own = [k for k in left if len(self.items[k][1]) < high]
            left = left[len(own) :]
            if own:
                c = SizeClass(low, samples_for(low))
                self.groups.append((c, *self._table(c, own)))
            low = high

    def _table(self, c: SizeClass, own: list[int]) -> tuple[np.ndarray, ...]:
        """(keys, window of each key, first posting of each window, items, offsets): a window is known by the fingerprint of
        all words that a walk can see, up to the item's end."""
        pad = np.zeros(c.steps + 1, np.uint64)
        words = np.concatenate([x for k in own for x in (self.items[k][1], pad)])
        size = np.array([len(self.items[k][1]) for k in own])
        begin = np.cumsum(size + len(pad)) - size - len(pad)
        count = size - c.window + 1
        item = np.repeat(np.array(own, np.int32), count)
        offset = (np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        starts = np.repeat(begin, count) + offset
        mark = _mixed(words, starts, c.steps)
        order = np.argsort(mark, kind="stable")
        mark, item, offset, starts = mark[order], item[order], offset[order], starts[order]
        first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
        keys = list(c.keys(words, starts[first]))
        window = np.tile(np.arange(len(first), dtype=np.int32), len(keys))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        return keys[order], window[order], np.append(first, len(item)), item, offset


def _spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges a..b, and which range each is of."""
    n = b - a
    of = np.repeat(np.arange(len(a)), n)
    return a[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


class Finder:
    """Finds the items of an index in texts."""

    def __init__(self, index: Index):
        self.index, self.items = index, index.items
        self.size = np.array([len(w) for _, w in self.items], np.int64)
        self.groups = []
        for c, keys, *rest in index.groups:
            bits = max(16, int(np.ceil(np.log2(len(keys) + 1))) + 5)
            there = np.zeros(1 << bits, bool)
            there[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.groups.append((c, keys, *rest, there, np.uint64(64 - bits)))
        self.longest = max((g[0].steps for g in self.groups), default=0)
        self.patterns: dict[int, dict[int, int]] = {}

    def candidates(self, texts: list[np.ndarray]) -> np.ndarray:
        """Rows (text, item, word at which a copy would begin), sorted, once each."""
        pad = np.zeros(self.longest + 1, np.uint64)
        words = np.concatenate([x for t in texts for x in (t, pad)]) if texts else pad
        begins = np.cumsum([0, *(len(t) + len(pad) for t in texts)])[:-1]
        found, drawn = [np.empty((0, 3), np.int64)], {}
        for c, keys, window, first, item, offset, there, shift in self.groups:
            counts = np.array([max(1, -(-(len(t) - c.window + 1) // c.stride)) if len(t) else 0 for t in texts], np.int64)
            text = np.repeat(np.arange(len(texts)), counts)
            place = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * c.stride
            pairs = [np.empty((0, 2), np.int64)]
            for key in c.keys(words, begins[text] + place, drawn):
                hit = np.flatnonzero(there[(key >> shift).astype(np.int64)])
                low = np.searchsorted(keys, key[hit], "left")
                same = keys[np.minimum(low, len(keys) - 1)] == key[hit]
                hit, low = hit[same], low[same]
                if len(hit):
                    at, of = _spread(low, np.searchsorted(keys, key[hit], "right"))
                    pairs.append(np.stack([hit[of], window[at]], 1))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            if not len(pairs):
                continue
            ends = np.cumsum(first[pairs[:, 1] + 1] - first[pairs[:, 1]])
            low = 0
            while low < len(pairs):  # so many postings at a time, at least one window's
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + GATHERED, "right")))
                at, of = _spread(first[pairs[low:high, 1]], first[pairs[low:high, 1] + 1])
                hit = pairs[low:high, 0][of]
                found.append(np.unique(np.stack([text[hit], item[at], place[hit] - offset[at]], 1), axis=0))
                low = high
        return np.unique(np.concatenate(found), axis=0)

    def exact(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, 0, word after the copy) of the first copy of each short item in each text."""
        for n, marks, own in self.index.short:
            for t, words in enumerate(texts):
                if len(words) < n:
                    continue
                m = _mixed(words, np.arange(len(words) - n + 1), n)
                there = np.flatnonzero(np.isin(m, marks))
                told = set()
                for p in there.tolist():
                    a, b = np.searchsorted(marks, m[p], "left"), np.searchsorted(marks, m[p], "right")
                    for k in own[a:b].tolist():
                        if k not in told and (words[p : p + n] == self.items[k][1]).all():
                            told.add(k)
                            yield t, k, 0, p + n

    def distance(self, k: int, words: np.ndarray, first: int, last: int) -> tuple[int, int] | None:
        """Least edit distance between item ``k`` and any part of the words around places ``first`` to ``last`` at which a copy
        would begin, with the part's end; None if it is over the bound. Bit-parallel dynamic programming over the item's words."""
        pattern = self.items[k][1]
        n, most = len(pattern), int(EDITS * len(pattern))
        slack = 2 * most + 2
        a = max(0, first - slack)
        region = words[a : last + n + slack].tolist()
        if k not in self.patterns:
            if len(self.patterns) > 5000:
                self.patterns.clear()
            masks: dict[int, int] = {}
            for i, w in enumerate(pattern.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            self.patterns[k] = masks
        masks = self.patterns[k]
        if sum(w in masks for w in region) < n - most:
            return None
        full, top = (1 << n) - 1, 1 << (n - 1)
        up, down, score, best = full, 0, n, (n + 1, 0)
        for j, w in enumerate(region):
            eq = masks.get(w, 0)
            x = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | (~(x | up) & full), up & x
            score += 1 if plus & top else -1 if minus & top else 0
            plus = plus << 1 & full
            up, down = (minus << 1 & full) | (~((eq | down) | plus) & full), plus & (eq | down)
            if score < best[0]:
                best = (score, a + j + 1)
        return best if best[0] <= most else None

    def find(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edit distance, word after the copy), the best place for each text and item. Places of an item that are
        near each other are one stretch of text, which is gone through once."""
        yield from self.exact(texts)
        rows = self.candidates(texts)
        if not len(rows):
            return
        reach = self.size[rows[:, 1]] + 4 * (EDITS * self.size[rows[:, 1]]).astype(np.int64) + 4
        fresh = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (rows[1:, 2] - rows[:-1, 2] > reach[1:])])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(rows)) - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for (t, k, low), high in zip(rows[head].tolist(), rows[tail, 2].tolist(), strict=True):
            d = self.distance(k, texts[t], low, high)
            if d and ((t, k) not in best or d < best[t, k]):
                best[t, k] = d
        for (t, k), (d, end) in best.items():
            yield t, k, d, end


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, edit_distance, item_words, end_word): one row for each input row and benchmark item of which the
    row's text holds a passage within ``EDITS`` of the item's words in edit distance; the best such passage ends before
    word number end_word. Clean rows give none.

    Null and empty texts hold nothing; null items and items without words match nothing; items of fewer than 5 words have to be
    there word for word. Rows that repeat an
    id or a text are judged each; items that repeat an id likewise. Of places at the same distance the first counts. Other
    columns are ignored, whatever their names; an empty table or benchmark gives none. Whole texts are read. The items are broadcast in
    blocks of bounded size, and a benchmark of several blocks takes a pass over the documents for each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    schema = f"id {id_type}, item_id long, edit_distance int, item_words int, end_word int"

    def over(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finder = Finder(shared.value)
            for batch in batches:
                ids, texts, out, at = batch["id"].tolist(), batch["text"].tolist(), [], 0
                while at < len(texts):
                    own, n, start = [], 0, at
                    while at < len(texts) and n < BATCH_WORDS:
                        own.append(fingerprints(texts[at]))
                        n += len(own[-1])
                        at += 1
                    for t, k, d, end in finder.find(own):
                        item, w = finder.items[k]
                        out.append((ids[start + t], item, d, len(w), end))
                yield pd.DataFrame(out, columns=["id", "item_id", "edit_distance", "item_words", "end_word"])
            forget_words()

        return rows.mapInPandas(run, schema)

    found = None
    for block in _blocks(benchmark.select(F.col(item_col).cast("long").alias("i"), text_of(item_text).alias("t")).where("i is not null")):
        part = over(Index(block))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumnRenamed("id", id_col)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, n = [], 0
    for r in items.toLocalIterator():
        block.append((r.i, r.t))
        n += r.t.count(" ") + 1
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    if block:
        yield block


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark, with their own columns, whatever their names. Rows that
    repeat an id of which one holds a passage all go; null and empty texts stay; an empty table gives an empty one."""
    at = free_name(docs, "__bad")
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias(at)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(at)), "left_anti")

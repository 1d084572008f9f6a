"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A text is a row of words. Each word enters the network as a word vector plus the mean of the vectors of its character
trigrams (both found by hashing), so words that were never met still resemble those that share their characters. The
network reads windows of 24 words, each beginning 16 words after the one before; a document scores as its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import small_runs
from quire.llm.common import fold_bucket, text_of

WINDOW, STEP = 24, 16
WORD_BUCKETS, CHAR_BUCKETS, DIM, HIDDEN = 1 << 13, 1 << 12, 8, 8
#: The bounded sample: so many labelled documents of each class, in hash order, of at most so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 9000
UPDATES, BATCH, RATE = 320, 40, 0.02
KNOWN_WORDS = 120_000
RUN_CHARS = 1 << 19


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def words_of(text: str) -> list[str]:
    return text.lower().split()


def trigrams(word: str) -> list[int]:
    """Buckets of the word's character trigrams, with marks at both ends; a very long word is read as a whole."""
    b = f"<{word}>".encode()
    return [xxhash.xxh32_intdigest(b[i : i + 3]) % CHAR_BUCKETS for i in range(max(1, len(b) - 2))]


def windows_of(n: int) -> list[tuple[int, int]]:
    """Bounds of the windows of a text of n words: every word is in one at least; no words make one empty window."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - WINDOW + STEP), STEP)]


@dataclass
class Network:
    """Parameters by name: E (words), C (trigrams), for each direction W, U, b; then attention A, v and output o, c."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        p = {"E": f(WORD_BUCKETS, DIM, s=0.1), "C": f(CHAR_BUCKETS, DIM, s=0.3)}
        for d in "fb":
            p |= {f"W{d}": f(2 * DIM, 3 * HIDDEN, s=0.3), f"U{d}": f(HIDDEN, 3 * HIDDEN, s=0.3), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"A": f(2 * HIDDEN, HIDDEN, s=0.3), "v": f(HIDDEN, s=0.3), "o": f(2 * HIDDEN, s=0.3), "c": np.full(1, -2, np.float32)}
        return Network(p)

    def inputs(self, words: list[str]) -> np.ndarray:
        """Vectors of words: word vector, then mean of trigram vectors."""
        grams = [trigrams(w) for w in words]
        flat = np.fromiter((g for own in grams for g in own), np.int64)
        sizes = np.array([len(g) for g in grams])
        ids = np.array([xxhash.xxh32_intdigest(w) % WORD_BUCKETS for w in words], np.int64)
        means = np.add.reduceat(self.p["C"][flat], np.cumsum(sizes) - sizes) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.p["E"][ids], means], 1)

    def run(self, xs: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows. xs: (time, window, 6 * HIDDEN) projected inputs, forward then backward; lengths: words in
        each window. With ``keep``, also what the gradient needs."""
        steps, n, _ = xs.shape
        live = (np.arange(steps)[:, None] < lengths[None, :])[..., None]
        states, tape = np.zeros((steps, n, 2 * HIDDEN), np.float32), {}
        for d, part, order in (("f", slice(0, 3 * HIDDEN), range(steps)), ("b", slice(3 * HIDDEN, 6 * HIDDEN), range(steps - 1, -1, -1))):
            h, out = np.zeros((n, HIDDEN), np.float32), slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            u, own = self.p[f"U{d}"], []
            for t in order:
                x = xs[t, :, part]
                hu = h @ u
                zr = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                g = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = np.where(live[t], z * h + (1 - z) * g, h)
                if keep:
                    own.append((t, h, z, r, g, hu[:, 2 * HIDDEN :]))
                h = new
                states[t, :, out] = h
            tape[d] = own
        a = np.tanh(states @ self.p["A"])
        e = np.where(live[..., 0], a @ self.p["v"], -1e9)
        w = np.exp(e - e.max(0))
        w *= live[..., 0]
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = (w[..., None] * states).sum(0)
        logits = pooled @ self.p["o"] + self.p["c"]
        return (logits, (live, states, tape, a, w, pooled)) if keep else logits

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors @ self.p["Wf"] + self.p["bf"], vectors @ self.p["Wb"] + self.p["bb"]], 1)

    def gradient(self, xs: np.ndarray, lengths: np.ndarray, kept: tuple, d_logits: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the projected inputs, and of those inputs."""
        live, states, tape, a, w, pooled = kept
        p, g = self.p, {}
        g["c"], g["o"] = d_logits.sum(keepdims=True), pooled.T @ d_logits
        d_pooled = d_logits[:, None] * p["o"]
        d_states = w[..., None] * d_pooled
        d_w = (states * d_pooled).sum(-1)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["v"] = np.einsum("tnh,tn->h", a, d_e)
        d_a = d_e[..., None] * p["v"] * (1 - a * a)
        g["A"] = np.einsum("tni,tnh->ih", states, d_a)
        d_states = d_states + d_a @ p["A"].T
        d_xs = np.zeros_like(xs)
        for d, part, out in (("f", slice(0, 3 * HIDDEN), slice(0, HIDDEN)), ("b", slice(3 * HIDDEN, 6 * HIDDEN), slice(HIDDEN, 2 * HIDDEN))):
            u, d_h, d_u = p[f"U{d}"], np.zeros((xs.shape[1], HIDDEN), np.float32), np.zeros_like(p[f"U{d}"])
            for t, h, z, r, c, hc in reversed(tape[d]):
                d_h = d_h + d_states[t, :, out]
                own = np.where(live[t], d_h, 0)
                d_c = own * (1 - z) * (1 - c * c)
                d_z = own * (h - c) * z * (1 - z)
                d_r = d_c * hc * r * (1 - r)
                d_xs[t, :, part] = np.concatenate([d_z, d_r, d_c], 1)
                d_hu = np.concatenate([d_z, d_r, d_c * r], 1)
                d_u += h.T @ d_hu
                d_h = np.where(live[t], own * z, d_h) + d_hu @ u.T
            g[f"U{d}"] = d_u
        return g, d_xs


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows that go to the same place."""
    out, order = np.zeros((n, rows.shape[1]), np.float32), np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    out[places] = np.add.reduceat(rows[order], first)
    return out


def train(texts: list[str], labels: list[int], seed: int = 0) -> Network:
    """Fit a network: a document's logit is the log of the sum of its windows' odds, so the windows that carry the label
    get the gradient. Adam on all parameters; classes weigh alike."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    cut = [words_of(t) for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in cut for w in c))}
    if not vocabulary or len(set(labels)) < 2:
        net.p["c"][:] = 0 if not labels else (4 if labels[0] else -4)
        net.p["o"][:] = 0
        return net
    words = list(vocabulary)
    grams = [trigrams(w) for w in words]
    word_ids = np.array([xxhash.xxh32_intdigest(w) % WORD_BUCKETS for w in words])
    rows = [np.array([vocabulary[w] for w in c], np.int64) for c in cut]
    y = np.array(labels, np.float32)
    weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step = 0
    while step < UPDATES:
        for part in np.array_split(r.permutation(len(rows)), max(1, -(-len(rows) // BATCH))):
            bounds = [(k, a, b) for k, i in enumerate(part) for a, b in windows_of(len(rows[i]))]
            used, local = np.unique(np.concatenate([rows[i] for i in part]), return_inverse=True)
            step += 1
            if not len(used):
                continue
            starts = np.cumsum([0, *(len(rows[i]) for i in part)])
            doc, lengths = np.array([k for k, _, _ in bounds]), np.array([b - a for _, a, b in bounds])
            index = np.zeros((WINDOW, len(bounds)), np.int64)
            for j, (k, a, b) in enumerate(bounds):
                index[: b - a, j] = local[starts[k] + a : starts[k] + b]
            own = [grams[i] for i in used]
            flat, sizes = np.concatenate(own), np.array([len(x) for x in own])
            vectors = np.concatenate([net.p["E"][word_ids[used]], np.add.reduceat(net.p["C"][flat], np.cumsum(sizes) - sizes) / sizes[:, None].astype(np.float32)], 1)
            xs = net.project(vectors)[index]
            logits, kept = net.run(xs, lengths, True)
            top = np.full(len(part), -1e9)
            np.maximum.at(top, doc, logits)
            odds = np.exp(logits - top[doc])
            total = np.bincount(doc, odds, len(part))
            z = top + np.log(total)
            d_doc = (sigmoid(z) - y[part]) * weight[part] / len(part)
            g, d_xs = net.gradient(xs, lengths, kept, (d_doc[doc] * odds / total[doc]).astype(np.float32))
            live = np.arange(WINDOW)[:, None] < lengths[None, :]
            d_proj = _sums(index[live], d_xs[live], len(used))
            d_vectors = np.zeros_like(vectors)
            for d, sl in (("f", slice(0, 3 * HIDDEN)), ("b", slice(3 * HIDDEN, 6 * HIDDEN))):
                g[f"W{d}"], g[f"b{d}"] = vectors.T @ d_proj[:, sl], d_proj[:, sl].sum(0)
                d_vectors += d_proj[:, sl] @ net.p[f"W{d}"].T
            g["E"] = _sums(word_ids[used], d_vectors[:, :DIM], WORD_BUCKETS)
            g["C"] = _sums(flat, np.repeat(d_vectors[:, DIM:] / sizes[:, None].astype(np.float32), sizes, axis=0), CHAR_BUCKETS)
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                net.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Scores texts, keeping the projected inputs of words met before in a table of bounded size."""

    def __init__(self, net: Network):
        self.net, self.known, self.table, self.used = net, {}, np.zeros((1 << 14, 6 * HIDDEN), np.float32), 0

    def _ids(self, cut: list[list[str]]) -> list[np.ndarray]:
        new = list({w for c in cut for w in c if w not in self.known})
        if new:
            if self.used + len(new) > KNOWN_WORDS:
                self.known, self.used = {}, 0
                new = list({w for c in cut for w in c})
            if self.used + len(new) > len(self.table):
                bigger = np.zeros((max(2 * len(self.table), self.used + len(new)), self.table.shape[1]), np.float32)
                bigger[: self.used] = self.table[: self.used]
                self.table = bigger
            self.table[self.used : self.used + len(new)] = self.net.project(self.net.inputs(new))
            self.known.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
        get = self.known.__getitem__
        return [np.fromiter(map(get, c), np.int64, len(c)) for c in cut]

    def scores(self, texts: list[str]) -> np.ndarray:
        """The worst window's probability for each text."""
        rows = self._ids([words_of(t) for t in texts])
        counts = np.array([len(windows_of(len(r))) for r in rows])
        flat = np.concatenate([*rows, np.zeros(WINDOW, np.int64)])
        starts = np.cumsum([0, *(len(r) for r in rows[:-1])]) if len(rows) else np.zeros(0, int)
        n = np.array([len(r) for r in rows])
        doc = np.repeat(np.arange(len(rows)), counts)
        offset = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
        lengths = np.minimum(WINDOW, n[doc] - offset)
        first = starts[doc] + offset
        logits = np.empty(len(doc), np.float32)
        for a in range(0, len(doc), 2048):
            b = slice(a, a + 2048)
            at = np.minimum(first[b][None, :] + np.arange(WINDOW)[:, None], len(flat) - 1)
            logits[b] = self.net.run(self.table[flat[at]], lengths[b])
        worst = np.maximum.reduceat(logits, np.cumsum(counts) - counts) if len(rows) else logits
        return sigmoid(worst.astype(np.float64))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int, id_col: str, text_col: str) -> list:
    """At most ``per_class`` (text, label) of each class among the rows to learn from, in hash order of the id."""
    rows = docs.where(fold_bucket(id_col, 5) != 0).select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    rows = rows.where(F.length("__text").between(1, chars))
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")).where("__y in (0, 1)")
    both = rows.select("__id").distinct().join(known.distinct(), "__id")
    ids = [both.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for y in (0, 1)]
    chosen = docs.sparkSession.createDataFrame([tuple(r) for x in ids for r in x.select("__id", "__y").collect()], both.select("__id", "__y").schema)
    out = [(r[0], r[1]) for r in rows.join(F.broadcast(chosen), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text")).orderBy(F.xxhash64("__id"), "__y").select("__text", "__y").collect()]
    return out


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row, rows with a repeated or null id too: id, held_out, score, predicted; none for an empty table.
    Other columns are ignored, whatever their names. Ties in the sample's hash order go by the id.

    The network learns from a bounded sample of labelled rows outside the held-out fifth (crc32 of the id as text
    modulo 5; a null id counts as the empty text). Every whole text is scored; null, empty and blank texts score as one
    empty window. Labels other than 0 and 1 and ids without a document are ignored; a document with several labels is
    learnt as each. With labels of one class only, every score is near that class; without any it is 0.5.
    """
    sample = labelled_sample(docs, labels, label, SAMPLE_DOCS, SAMPLE_CHARS, id_col, text_col)
    net = train([t for t, _ in sample], [y for _, y in sample])
    return score_with(net, docs, id_col, text_col, threshold)


def score_with(net: Network, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Scores of all rows by a trained network; its parameters are broadcast (their size is fixed: about 0.5 MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Network(shared.value))
        for batch in batches:
            texts, at = batch.pop("__text").tolist(), 0
            score = np.empty(len(texts))
            while at < len(texts):
                stop, n = at, 0
                while stop < len(texts) and n < RUN_CHARS:
                    n += len(texts[stop])
                    stop += 1
                score[at:stop] = scorer.scores(texts[at:stop])
                at = stop
            yield batch.assign(score=score)

    rows = docs.select(F.col(id_col).alias("__id"), fold_bucket(id_col, 5).eqNullSafe(F.lit(0)).alias("held_out"), text_of(text_col).alias("__text"))
    scored = rows.mapInPandas(run, f"__id {dict(rows.dtypes)['__id']}, held_out boolean, score double")
    return scored.select(F.col("__id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with their own columns. Scored row by row, so nothing
    is shuffled; other columns pass through untouched, whatever their names. Null and empty texts are scored as one empty
    window; repeated rows stay or go together; an empty table gives an empty one. Without labels of both classes there is
    nothing to tell documents apart by, and all stay."""
    sample = labelled_sample(docs, labels, label, SAMPLE_DOCS, SAMPLE_CHARS, id_col, text_col)
    if len({y for _, y in sample}) < 2:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(train([t for t, _ in sample], [y for _, y in sample]).p)
    names, types = docs.columns, docs.dtypes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(shared.value))
        for batch in batches:
            texts = [x or "" for x in batch.column(names.index(text_col)).to_pylist()]
            for part in small_runs(texts, RUN_CHARS):
                clean = scorer.scores(texts[part]) < threshold
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(clean))

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in types))

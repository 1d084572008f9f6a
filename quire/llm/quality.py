"""Quality scores: similarity-weighted votes of labelled neighbours in a latent-semantic space."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold_bucket, text_of
from quire.llm.toxicity import labelled_sample

#: Terms are hashed into so many buckets; so many dimensions are kept.
TERMS, DIM = 1 << 14, 48
#: The bounded sample: so many labelled documents of each class, in hash order, of at most so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 20_000
NEIGHBOURS, BLOCK = 25, 256
#: The table of words met before: so many words of at most so many characters each; longer ones are cut up anew.
KNOWN_WORDS, KNOWN_CHARS = 200_000, 64
#: Longer shapes count as overlapping pieces of so many characters, each half a piece after the one before.
PIECE = 12
LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[int]:
    """Buckets of a word's terms: all its letter runs, its whole shape (letters and digits run together, marks as they
    are) and its length class. Shapes let marks and layout count, whatever the words are."""
    low = word.lower()
    shape = re.sub(r"\d+", "0", LETTERS.sub(lambda m: "A" if m[0].isupper() else "a", word))
    half = PIECE // 2
    names = [f"w {m}" for m in LETTERS.findall(low)]
    names += [f"s {shape[k : k + PIECE]}" for k in range(0, max(1, len(shape) - half), half)]
    names.append(f"n {min(12, len(word))}")
    return [xxhash.xxh32_intdigest(x) % TERMS for x in names]


class Space:
    """Term weights and the projection of weighted term counts into the latent space."""

    def __init__(self, weight: np.ndarray, axes: np.ndarray):
        self.weight, self.axes, self.known = weight, axes, {}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Term buckets of a text and how often they occur; a run of equal words or lines also counts as terms."""
        words, known = text.split(), self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        flat: list[int] = []
        for w in words:
            own = known.get(w)
            if own is None:
                own = terms_of(w)
                if len(w) <= KNOWN_CHARS:
                    known[w] = own
            flat += own
        at, n = np.unique(np.array(flat, np.int64), return_counts=True)
        lines = [x for x in text.split("\n") if x]
        more = [
            f"repeated {int(8 * (1 - len(set(words)) / max(1, len(words))))}",
            f"lines {int(8 * (1 - len(set(lines)) / max(1, len(lines))))}",
            f"per line {min(9, len(words) // max(1, len(lines)) // 4)}",
        ]
        extra = np.array([xxhash.xxh32_intdigest(x) % TERMS for x in more])
        return np.concatenate([at, extra]), np.concatenate([n, np.full(len(extra), max(1, len(words) // 8))])

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of texts (zero for texts without a known term)."""
        out = np.zeros((len(texts), self.axes.shape[1]), np.float32)
        for i, t in enumerate(texts):
            at, n = self.counts(t)
            x = np.log1p(n).astype(np.float32) * self.weight[at]
            out[i] = x @ self.axes[at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def fit_space(texts: list[str]) -> Space:
    """Inverse document frequencies and the leading right singular vectors of the sample's term matrix, by subspace
    iteration on sparse rows."""
    space = Space(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32))
    rows = [space.counts(t) for t in texts]
    seen = np.bincount(np.concatenate([at for at, _ in rows]) if rows else np.zeros(0, int), minlength=TERMS)
    weight = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    values = []
    for at, n in rows:
        x = np.log1p(n).astype(np.float32) * weight[at]
        values.append(x / max(1e-12, float(np.linalg.norm(x))))
    axes = np.linalg.qr(np.random.default_rng(0).standard_normal((TERMS, DIM)))[0].astype(np.float32)
    for _ in range(6):
        new = np.zeros_like(axes)
        for (at, _), x in zip(rows, values, strict=True):
            np.add.at(new, at, x[:, None] * (x @ axes[at])[None, :])
        axes = np.linalg.qr(new)[0].astype(np.float32)
    return Space(weight, axes)


def votes(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, prior: float) -> np.ndarray:
    """Weighted share of label 1 among the nearest labelled vectors: exact cosine products, a block at a time. The vote
    of the prior has a small weight, so a text that resembles nothing gets it."""
    out = np.empty(len(vectors))
    k = min(NEIGHBOURS, len(known))
    for a in range(0, len(vectors), BLOCK):
        cos = vectors[a : a + BLOCK] @ known.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k else np.zeros((len(cos), 0), int)
        w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 4
        out[a : a + BLOCK] = ((w * labels[near]).sum(1) + 1e-3 * prior) / (w.sum(1) + 1e-3)
    return out


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row, rows with a repeated or null id too: id, held_out, score, predicted; none for an empty table.
    Other columns are ignored, whatever their names; ties among neighbours' similarities may go either way.

    The space and the labelled vectors come from a bounded sample of labelled rows outside the held-out fifth (crc32 of
    the id as text modulo 5; a null id counts as the empty text). Every whole text is scored against all labelled
    vectors. Null, empty and blank texts get the vote of the texts nearest to an empty one; without any labelled row
    every score is 0.5. Other labels than 0 and 1 are ignored.
    """
    sample = labelled_sample(docs, labels, label, SAMPLE_DOCS, SAMPLE_CHARS, id_col, text_col)
    texts, y = [t for t, _ in sample], np.array([v for _, v in sample], np.float64)
    space = fit_space(texts)
    shared = docs.sparkSession.sparkContext.broadcast((space.weight, space.axes, space.vectors(texts) if texts else np.zeros((0, DIM), np.float32), y))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, axes, known, own = shared.value
        s = Space(weight, axes)
        for batch in batches:
            text = batch.pop("__text").tolist()
            yield batch.assign(score=votes(s.vectors(text), known, own, 0.5))

    rows = docs.select(F.col(id_col).alias("__id"), fold_bucket(id_col, 5).eqNullSafe(F.lit(0)).alias("held_out"), text_of(text_col).alias("__text"))
    scored = rows.mapInPandas(run, f"__id {dict(rows.dtypes)['__id']}, held_out boolean, score double")
    return scored.select(F.col("__id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Language identification with string kernels: blended-spectrum presence kernels, Nyström landmarks, and
one-versus-rest kernel ridge regression, scored by batched matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import fold_bucket

#: Orders of the n-grams that are blended.
ORDERS = (1, 2, 3)
LANDMARKS, RIDGE = 64, 1e-3
#: The bounded sample: so many documents in all, dealt equally to the languages, of at most so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 1200, 4000
SLOT_BITS = 18
BATCH_CHARS = 1 << 19
LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> list[np.ndarray]:
    """For each order, a 64-bit code of the n-gram at each place of the text (lower-cased, between spaces)."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return [sum(c[k : len(c) - n + 1 + k] << np.uint64(21 * k) for k in range(n)) for n in ORDERS]


def slots(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E37_79B9_7F4A_7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Kernel:
    """The n-grams of the landmarks, found through a table of slots, and which landmark has which.

    k(x, l) is the mean over the orders of |common n-grams| / sqrt(|n-grams of x| |n-grams of l|). An n-gram is known
    by its slot; n-grams that no landmark has count in |n-grams of x| only.
    """

    def __init__(self, landmarks: list[str]):
        self.column, self.presence = [], []
        for k in range(len(ORDERS)):
            own = [np.unique(slots(grams(t)[k])) for t in landmarks]
            every = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
            column = np.full(1 << SLOT_BITS, len(every), np.int32)
            column[every] = np.arange(len(every))
            table = np.zeros((len(every) + 1, len(landmarks)), np.float32)
            for j, at in enumerate(own):
                table[column[at], j] = 1 / np.sqrt(max(1, len(at)))
            self.column.append(column)
            self.presence.append(table)

    def rows(self, texts: list[str]) -> np.ndarray:
        """k(x, l) of all texts x and landmarks l: a product of the texts' and the landmarks' presence matrices."""
        out = np.zeros((len(texts), self.presence[0].shape[1]), np.float32)
        cut = [grams(t) for t in texts]
        for k in range(len(ORDERS)):
            column, table = self.column[k], self.presence[k]
            have = np.zeros((len(texts), len(table)), np.float32)
            for i, own in enumerate(cut):
                at = np.unique(slots(own[k])) if len(own[k]) < 20_000 else np.flatnonzero(np.bincount(slots(own[k]), minlength=1 << SLOT_BITS))
                have[i, column[at]] = 1 / np.sqrt(max(1, len(at)))
            have[:, -1] = 0
            out += have @ table
        return out / len(ORDERS)


class Model:
    def __init__(self, kernel: Kernel, weights: np.ndarray, offset: np.ndarray, languages: list[str]):
        self.kernel, self.weights, self.offset, self.languages = kernel, weights, offset, languages

    def values(self, texts: list[str]) -> np.ndarray:
        """A value for each text and language: about 1 for the right one and 0 for others."""
        return self.kernel.rows(texts) @ self.weights + self.offset


def fit(texts: list[str], langs: list[str]) -> Model:
    """Kernel ridge regression on Nyström features, one language against the rest, classes weighing alike."""
    languages = sorted(set(langs))
    by = {x: [t for t, y in zip(texts, langs, strict=True) if y == x] for x in languages}
    landmarks = [by[x][k] for k in range(max(map(len, by.values()), default=0)) for x in languages if k < len(by[x])][:LANDMARKS]
    kernel = Kernel(landmarks)
    k_mm = kernel.rows(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    x = kernel.rows(texts).astype(np.float64) @ root
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    y = np.array([[float(a == b) for b in languages] for a in langs])
    w = np.array([len(langs) / (len(languages) * len(by[a])) for a in langs])[:, None]
    beta = np.linalg.solve(x.T @ (w * x) + RIDGE * len(x) * np.eye(x.shape[1]), x.T @ (w * y))
    return Model(kernel, (root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32), languages)


def identify(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and a score in 0..1; `und` and 0 for texts without a letter."""
    told = [bool(t) and LETTER.search(t) is not None for t in texts]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    which = [i for i, x in enumerate(told) if x]
    start = 0
    while start < len(which) and model.languages:
        stop, n = start, 0
        while stop < len(which) and n < BATCH_CHARS and stop - start < 256:
            n += len(texts[which[stop]])
            stop += 1
        own = which[start:stop]
        v = model.values([texts[i] for i in own])
        p = np.exp(8 * (v - v.max(1, keepdims=True)).astype(np.float64))
        p /= p.sum(1, keepdims=True)
        for i, row, best in zip(own, p, v.argmax(1), strict=True):
            lang[i], score[i] = model.languages[best], float(row[best])
        start = stop
    return lang, score


def _sample(rows: DataFrame) -> DataFrame:
    """Of rows(__id, __text, __lang) an equal share of SAMPLE_DOCS for each language, 20 at least, in hash order of the id.
    Texts over SAMPLE_CHARS characters count only where a language has no others, the shortest first. Before any are
    sorted, a hash leaves about twice as many of each language as are wanted and 200 more, so no language is sorted whole,
    whatever its size."""
    long = F.greatest(F.length("__text"), F.lit(SAMPLE_CHARS))
    per = rows.groupBy("__lang").agg(F.count(F.lit(1)).alias("all"), F.count_if(long == SAMPLE_CHARS).alias("short"))
    per = per.withColumn("of", F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("all")))
    wanted = max(20, SAMPLE_DOCS // max(1, per.count()))
    share = F.pmod(F.xxhash64("__id", "__text"), F.lit(1 << 30)) < F.lit((2.0 * wanted + 200) * (1 << 30)) / F.col("of")
    near = rows.join(F.broadcast(per), "__lang").where(((long == SAMPLE_CHARS) | (F.col("short") == 0)) & share)
    place = F.row_number().over(Window.partitionBy("__lang").orderBy(long, F.xxhash64("__id"), "__id", "__text"))
    return near.withColumn("k", place).where(F.col("k") <= wanted).select("__id", "__text", "__lang")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row, repeated ids too: id, held_out, lang_pred, score; none for an empty table. Other columns are
    ignored, whatever their names.

    The model learns from a bounded sample of the documents with a language and a text whose crc32 of the id as text
    modulo 3 is not 1 (a null id counts as the empty text); every whole text is then scored. Null texts, empty ones and
    those without a letter are `und` with score 0, and so is every text where there is nothing to learn from.
    """
    rows = docs.select(F.col(id_col).alias("__id"), fold_bucket(id_col, 3).eqNullSafe(F.lit(1)).alias("held_out"), F.col(text_col).cast("string").alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    picked = _sample(rows.where("not held_out and __lang is not null").where(F.col("__text").rlike(r"\p{L}")))
    sample = [(r[0], r[1]) for r in picked.orderBy(F.xxhash64("__id"), "__id", "__lang", "__text").select("__text", "__lang").collect()]
    model = fit([t for t, _ in sample], [x for _, x in sample]) if sample else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch.pop("__text")]
            lang, score = identify(shared.value, texts) if shared.value else (["und"] * len(texts), [0.0] * len(texts))
            yield batch.assign(lang_pred=lang, score=score)

    scored = rows.drop("__lang").select("__id", "held_out", "__text").mapInPandas(run, f"__id {dict(rows.dtypes)['__id']}, held_out boolean, lang_pred string, score double")
    return scored.withColumnRenamed("__id", id_col)

"""Repeated passages: suffix groups and whole tables against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import repeats

SCHEMA = "doc_id long, text string, digest string, kept string, n int, key int, __digest string"


def brute(docs, length):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, "z") for i, t in docs], SCHEMA)


def run(spark, docs, length):
    out = repeats.repeats(frame(spark, docs).repartition(3), length)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def test_equal_suffixes_against_a_dictionary():
    r = np.random.default_rng(2)
    for length in (16, 21, 40):
        data = r.integers(0, 2, 3000).astype(np.uint8)
        data[1000:1300] = data[200:500]
        data = np.concatenate([data, np.zeros(length + 8, np.uint8)])
        place = np.arange(3000)
        group, weight = place % 3 * 0, np.ones(3000, np.int64)
        weight[7] = 2
        seen = Counter(data[k : k + length].tobytes() for k in place)
        want = [seen[data[k : k + length].tobytes()] > 1 or k == 7 for k in place]
        assert repeats.equal_suffixes(data, place, group, weight, length).tolist() == want


def test_equal_windows_have_equal_anchors():
    a, r = repeats.Anchors(60), random.Random(1)
    common = bytes(r.randrange(256) for _ in range(90))
    places = []
    for n in (0, 17, 200):
        text = bytes(r.randrange(256) for _ in range(n)) + common + bytes(r.randrange(256) for _ in range(40))
        key, first, last, at = a.find(text)
        owned = {p: (int(k), int(x) - n) for k, f, z, x in zip(key, first, last, at, strict=True) for p in range(f, z + 1)}
        assert sorted(owned) == list(range(len(text) - 59))
        places.append([owned[n + k] for k in range(31)])
    assert places[0] == places[1] == places[2]


def odd(r):
    passage = "".join(r.choice("abcdefgh é漢") for _ in range(150))
    return [(1, None), (2, ""), (3, "short"), (3, "short"), (4, passage), (5, passage), (5, passage), (6, f"x{passage}y"), (None, passage[:-1] + "!"), (None, passage + passage), (7, "ab" * 300), (8, "z" * 500), (9, passage[20:70]), (10, "w " * 3_000)]


@pytest.mark.parametrize("length", [16, 45])
def test_odd_rows(spark, length):
    docs = odd(random.Random(length))
    assert run(spark, docs, length) == brute(docs, length)
    assert run(spark, [], length) == []


def mixed(seed, n, parts=12):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdef ") for _ in range(r.randint(30, 120))) for _ in range(parts)]
    return [(i, "".join(r.choice(known) if r.random() < 0.4 else "".join(r.choice("abcdef ") for _ in range(r.randint(5, 80))) for _ in range(r.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("hot", [repeats.HOT, 40, 2])
def test_random_texts_and_frequent_anchors(spark, hot):
    docs = mixed(7, 150)
    cut = {bytes(r.digest): r for r in repeats.repeated_spans(frame(spark, docs), 48, hot=hot).collect()}
    want = {}
    for i, t in docs:
        want[repeats.digest_of(t.encode())] = t.encode()
    rows = {r[0]: r for r in brute(docs, 48)}
    removed = 0
    for i, t in docs:
        r = cut.get(repeats.digest_of(t.encode()))
        n, spans, kept = (0, 0, t.encode()) if r is None else (sum(b - a for a, b in zip(r.first, r.last, strict=True)), len(r.first), bytes(r.kept))
        assert (n, spans, hashlib.sha256(kept).hexdigest()) == rows[i][2:]
        removed += n
    assert removed > 10_000


def test_drop_repeats_keeps_columns(spark):
    docs = [(1, "head " + "q" * 10 + "abcdefghijklmnopqrstuvwxyz"), (2, "tail abcdefghijklmnopqrstuvwxyz é"), (3, None)]
    out = repeats.drop_repeats(frame(spark, docs), 20)
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "head " + "q" * 10, 2: "tail  é", 3: None}


def test_texts_longer_than_a_stretch(spark):
    r = random.Random(9)
    body = "".join(r.choice("abcdefghijklmnop") for _ in range(repeats.STRETCH + 5_000))
    docs = [(1, body), (2, "x" + body[repeats.STRETCH - 300 : repeats.STRETCH + 700] + "y"), (3, body[:100])]
    got = {r[0]: r[1:4] for r in run(spark, docs, 400)}
    assert got == {1: (len(body), 1000, 1), 2: (1002, 1000, 1), 3: (100, 0, 0)}

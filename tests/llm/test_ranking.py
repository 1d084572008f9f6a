"""Ranked search: small tables with every odd case, against a direct count."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from quire.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, id string, rank int, score long, item_id long, number int"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, top):
    split = [(i, Counter(TERM.findall(fold(t)))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    own = defaultdict(set)
    for i, t in items:
        own[i] |= set(TERM.findall(fold(t)))
    out = []
    for item, terms in own.items():
        found = []
        for i, c in split:
            n, score = sum(c.values()), 0
            for t in terms & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * (100 - 50 + (50 * n * n_docs) // length)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in docs], SCHEMA)
    b = spark.createDataFrame([(i, t, 5, "y") for i, t in items], "item_id long, text string, doc_id long, term string")
    out = ranking.ranked(d.repartition(5), b, **more)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


def test_odd_rows(spark):
    docs = [(1, "Red fox, RED hen"), (2, None), (3, ""), (4, "...!? \x00\x7f"), (5, "été Été ÉTÉ fox"), (5, "fox"), (None, "fox"), (None, "red fox"), (6, "a1b2-c3 漢字 漢字。"), (7, "word " * 60_000 + "fox"), (8, "fox"), (9, "fox")]
    items = [(1, "the fox; the red fox"), (2, None), (3, ""), (4, "ÉTÉ 漢字"), (None, "hen"), (None, "C3"), (5, "nothing matches this"), (1, "hen")]
    for top in (50, 2):
        assert run(spark, docs, items, top=top) == brute(docs, items, top)


def test_many_ties_and_random_texts(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 12)))) for i in range(400)] + [(1000 + i, "a b c") for i in range(300)]
    r.shuffle(docs)
    items = [(k, " ".join(r.choice("abcdefghij") for _ in range(4))) for k in range(12)]
    assert run(spark, docs, items, top=50) == brute(docs, items, 50)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, "-")], [(1, "a")]) == []


def test_tiles_of_few_terms_give_the_same(monkeypatch):
    r = np.random.default_rng(3)
    weights = r.integers(0, 40_000, (300, 7)).astype(float)
    tile = []
    for _ in range(40):
        own = np.sort(r.choice(300, r.integers(0, 200), replace=False))
        tile.append((int(r.integers(1, 500)), own, r.integers(1, 30, len(own))))
    wide = ranking.tile_scores(tile, weights, 1000, 90_000)
    monkeypatch.setattr(ranking, "TILE_TERMS", 13)
    assert (ranking.tile_scores(tile, weights, 1000, 90_000) == wide).all()
    for k, (n, own, tf) in enumerate(tile):
        m = 50 + 50 * n * 1000 // 90_000
        want = sum(weights[t].astype(int) * (1_000_000_000 * int(f) // (1000 * int(f) + 20 * m)) for t, f in zip(own, tf, strict=True))
        assert (wide[k] == want).all()


def test_blocks_of_few_weights_give_the_same(spark, monkeypatch):
    docs = [(i, f"a b{i % 3} c{i % 5} d") for i in range(30)]
    items = [(k, f"b{k % 3} c{k % 4} d{k}") for k in range(9)]
    monkeypatch.setattr(ranking, "BLOCK_WEIGHTS", 12)
    assert run(spark, docs, items) == brute(docs, items, 50)

"""Exact and near dedup, decontamination: small tables with every odd case, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from quire.llm import decontam, exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, kept string, id string, n int, key int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA)


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


ODD = [(1, "Same Text"), (5, "same text"), (5, "same text"), (2, None), (3, ""), (4, "ÉCOLE"), (6, "école"), (None, "same TEXT"), (7, "x" * 200_000), (8, "X" * 200_000), (None, "alone")]


def test_exact_dedup_odd_rows(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(table(spark, ODD)).collect())
    want = []
    for i, t in ODD:
        same = [j for j, u in ODD if fold(u) == fold(t)]
        best = max((j for j in same if j is not None), default=None)
        want.append((i is None, i or 0, best or 0, len(same), i == best, hashlib.sha256(fold(t).encode()).hexdigest()))
    assert got == sorted(want)


def test_exact_dedup_keeps_columns_and_takes_empty_tables(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    left = exact_dedup.drop_exact_copies(table(spark, [(1, "a"), (2, "A"), (3, "b")]))
    assert left.columns == ["doc_id", "text", "kept", "id", "n", "key"]
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.exact_dedup(table(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(rows, size):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def copies(seed, n, groups=4):
    r = random.Random(seed)
    voc = [f"w{k}" for k in range(400)]
    base = [[r.choice(voc) for _ in range(60)] for _ in range(groups)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(voc)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_against_brute_force(spark, size):
    rows = copies(size, 90) + [(100, None), (101, ""), (102, " \n"), (103, "one two"), (104, "ONE  two"), (105, "one"), (106, "a b c d"), (107, "A B C D")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, rows), size).collect()}
    assert got == brute(rows, size)


def test_near_duplicates_null_ids_repeats_and_empty(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(table(spark, rows)).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    left = near_dedup.drop_near_copies(table(spark, rows))
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 1]


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    x = r.integers(1 << 62, size=3000, dtype=np.uint64)
    a, b = x[:2000], x[1000:]
    ra, rb = near_dedup.registers([np.unique(a), np.unique(b)])
    assert (near_dedup.registers([np.unique(x)])[0] == np.maximum(ra, rb)).all()
    gap = near_dedup.log_likelihood_gap(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))
    assert gap[0] > near_dedup.SLACK  # similarity 1/3 is told from 0.8
    close = near_dedup.registers([np.unique(x[:2700]), np.unique(x[100:2800])])
    assert near_dedup.log_likelihood_gap(close[:1], close[1:], np.array([2700.0]), np.array([2700.0]))[0] <= near_dedup.SLACK


def edit(a, b):
    """Least edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_finds_planted_passages(spark):
    r = random.Random(3)
    voc = [f"v{k}" for k in range(500)]
    items = [(k, " ".join(r.choice(voc) for _ in range(r.randrange(8, 60)))) for k in range(30)]
    docs, planted = [], set()
    for d in range(120):
        words = [r.choice(voc) for _ in range(r.randrange(0, 300))]
        if d % 3 == 0:
            k, t = r.choice(items)
            own = t.split()
            for _ in range(int(0.1 * len(own))):
                own[r.randrange(len(own))] = "edited"
            at = r.randrange(len(words) + 1)
            words[at:at] = [own[0].upper() + ","] + own[1:]
            planted.add((d, k))
        docs.append((d, " ".join(words)))
    docs += [(500, None), (501, ""), (None, items[0][1])]
    bench = spark.createDataFrame([*items, (90, "too short an item"), (91, None), (None, "v1 v2 v3 v4 v5 v6")], "item_id long, text string")
    got = decontam.contaminated(table(spark, docs), bench).collect()
    pairs = {(x.doc_id, x.item_id) for x in got}
    assert (None, 0) in pairs
    found = pairs - {(None, 0)}
    assert len(found & planted) >= 0.95 * len(planted)
    text = dict(docs)
    strip = lambda t: [w.strip(".,").lower() for w in t.split()]
    for x in got:
        item = strip(dict(items)[x.item_id])
        d = edit(item, strip(text[x.doc_id]))
        assert d <= x.edit_distance <= int(0.2 * len(item))
    left = decontam.drop_contaminated(table(spark, docs), bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in pairs}
    assert decontam.contaminated(table(spark, []), bench).count() == 0
    assert decontam.contaminated(table(spark, docs), bench.limit(0)).count() == 0


def test_near_duplicates_around_one_passage(spark):
    """Texts that share most of a passage and parts of their ends: many lie just below the limit, some just above it."""
    r = random.Random(11)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    core = words(60)
    heads, tails = [words(n) for n in (4, 9, 10, 12, 14)], [words(n) for n in (3, 8, 10, 11, 15)]
    rows = [(k * 7 + j, " ".join([*h, *core, *t])) for k, h in enumerate(heads) for j, t in enumerate(tails)]
    rows += [(500 + k, " ".join([*h[:-2], "x", *core[: 58 - k], *t])) for k, (h, t) in enumerate(zip(heads, tails, strict=True))]
    rows += [(3, " ".join(core)), (3, " ".join(core[:50])), (900, " ".join(words(5) + core))]
    once = {i: t for i, t in rows if i != 3}
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(table(spark, list(once.items())), 4).collect()}
    assert got == {i: c for i, (_, c, _) in brute(list(once.items()), 4).items()}
    assert len(set(got.values())) > 1
    assert near_dedup.near_duplicates(table(spark, rows), 4).count() == len(rows)


@pytest.mark.parametrize("percent", [2, 5, 10, 15, 20])
def test_decontamination_recall_by_edits(percent):
    r = random.Random(percent)
    voc = [f"v{k}" for k in range(3000)]
    items = [(k, [r.choice(voc) for _ in range(r.randrange(20, 60))]) for k in range(60)]
    finder = decontam.Finder(decontam.Index([(k, " ".join(w)) for k, w in items]))
    found = wanted = 0
    for _ in range(6):
        texts, planted = [], []
        for k, own in items:
            copy = [[w] for w in own]
            for at in r.sample(range(len(copy)), int(percent / 100 * len(copy))):
                copy[at] = r.choice([[], ["edited"], ["edited"], [*copy[at], "more"]])
            words = [r.choice(voc) for _ in range(r.randrange(0, 200))]
            at = r.randrange(len(words) + 1)
            words[at:at] = [w for part in copy for w in part]
            part = words[max(0, at - 30) : at + len(own) + 30]
            if edit(own, part) <= decontam.EDITS * len(own):
                planted.append((len(texts), k))
            texts.append(" ".join(words))
        got = {(t, k) for t, k, _, _ in finder.find([decontam.fingerprints(t) for t in texts])}
        found, wanted = found + len(got & set(planted)), wanted + len(planted)
    assert wanted > 300 and found >= 0.9 * wanted


def least_distance(item, words):
    """Least edit distance between an item and any part of a text, by the whole table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in words:
        new = [0]
        for k, x in enumerate(item):
            new.append(min(row[k] + (x != w), row[k + 1] + 1, new[k] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_hits_and_misses_with_stock_phrases_and_short_items():
    r = random.Random(21)
    voc = [f"v{k}" for k in range(300)]
    words = lambda n: [r.choice(voc) for _ in range(n)]
    stock = words(12)
    items = [(k, words(r.randrange(1, 6))) for k in range(30)]
    items += [(100 + k, words(r.randrange(0, 15)) + stock + words(r.randrange(0, 15))) for k in range(60)]
    items += [(200 + k, words(r.randrange(6, 40))) for k in range(60)]
    finder = decontam.Finder(decontam.Index([(k, " ".join(w)) for k, w in items]))
    texts = []
    for _ in range(60):
        text = words(r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            own = list(r.choice(items)[1])
            for _ in range(r.randrange(int(0.3 * len(own)) + 1)):
                at = r.randrange(len(own))
                own[at : at + r.randrange(2)] = r.choice([[], ["edited"]])
                own = own or ["edited"]
            at = r.randrange(len(text) + 1)
            text[at:at] = r.choice([own, stock, own + stock])
        texts.append(text)
    texts += [[], stock * 10]
    want = {}
    for t, text in enumerate(texts):
        for n, (_, own) in enumerate(items):
            if (d := least_distance(own, text)) <= int(0.2 * len(own)):
                want[t, n] = d
    got = {(t, n): d for t, n, d, _ in finder.find([decontam.fingerprints(" ".join(x)) for x in texts])}
    assert set(got) <= set(want) and all(d >= want[k] for k, d in got.items())
    assert {k for k, d in want.items() if not d} <= set(got)
    assert len(want) > 150 and len(got) >= 0.9 * len(want)


def test_many_items_with_one_phrase_take_linear_work():
    r = random.Random(5)
    voc = [f"v{k}" for k in range(5000)]
    words = lambda n: [r.choice(voc) for _ in range(n)]
    stock = words(20)
    items = [(k, " ".join(words(15) + stock + words(15))) for k in range(2000)]
    text = " ".join(sum(([*words(80), *stock] for _ in range(15)), []))
    finder = decontam.Finder(decontam.Index(items))
    rows = finder.candidates([decontam.fingerprints(text)])
    assert len(rows) <= 2000 * 15 * 8
    assert list(finder.find([decontam.fingerprints(text)])) == []
    assert [k for _, k, _, _ in finder.find([decontam.fingerprints(f"{text} {items[77][1]}")])] == [77]


def test_decontamination_takes_clashing_names_and_long_texts(spark):
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "x " * 60_000 + item + " y" * 60_000), (1, "clean"), (2, None), (3, "clean")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, edit_distance int, end_word int, __bad int")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.edit_distance, r.end_word) for r in got] == [(1, 7, 0, 60_030)]
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert decontam.contaminated(docs.limit(0), bench).count() == decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_near_duplicates_of_long_texts(spark):
    r = random.Random(3)
    long = [f"u{k}" for k in range(120_000)]
    edited = list(long)
    for k in r.sample(range(len(long)), 3000):
        edited[k] = "edited"
    rows = [(1, " ".join(long)), (2, " ".join(edited)), (3, " ".join(long[:90_000])), (4, "a " * 100_000), (5, "a " * 100_001)]
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(table(spark, rows), 4).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}

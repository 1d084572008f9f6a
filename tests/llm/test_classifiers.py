"""The three classifiers: gradients, windows, odd rows and held-out accuracy."""

import os
import zlib

import numpy as np
import pytest

from quire.llm import language, quality, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_windows_overlap_and_cover():
    for n in (0, 1, 23, 24, 25, 40, 41, 100):
        w = toxicity.windows_of(n)
        assert set().union(*(range(a, b) for a, b in w)) == set(range(n))
        assert all(b - a <= toxicity.WINDOW for a, b in w)


def test_gradient_is_the_slope():
    net = toxicity.Network.fresh(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    xs, lengths = r.standard_normal((5, 3, 6 * toxicity.HIDDEN)), np.array([5, 3, 1])
    logits, kept = net.run(xs, lengths, True)
    g, d_xs = net.gradient(xs, lengths, kept, np.ones(3))
    for name in ("Uf", "Ub", "A", "v", "o"):
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = net.run(xs, lengths).sum()
        net.p[name][at] = old - 1e-3
        down = net.run(xs, lengths).sum()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3 * max(1, abs(g[name][at]))
    xs2 = xs.copy()
    xs2[2, 0, 3] += 1e-3
    assert abs((net.run(xs2, lengths).sum() - logits.sum()) / 1e-3 - d_xs[2, 0, 3]) < 1e-2


def test_batching_does_not_change_scores():
    s = toxicity.Scorer(toxicity.Network.fresh(0))
    texts = ["", "one", "word " * 100, "another longer text " * 40]
    assert np.allclose(s.scores(texts), [s.scores([t])[0] for t in texts], atol=1e-6)


def tables(spark, n=240):
    good = "the quiet river runs past the old mill every day and nobody minds it at all"
    rows = [(k, (good + f" w{k} " + ("you stupid scum go away" if k % 4 == 0 else "see you soon")) if k % 10 else good, "en", 1) for k in range(n)]
    rows += [(n, None, "en", 1), (n + 1, "", "en", 1), (n + 2, "x " * 50_000, None, 1), (None, good, "en", 1), (3, "repeated id", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 4 == 0 and k % 10 != 0)) for k in range(n)] + [(None, 1, 1), (5, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def held(i, m, k):
    return zlib.crc32((str(i) if i is not None else "").encode()) % m == k


def test_toxicity_table(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 120)
    docs, labels = tables(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id, 5, 0) for r in got)
    own = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240 and r.doc_id % 10]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in own]) > 0.9
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs.limit(5), labels.limit(0)).count() == 5


def test_quality_table(spark):
    docs, labels = tables(spark)
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id, 5, 0) for r in got)
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.quality(docs.limit(5), labels.limit(0)).collect()} == {0.5}


def test_votes_are_exact():
    r = np.random.default_rng(0)
    known, x = r.standard_normal((300, 8)).astype(np.float32), r.standard_normal((40, 8)).astype(np.float32)
    y = r.integers(0, 2, 300).astype(float)
    got = quality.votes(x, known, y, 0.5)
    for i in range(40):
        cos = known @ x[i]
        near = np.argsort(-cos)[: quality.NEIGHBOURS]
        w = np.maximum(cos[near], 0).astype(float) ** 4
        assert abs(got[i] - ((w * y[near]).sum() + 5e-4) / (w.sum() + 1e-3)) < 1e-5


def test_kernel_is_the_string_kernel():
    texts, marks = ["banana", "an", "zzz"], ["ananas", "ban"]
    k = language.Kernel(marks).rows(texts)
    for i, x in enumerate(texts):
        for j, y in enumerate(marks):
            want = 0
            for n in language.ORDERS:
                a, b = ({f" {t} "[q : q + n] for q in range(len(t) + 3 - n)} for t in (x, y))
                want += len(a & b) / np.sqrt(len(a) * len(b)) / len(language.ORDERS)
            assert abs(k[i, j] - want) < 1e-5


def test_language_table(spark):
    rows = [(k, t, l, "s") for k, (t, l) in enumerate([("the cat sat on the mat with that hat", "en"), ("der hund und die katze mit dem ball", "de")] * 60)]
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, "123 !!", "en", "s"), (503, "the cat and the hat", None, "s"), (None, "der ball und die katze", "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "en" and got[None].lang_pred == "de"
    assert all(r.held_out == held(i, 3, 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert language.languages(docs.limit(0)).count() == 0


@needs_data
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    q = quality.quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in q]) > 0.9
    x = language.languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in x]) > 0.95


def test_quality_terms_cover_the_whole_word():
    word = "-".join(f"p{chr(97 + k % 26)}{k}" for k in range(40))
    for end in ("tail", "!?", "9"):
        assert set(quality.terms_of(f"{word}-{end}")) != set(quality.terms_of(word))
    for n in range(40):
        shape = "".join(".:;,"[k * k % 4] for k in range(n))
        want = {f"s {shape[k : k + 12]}" for k in range(0, max(1, n - 6), 6)} | {f"n {min(12, n)}"}
        assert set(quality.terms_of(shape)) == {quality.xxhash.xxh32_intdigest(x) % quality.TERMS for x in want}
        assert n == 0 or max(range(0, max(1, n - 6), 6)) + 12 >= n


def test_quality_reads_behind_the_eighth_run():
    head = "see,this,page,and,look,at,all,of,"
    texts = [head + ("quiet,river,mill" if k % 2 else "cheap,pills,buy") + f",k{k}" for k in range(40)]
    space = quality.fit_space(texts)
    v = space.vectors([head + "river,mill,quiet", head + "buy,cheap,pills"])
    got = quality.votes(v, space.vectors(texts), np.array([k % 2 for k in range(40)], float), 0.5)
    assert got[0] > 0.9 and got[1] < 0.1
    assert not any(len(w) > quality.KNOWN_CHARS for w in space.known)


def slow_score(net, text):
    """A document's score, one window, word and unit at a time."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    words, n = toxicity.words_of(text), toxicity.HIDDEN
    best = -1e9
    for a, b in toxicity.windows_of(len(words)):
        own = [np.concatenate([p["E"][toxicity.xxhash.xxh32_intdigest(w) % toxicity.WORD_BUCKETS], np.mean([p["C"][g] for g in toxicity.trigrams(w)], 0)]) for w in words[a:b]]
        states = []
        for d, order in (("f", range(len(own))), ("b", reversed(range(len(own))))):
            h, out = np.zeros(n), {}
            for t in order:
                x, u = own[t] @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
                z, r = sig(x[:n] + u[:n]), sig(x[n : 2 * n] + u[n : 2 * n])
                h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
                out[t] = h
            states.append(out)
        both = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(own))]
        e = np.array([np.tanh(s @ p["A"]) @ p["v"] for s in both])
        w = np.exp(e - e.max()) if len(e) else e
        pooled = sum((k * s for k, s in zip(w / w.sum(), both, strict=True)), np.zeros(2 * n)) if len(e) else np.zeros(2 * n)
        best = max(best, float(pooled @ p["o"] + p["c"][0]))
    return sig(best)


def test_scores_against_a_slow_network():
    texts = ["", "one", "you stupid scum", " ".join(f"word{k % 13} and" for k in range(60)), "x" * 5000, "ünïcode wörds 字"]
    net = toxicity.train([t + s for t in texts for s in (" bad", " good")], [1, 0] * len(texts), seed=3)
    assert np.allclose(toxicity.Scorer(net).scores(texts), [slow_score(net, t) for t in texts], atol=1e-4)


def test_toxic_documents_go_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 120)
    docs, labels = tables(spark)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    toxic = {k for k in range(240) if k % 4 == 0 and k % 10}
    assert len(toxic & set(ids)) <= 0.1 * len(toxic) and len(set(range(240)) - toxic - set(ids)) <= 6
    assert {240, 241, 242} <= set(ids)
    for none in (labels.limit(0), labels.where("toxic = 1")):
        assert toxicity.drop_toxic(docs, none).count() == docs.count()
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_quality_against_a_dense_reference(spark):
    docs, labels = tables(spark)
    sample = quality.labelled_sample(docs, labels, "quality", quality.SAMPLE_DOCS, quality.SAMPLE_CHARS, "doc_id", "text")
    space = quality.fit_space([t for t, _ in sample])
    axes = space.axes.astype(float)
    assert np.allclose(axes.T @ axes, np.eye(quality.DIM), atol=1e-3)

    def dense(text):
        x = np.zeros(quality.TERMS)
        for at, n in zip(*quality.Space(space.weight, space.axes).counts(text), strict=True):
            x += np.log1p(n) * space.weight[at] * (np.arange(quality.TERMS) == at)
        v = x @ axes
        return v / max(1e-12, np.linalg.norm(v))

    some = [t for t, _ in sample[::40]]
    assert np.allclose(space.vectors(some), [dense(t) for t in some], atol=2e-3)
    got = {r.doc_id: r.score for r in quality.quality(docs, labels).where("doc_id < 12").collect()}
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 12").collect()}
    known, y = space.vectors([t for t, _ in sample]).astype(float), np.array([v for _, v in sample], float)
    for i, t in texts.items():
        if i != 3:
            cos = np.sort(known @ dense(t))[::-1]
            if cos[quality.NEIGHBOURS - 1] - cos[quality.NEIGHBOURS] > 1e-4:  # no tie at the last neighbour
                near = np.argsort(-(known @ dense(t)))[: quality.NEIGHBOURS]
                w = np.maximum((known @ dense(t))[near], 0) ** 4
                assert abs(got[i] - ((w * y[near]).sum() + 5e-4) / (w.sum() + 1e-3)) < 5e-3


def test_languages_by_direct_regression():
    texts = ["the cat sat on the mat", "a dog and the cat", "der hund und die katze", "das ist der ball", "le chat et le chien", "la balle et le chat"] * 4
    langs = ["en", "en", "de", "de", "fr", "fr"] * 4
    model = language.fit(texts, langs)
    marks = [t for k in range(8) for t in (texts[2 + 6 * (k // 2) + k % 2], texts[6 * (k // 2) + k % 2], texts[4 + 6 * (k // 2) + k % 2])][: language.LANDMARKS]
    kernel = lambda a, b: np.mean([len(set(language.slots(x)) & set(language.slots(y))) / np.sqrt(len(set(language.slots(x))) * len(set(language.slots(y)))) for x, y in zip(language.grams(a), language.grams(b), strict=True)])
    mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh((mm + mm.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    feature = lambda t: np.append(np.array([kernel(t, m) for m in marks]) @ root, 1.0)
    x = np.array([feature(t) for t in texts])
    new = ["the dog", "die katze ist", "le balle", "zzz"]
    for j, lang in enumerate(model.languages):
        y = np.array([float(v == lang) for v in langs])
        # ridge as least squares with rows for the penalty
        stack, target = np.vstack([x, np.sqrt(language.RIDGE * len(x)) * np.eye(x.shape[1])]), np.append(y, np.zeros(x.shape[1]))
        beta = np.linalg.lstsq(stack, target, rcond=None)[0]
        assert np.allclose(model.values(new)[:, j], [feature(t) @ beta for t in new], atol=2e-2)


def test_letters_and_rare_languages(spark):
    rows = [(k, "the cat sat on the mat with that hat " * (1 + k % 2), "en") for k in range(300)] + [(1000 + k, "der hund und die katze mit dem ball " * 200, "de") for k in range(9)]
    rows += [(2000, "² ½ ① Ⅷ !!", "en"), (2001, "der hund und die katze", None), (3, "the cat sat on the mat", "en"), (3, "der ball und die katze", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.languages(docs.withColumn("score", docs.doc_id).withColumn("held_out", docs.lang)).collect()
    assert len(got) == len(rows)
    said = {(r.doc_id, r.lang_pred) for r in got}
    assert (2000, "und") in said and (2001, "de") in said and {(3, "en"), (3, "de")} <= said

"""The trigram index against plain containment."""

import random

from quire.operators import trigrams


def test_search_against_plain_containment(spark):
    r = random.Random(3)
    words = lambda n: "".join(r.choice("abn\\né 漢") for _ in range(n))
    rows = [("d", k, "eng", words(r.randrange(0, 60))) for k in range(150)] + [("d", 900, "eng", None), ("d", 901, "eng", "ab" * 60_000), ("e", 5, "ita", "AB\nÉN")]
    tokens = sorted({words(r.randrange(1, 7)).replace("\n", "x") for _ in range(60)} | {"ab", "é", "zzzz", "ABAB", "b  a", ""})
    segments = spark.createDataFrame(rows, "doc string, node long, lang string, text string")
    got = {(x.doc, x.node, x.line, x.term) for x in trigrams.search(trigrams.build(trigrams.postings(segments)), segments, spark.createDataFrame([(t,) for t in tokens], "term string")).collect()}
    want = set()
    for doc, node, _, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            for t in tokens:
                low = " ".join(t.lower().split(" ")) if "  " not in t else t.lower().replace("  ", " ")
                if t and line.strip(" ") and low in line.lower():
                    want.add((doc, node, k, t))
    assert got == want


def test_candidates_are_those_with_the_rarest_trigrams(spark):
    segments = spark.createDataFrame([("d", k, "eng", "common words here " + ("needle" if k == 7 else "")) for k in range(40)], "doc string, node long, lang string, text string")
    index = trigrams.build(trigrams.postings(segments))
    terms = spark.createDataFrame([("words needle",), ("absent needle",)], "term string")
    assert [(x.term, x.node) for x in trigrams.candidates(index, terms).collect()] == []
    terms = spark.createDataFrame([("e needle",), ("absent needle",), ("common",)], "term string")
    assert sorted((x.term, x.node) for x in trigrams.candidates(index, terms).collect()) == [("common", k) for k in range(40)] + [("e needle", 7)]


def test_postings_are_lists_that_blocks_of_segments_share(spark):
    segments = spark.createDataFrame([("d", k, "eng", "same words in each segment") for k in range(300)] + [("d", 900, "eng", None), ("e", 1, None, "x\nyes, each")], "doc string, node long, lang string, text string").coalesce(1)
    index = trigrams.build(trigrams.postings(segments))
    own = {"same words in each segment"[i : i + 3] for i in range(24)}
    assert index.rows.count() == len(own | {"yes, each"[i : i + 3] for i in range(7)})
    assert max(x.segments for x in index.counts.collect()) == 301
    found = trigrams.search(index, segments, spark.createDataFrame([("Each",), ("EACH",), ("nothing",)], "term string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "contains(" not in plan.lower()
    assert sorted((x.node, x.term) for x in found.collect()) == sorted((k, t) for k in [1, *range(300)] for t in ("Each", "EACH"))

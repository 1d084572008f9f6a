"""The pipeline against a plain version of its exact stages."""

import base64
import hashlib
import os

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quire.llm import decontam, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    out = corpus_pipeline.run(spark, DATA)
    got = {r.doc_id: r for r in out.collect()}
    docs, labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    toxic = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    left = {r.doc_id: r.text or "" for r in docs.collect() if not toxic[r.doc_id]}
    last = {}
    for i, t in sorted(left.items()):
        last[t.encode().lower()] = i
    left = {i: left[i] for i in last.values()}
    sets = {}
    for i, t in left.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(left):
        for b in sorted(left):
            if a < b and sets[a] and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if find(i) == i}
    leaks = {r.doc_id for r in decontam.contaminated(docs.where(docs.doc_id.isin(list(left))), bench).collect()}
    assert leaks >= {i for i, t in left.items() if any(r.text in t for r in bench.collect())}
    assert set(got) == set(left) - leaks
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    assert all(list(r.ids) == enc.encode_ordinary(left[i]) for i, r in got.items())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, ids string, __sha string"


def put(spark, folder, rows, labels, items):
    spark.createDataFrame([(*r, "en", "s", 1, True, "i", "x") for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")


def test_pipeline_on_odd_rows(spark, tmp_path):
    item = "what is the name of the river that runs past the old mill in the north"
    plain = "a plain text about nothing much with just enough words to be of some use here " + " ".join(f"w{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, "Same text"), (4, "same TEXT"), (4, "same TEXT"), (5, f"{plain} end"), (6, f"{plain} stop"), (7, f"x y z {item} and more"), (None, "no id at all"), (8, "\n \t"), (9, "w " * 70_000)]
    put(spark, tmp_path, rows, [], [(1, item), (2, None), (None, "w1 w2 w3 w4 w5 w6")])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    want = [(2, ""), (4, "same TEXT"), (4, "same TEXT"), (5, f"{plain} end"), (None, "no id at all"), (8, "\n \t"), (9, "w " * 70_000)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in out.collect()) == sorted((i or 0, digest(t)) for i, t in want)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_pipeline_on_empty_tables(spark, tmp_path):
    put(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

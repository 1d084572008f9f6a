"""Tokenisation, token files, WARC archives and chat formatting: exact round trips and library results."""

import base64
import hashlib
import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe, chat, queries, template, token_store, warc
from quire.llm.common import fresh_dir, materialise

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
with open(RANKS, "rb") as f:
    LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
ENCODER = bpe.rank_encoder(RANKS, PATTERN)
ODD = ["", " ", "\n\n", "a" * 3000, "  two  spaces \n x", "it's 12345 ''s\xa0foo　 bar", "\x1c a \x85b", "日本語" * 60, "<|endoftext|> x", "a\r\nb", " " * 80 + "x" + " " * 80, "é" * 100]


@pytest.mark.parametrize("text", ODD)
def test_bpe_odd_texts(text):
    assert ENCODER.batch(pa.array([text])).to_pylist()[0] == LIBRARY.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_bpe_any_text(text):
    assert ENCODER.batch(pa.array([text])).to_pylist()[0] == LIBRARY.encode_ordinary(text)


def test_bpe_long_and_short_trees_agree():
    r = random.Random(0)
    ranks = bpe.Ranks(RANKS)
    pieces = [bytes(r.choice(b"aeinorst th") for _ in range(r.randrange(1, 63))) for _ in range(200)]
    ids, counts = bpe.encode_short(ranks, *_laid_out(pieces))
    ends = np.cumsum([0, *counts])
    for piece, a, b in zip(pieces, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == bpe.encode_long(ranks, piece)


def _laid_out(pieces):
    lengths = np.array(list(map(len, pieces)))
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths


def docs(spark):
    return spark.createDataFrame([(k * 3, t, "c") for k, t in enumerate(ODD)] + [(7, None, "c"), (7, "again", "c"), (None, "no id", "c")], "doc_id long, text string, ids string")


def test_bpe_table(spark):
    d = docs(spark)
    got = bpe.decode(bpe.encode(d, RANKS, PATTERN), RANKS).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in got) == sorted((r.doc_id or -1, (r.text or "").encode()) for r in d.collect())
    assert bpe.encode(d.limit(0), RANKS, PATTERN).count() == 0


def test_token_files(spark):
    library = Tokenizer.from_file(JSON)
    d = docs(spark)
    root = fresh_dir(spark, "t")
    files = materialise(token_store.write_tokens(d, root, JSON, PATTERN), "f")
    got = token_store.read_tokens(files).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in d.collect()))
    at = 0
    for (has, i, t), r in zip(rows, got, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if has else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store.token_round_trip(d.limit(0), JSON, PATTERN).count() == 0


def test_one_document_of_a_token_file(spark):
    root = fresh_dir(spark, "t")
    uri = token_store.write_tokens(spark.createDataFrame([(k, f"text number {k} " * 20) for k in range(200)], "doc_id long, text string").coalesce(1), root, JSON, PATTERN).first().uri
    from quire.llm.files import opened

    with opened(uri) as f:
        load = lambda digest: open(f"{root.removeprefix('file://')}/{digest.hex()}.dict", "rb").read()  # noqa: E731, SIM115
        file = token_store.TokenFile(f, {}, load)
        k = len(file.index) // 2
        want = Tokenizer.from_file(JSON).encode(f"text number {file.index['doc_id'][k]} " * 20).ids
        assert file.ids(k).tolist() == [*want, 0]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, payload_bytes int")


def test_warc_round_trip(spark):
    long = "é" * 800
    rows = [(1, "http://a/ b\r\nX: y", long), (9, None, long), (9, "u", long), (2, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "u", long), (None, "u", "z" * 2000)]
    got = warc.warc_round_trip(pages(spark, rows)).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and h == long and i != 9
        want.append((i or -1, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert sorted(map(str, want)) == sorted(str((-1 if r.page_id is None else r.page_id, *r[1:])) for r in got)
    assert warc.warc_round_trip(pages(spark, [])).count() == 0


def records(n=12):
    return [warc.build_record(k, f"http://x/{k}", b"<p>%d</p>" % k * (k * 40 + 1), hashlib.sha1(b"").hexdigest(), "response", None) for k in range(n)]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_after_damage(compressed):
    own = [warc.compress_member(r) if compressed else r for r in records()]
    data = bytearray(b"".join(own))
    starts = np.cumsum([0, *map(len, own)])
    data[starts[3] + len(own[3]) // 2] ^= 0xFF  # inside a member's data, or a record's block
    whole = bytes(data[: starts[7]]) + b"garbage" * 50 + bytes(data[starts[7] : -20])  # junk between, last one cut off
    out = list(warc.salvage(io.BytesIO(whole)))
    ids = [warc._page(x[3][0]["warc-record-id"]) for x in out if x[0] == "record"]
    assert ids == [k for k in range(11) if k != 3]
    gaps = [(x[1], x[2]) for x in out if x[0] == "gap"]
    assert gaps[0] == (starts[3], len(own[3])) and gaps[1] == (starts[7], 350) and gaps[2][0] == starts[11] + 350
    assert sum(x[2] for x in out) == len(whole)


@pytest.mark.parametrize("shift, end_id", [(0, 0), (0, 70_000), (30_000, 0)])
def test_token_files_hold_wide_ids(spark, tmp_path, shift, end_id):
    with open(JSON, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"] = {f"<unused {k}>": k for k in range(shift)} | {t: i + shift for t, i in spec["model"]["vocab"].items()}
    spec["added_tokens"] = [x | {"id": x["id"] + shift} for x in spec["added_tokens"]]
    path = str(tmp_path / "tokenizer.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts = ["some unusual words: zygote, quagmire, thunderstorm", "", "plain"]
    own = {k: [*Tokenizer.from_file(JSON).encode(t, add_special_tokens=False).ids] for k, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = materialise(token_store.write_tokens(docs, fresh_dir(spark, "tokens"), path, PATTERN, end_id), "token-files")
    want = {k: zlib.crc32(np.array([*(i + shift for i in x), end_id], "<u4").tobytes()) for k, x in own.items()}
    assert {r.doc_id: r.ids_crc32 for r in token_store.read_tokens(files).collect()} == want
    assert token_store.two_bytes(path, end_id) == (shift == end_id == 0)
    assert shift == 0 or max(map(max, filter(None, own.values()))) + shift >= 1 << 16


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("block", [1, 37, 1 << 20])
def test_salvage_of_headers_across_reads(monkeypatch, compressed, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    own = records(6) + [warc.build_record(6, "u" * (300 if block == 1 else 100_000), b"x", "", "response", None)] + records(2)
    data = b"".join(warc.compress_member(r) if compressed else r for r in own)
    out = list(warc.salvage(io.BytesIO(data)))
    assert [x[0] for x in out] == ["record"] * 9 and sum(x[2] for x in out) == len(data)
    assert block == 1 or out[6][3][0]["warc-target-uri"] == "u" * 100_000
    assert [x[0] for x in warc.salvage(io.BytesIO(own[0] + own[1][:50]))] == ["record", "gap"]


def test_warc_keeps_pages_with_long_urls(spark, tmp_path):
    rows = [(1, "data:" + "x" * 200_000, "page"), (2, "u", "other")]
    assert sorted(r.page_id for r in warc.warc_round_trip(pages(spark, rows)).collect()) == [1, 2]
    (tmp_path / "a.warc").write_bytes(records(1)[0] + b"garbage")
    list_ = spark.createDataFrame([(f"file://{tmp_path}/a.warc",)], "uri string")
    assert [r.kind for r in warc.read_archives(list_).collect()] == ["response", "gap"]
    with pytest.raises(Exception, match="7 bytes at .* can't be read"):
        warc.read_archives(list_, strict=True).collect()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_salvage_takes_anything(data):
    assert sum(x[2] for x in warc.salvage(io.BytesIO(data))) == len(data)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>[]/\\sINST ok\n", max_size=60))
def test_escape_is_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_template_language():
    t = template.compile_template("{% set a = 'x' + 'y' %}{% for m in ms %}{% if loop.first %}F{% elif m.k == 2 %}two{% else %}{{ m['k'] ~ '!' }}{% endif %}{% generation %}{{ m.t | upper }}{% endgeneration %}{% endfor %}{{ a }}{# c #}{{ 1 + 2 }}{{ none }}")
    assert t.render(ms=[{"k": 1, "t": "a"}, {"k": 2, "t": "b"}, {"k": 3, "t": "c"}]) == ("FAtwoB3!Cxy3", [(1, 2), (5, 6), (8, 9)])
    assert template.compile_template("a{{ 'b' | upper }}{{ 1 if true else 2 }}").tree == [template.Print(template.Const("aB1"))]
    for bad in ("{% for x in y %}", "{{ f(x) }}", "{{ x | nothing }}", "{% import os %}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)
    assert template.compile_template("{{ m.__class__ }}{{ s.upper }}").render(m={}, s="x") == ("", [])


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 200)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"</s>[INST] turn {t}\n") for t in range(60)]
    rows += [(2, 0, "user", None), (2, 1, None, "x"), (2, 1, None, "x"), (2, None, "assistant", ""), (None, 0, "assistant", "lost"), (3, 0, "assistant", "[/INST]<\\s> é")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv: r for r in chat.digest_conversations(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        x = got[None if c is None else str(c)]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_registered(spark):
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
    assert F is not None


def test_decode_gives_way_to_a_clash_and_takes_nulls(spark):
    df = spark.createDataFrame([(1, [1, 2], "old", 5), (2, None, "old", 6), (3, [], "old", 7), (3, [], "old", 7)], "doc_id long, ids array<int>, decoded string, id int")
    got = bpe.decode(df, RANKS)
    assert got.columns == ["doc_id", "ids", "id", "decoded"]
    want = {1: LIBRARY.decode_bytes([1, 2]), 2: None, 3: b""}
    assert sorted((r.doc_id, None if r.decoded is None else bytes(r.decoded)) for r in got.collect()) == sorted([(k, want[k]) for k in (1, 2, 3, 3)], key=str)
    assert bpe.decode(df.limit(0), RANKS).count() == 0
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>"), RANKS).collect()


def test_long_texts_and_repeated_rows_are_encoded(spark):
    r = random.Random(9)
    texts = ["".join(r.choice(["word ", "Ünï ", "\n", "x1. "]) for _ in range(120_000)), "a" * 20_000, " " * 30_000, "b c"]
    rows = [(k % 3, t) for k, t in enumerate(texts * 2)]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), RANKS, PATTERN).collect()
    assert [(x.doc_id, bytes(x.decoded).decode()) for x in got] == rows
    assert [x.ids for x in got] == [LIBRARY.encode_ordinary(t) for _, t in rows]


def test_added_tokens_as_the_library_has_them():
    library, own = Tokenizer.from_file(JSON), token_store.LibraryEncoder(JSON, PATTERN)
    texts = ["<|endoftext|>", "a <|endoftext|>  b<|endoftext|>", "plain", "<|endoftext|", "é 日本  x<|endoftext|>"]
    assert own.batch(pa.array(texts)).to_pylist() == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_any_text_as_the_library_has_it(text):
    assert OWN.batch(pa.array([text, "", text + " x"])).to_pylist() == [WHOLE.encode(t, add_special_tokens=False).ids for t in (text, "", text + " x")]


OWN, WHOLE = token_store.LibraryEncoder(JSON, PATTERN), Tokenizer.from_file(JSON)


def test_other_tokenizers_take_whole_texts(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some Words  here", "", "x\ny"]
    assert token_store.LibraryEncoder(path, PATTERN).batch(pa.array(texts)).to_pylist() == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_of_large_records_and_wrong_lengths(compressed):
    own = records(4)
    big = warc.build_record(50, "u", b"p" * (5 << 20), "", "response", None)
    at = own[1].index(b"\r\nContent-Length: ") + 18
    wrong = own[1][:at] + b"9999" + own[1][at:]
    data = b"".join(warc.compress_member(x) if compressed else x for x in (own[0], big, wrong, own[2], own[3]))
    out = list(warc.salvage(io.BytesIO(data)))
    assert [warc._page(x[3][0]["warc-record-id"]) for x in out if x[0] == "record"] == [0, 50, 2, 3]
    assert sum(x[2] for x in out) == len(data)


def test_long_conversation_parts(spark):
    long = "é" * (1 << 21)
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long), (1, 2, "assistant", "[INST]")], "conv_id long, turn long, role string, text string")
    x = chat.digest_conversations(chat.format_conversations(df)).first()
    assert (x.n_turns, x.loss_chars, x.loss_sha256) == (3, len(long) + 6, hashlib.sha256((long + "[INST]").encode()).hexdigest())

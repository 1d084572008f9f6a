"""Byte-level BPE by merge ranks: encoding with segment trees over byte positions, and decoding.

A text is first cut into chunks at the places where white space follows other characters. The pre-tokenizer's pattern
never matches across such a place, so the ids of a text are the ids of its chunks in a row; a batch's chunks are coded
once each, and those that come often stay in a table of bounded size. Each match of the pattern within a new chunk is a
piece. A piece's segment tree has a leaf for each byte position that holds (rank of the pair beginning there, position);
its root is the leftmost pair of least rank. A merge changes the leaves of the merged pair and of its live neighbours,
and their ancestors: a logarithmic number of nodes. Short pieces go through the tree many at a time, as rows of arrays.
Texts, chunks, pieces and ids stay in Arrow arrays.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_of

#: Table sizes: entries, and bytes of the longest entry.
KNOWN, KNOWN_BYTES = 150_000, 128
BATCH_BYTES = 8 << 20
BATCH_CHARS = 1 << 19
SHORT = 64
BLOCK = 80_000
NONE = -1
INF = np.int32(0x7FFF_FFFF)
IDS = pa.list_(pa.int32())

WHITE, SOLID, HIGH = 1, 2, 3
#: Of each byte: white space that may begin a chunk, a character that may end one, the end of a longer character, other.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x0A, 0x0D, 0x09]] = WHITE
_KIND[0x21:0x7F] = SOLID
_KIND[0x80:] = HIGH


class Ranks:
    """Merge ranks: token bytes to id, which is also the rank; pairs are looked up by their two ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens: list = [None] * (max(ids.values(), default=-1) + 1)
        for token, i in ids.items():
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.binary())
        pairs: dict[int, int] = {}
        for token, i in ids.items():
            for k in range(1, len(token)):
                a, b = ids.get(token[:k]), ids.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        if len(tokens) >= 1 << 24:
            raise ValueError("more ids than leaves of short trees can hold")
        self.of_byte = np.array([ids[bytes([i])] for i in range(256)], np.int32)
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFF_FFFF_FFFF_FFFF))
        self.values = np.full(1 << self.bits, INF)
        at = self._slot(keys)
        while len(keys):  # linear probing, all keys at once
            free = self.keys[at] == np.uint64(0xFFFF_FFFF_FFFF_FFFF)
            self.keys[at[free]] = keys[free]
            got = self.keys[at] == keys
            self.values[at[got]] = values[got]
            keys, values, at = keys[~got], values[~got], (at[~got] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E37_79B9_7F4A_7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of ids; INF where there is none."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], INF)
        left = np.flatnonzero((there != keys) & (there != np.uint64(0xFFFF_FFFF_FFFF_FFFF)))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there, k = self.keys[at[left]], keys[left]
            hit = there == k
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != np.uint64(0xFFFF_FFFF_FFFF_FFFF))]
        return out


def encode_long(ranks: Ranks, piece: bytes) -> list[int]:
    """Ids of one piece, by one segment tree."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    tok = [int(ranks.of_byte[x]) for x in piece]
    nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
    none = 1 << 62
    shift = size.bit_length()

    def leaf(i: int) -> int:
        j = nxt[i]
        r = ranks.pairs.get(tok[i] << 32 | tok[j]) if j >= 0 else None
        return none if r is None else r << shift | i

    tree = [none] * (2 * size)
    tree[size : size + n] = [leaf(i) for i in range(n)]
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            best = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best

    while tree[1] != none:
        i = tree[1] & (1 << shift) - 1
        j = nxt[i]
        tok[i], nxt[i] = tree[1] >> shift, nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        put(j, none)
        put(i, leaf(i))
        if prv[i] >= 0:
            put(prv[i], leaf(prv[i]))
    out, i = [], 0
    while i >= 0 and n:
        out.append(tok[i])
        i = nxt[i]
    return out


def encode_short(ranks: Ranks, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of fewer than 64 bytes, one after the other, and how many each has: the same trees, one row of the
    arrays for each piece. The pieces lie in ``data``, from ``starts`` on."""
    counts, order, out, low = np.zeros(len(lengths), np.int64), [], [], 0
    for size in (4, 8, 16, 32, SHORT):
        which = np.flatnonzero((lengths >= low) & (lengths < size))
        low = size
        for part in np.array_split(which, max(1, len(which) * size // BLOCK)):
            if len(part):
                ids, counts[part] = _rows(ranks, data, starts[part], lengths[part], size)
                order.append(part)
                out.append(ids)
    if not out:
        return np.zeros(0, np.int32), counts
    order = np.concatenate(order)
    ends = np.cumsum(counts[order])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(out)))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return lists.take(pa.array(back)).flatten().to_numpy(), counts


def _rows(ranks: Ranks, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    rows, dead = len(starts), size - 1  # no piece uses the last position: it stands for "no neighbour"
    shift, mask = np.int32(size.bit_length()), np.int32((1 << size.bit_length()) - 1)
    at = np.arange(size, dtype=np.int32)
    there = at < lengths[:, None]
    tok = np.full((rows, size), NONE, np.int32)
    tok[there] = ranks.of_byte[data[(starts[:, None] + at)[there]]]
    nxt = np.where(at + 1 < lengths[:, None], at + 1, np.int32(dead))
    prv = np.broadcast_to(np.where(at > 0, at - 1, np.int32(dead)), (rows, size)).copy()
    tree = np.full((rows, 2 * size), INF, np.int32)
    second = np.roll(tok, -1, axis=1)
    real = np.nonzero(at + 1 < lengths[:, None])
    r = ranks.of_pairs(tok[real], second[real])
    tree[real[0], size + real[1]] = np.where(r < INF, r << shift | real[1], INF)
    k = size // 2
    while k:
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        k //= 2
    tok, nxt, prv, tree = (x.reshape(-1) for x in (tok, nxt, prv, tree))
    live = np.flatnonzero(tree[1 :: 2 * size] < INF)
    while len(live):
        base, top = live * size, live * (2 * size)
        root = tree[top + 1]
        i = root & mask
        j = nxt[base + i]
        after = nxt[base + j]
        tok[base + i] = root >> shift
        nxt[base + i] = after
        prv[base + after] = i
        tok[base + j] = NONE
        before = prv[base + i]
        r = ranks.of_pairs(np.concatenate([tok[base + i], tok[base + before]]), np.concatenate([tok[base + after], tok[base + i]]))
        r = np.where(r < INF, r << shift | np.concatenate([i, before]), INF)
        tree[top + size + j] = INF
        tree[top + size + before] = r[len(live) :]
        tree[top + size + i] = r[: len(live)]
        tree[top + size + dead] = INF
        nodes = [size + i, size + j, size + before]
        while nodes[0][0] > 1:
            nodes = [x >> 1 for x in nodes]
            for x in nodes:
                k = top + 2 * x
                tree[top + x] = np.minimum(tree[k], tree[k + 1])
        live = live[tree[top + 1] < INF]
    kept = tok.reshape(rows, size) != NONE
    return tok.reshape(rows, size)[kept], kept.sum(1)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings in a row, and the offsets of each, the end included."""
    texts = texts.cast(pa.string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def lists_of(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def no_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character ends at each place that is no white space, by its last three bytes."""
    kind = _KIND[data[at]]
    ok = kind == SOLID
    where = np.flatnonzero((kind == HIGH) & (at >= 2))
    high = at[where]
    one, two, three = data[high], data[high - 1], data[high - 2]
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three >= 0xE1) & (three <= 0xE3) & (two >= 0x80) & (two <= 0x9A)
    ok[where[~wide]] = True
    return ok


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts that lie in a row: at each text's start, and where a space, tab, line feed or carriage
    return follows a character that isn't white space in any definition. After some other characters that share the
    first bytes of wide spaces there is no cut either, which only makes a chunk longer."""
    flag = np.zeros(len(data) + 1, bool)
    before = np.flatnonzero(_KIND[data[1:]] == WHITE)
    flag[before[no_space(data, before)] + 1] = True
    flag[offsets[:-1]] = True
    return np.flatnonzero(flag[: len(data)])


class Known:
    """Lists of ids by string, with a bounded table of those that come often; ``code`` gives the lists of new ones."""

    def __init__(self, code: Callable[[pa.Array], pa.ListArray]):
        self.code = code
        self.forget()

    def forget(self) -> None:
        self.words, self.lists = pa.array([], pa.string()), pa.array([], IDS)

    def of(self, words: pa.Array) -> pa.ListArray:
        """The list of each string."""
        coded = words.dictionary_encode()
        index, own = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        met = pc.index_in(own, value_set=self.words)
        fresh = met.is_null().to_numpy(zero_copy_only=False)
        place = met.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = own.filter(pa.array(fresh))
        place[fresh] = len(self.words) + np.arange(len(new))
        lists = pa.concat_arrays([self.lists, self.code(new)]) if len(new) else self.lists
        often = (np.bincount(index, minlength=len(own))[fresh] > 1) & (pc.binary_length(new).to_numpy(zero_copy_only=False) <= KNOWN_BYTES)
        stay = np.flatnonzero(often)
        if len(self.words) + len(stay) > KNOWN:
            self.forget()
            stay = stay[:KNOWN]
        base = len(lists) - len(new)
        self.words = pa.concat_arrays([self.words, new.take(pa.array(stay))])
        self.lists = pa.concat_arrays([self.lists, lists.take(pa.array(base + stay))])
        return lists.take(pa.array(place[index]))


class Encoder:
    """Texts to ids."""

    def __init__(self, code_chunks: Callable[[pa.Array], pa.ListArray]):
        self.chunks = Known(code_chunks)

    def batch(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; null texts have none."""
        data, offsets = buffers(texts.fill_null(""))
        if not len(data):
            return lists_of(np.zeros(0, np.int32), np.zeros(len(texts), np.int64))
        starts = chunk_starts(data, offsets)
        coded = self.chunks.of(strings(data, np.concatenate([starts, [len(data)]])))
        ends = np.concatenate([[0], np.cumsum(coded.value_lengths().to_numpy(zero_copy_only=False))])
        ends = ends[np.searchsorted(starts, offsets)]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), coded.flatten())

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, pa.ListArray]]:
        """(place of the first text, ids) for runs of texts of bounded size."""
        for start, stop in byte_runs(texts):
            yield start, self.batch(texts.slice(start, stop - start))


def byte_runs(texts: pa.Array, size: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts that have about ``size`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield start, stop
        start = stop


class Pieces:
    """Chunks to ids through the matches of the pattern in them; ``code`` gives the ids of pieces."""

    def __init__(self, pattern: str, code: Callable[[pa.Array], pa.ListArray]):
        self.pattern, self.known = regex.compile(pattern), Known(code)

    def __call__(self, chunks: pa.Array) -> pa.ListArray:
        data, offsets = buffers(chunks)
        # chunks that begin with white space and end without can be matched in a row
        inner = (_KIND[data[offsets[:-1]]] == WHITE) & no_space(data, offsets[1:] - 1)
        first, rest = np.flatnonzero(inner), np.flatnonzero(~inner)
        order = np.concatenate([first, rest])
        data, offsets = buffers(chunks.take(pa.array(order)))
        text = data.tobytes()
        cut = int(offsets[len(first)])
        found = self.pattern.findall(text[:cut].decode("utf-8"))
        for a, b in zip(offsets[len(first) : -1].tolist(), offsets[len(first) + 1 :].tolist(), strict=True):
            found += self.pattern.findall(text[a:b].decode("utf-8"))
        pieces = pa.array(found, pa.string())
        places = buffers(pieces)[1]
        coded = self.known.of(pieces)
        ends = np.concatenate([[0], np.cumsum(coded.value_lengths().to_numpy(zero_copy_only=False))])
        lists = pa.ListArray.from_arrays(pa.array(ends[np.searchsorted(places, offsets)].astype(np.int32)), coded.flatten())
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return lists.take(pa.array(back))


def rank_encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this module for a file of ranks."""
    ranks = once(Ranks, path)

    def code(pieces: pa.Array) -> pa.ListArray:
        data, offsets = buffers(pieces)
        lengths = np.diff(offsets)
        short = lengths < SHORT
        ids, counts = encode_short(ranks, data, offsets[:-1][short], lengths[short])
        if short.all():
            return lists_of(ids, counts)
        long = [encode_long(ranks, data[a:b].tobytes()) for a, b in zip(offsets[:-1][~short], offsets[1:][~short], strict=True)]
        both = pa.concat_arrays([lists_of(ids, counts), pa.array(long, IDS)])
        back = np.empty(len(lengths), np.int64)
        back[np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)])] = np.arange(len(lengths))
        return both.take(pa.array(back))

    return Encoder(Pieces(pattern, code))


_made: dict[tuple, object] = {}


def once(make: Callable, *args):
    """``make(*args)``, kept for the life of a worker process."""
    key = (make.__module__, make.__name__, *args)
    if key not in _made:
        if len(_made) >= 4:
            _made.clear()
        _made[key] = make(*args)
    return _made[key]


def small_runs(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of a list, each of about so many characters."""
    start, n = 0, 0
    for i, x in enumerate(texts):
        n += len(x)
        if n >= chars:
            yield slice(start, i + 1)
            start, n = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def bytes_of(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The bytes that each list of ids stands for: null for a null list, an error for an unknown id."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    flat, lengths = ids.flatten(), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if flat.null_count or len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(tokens)):
        raise ValueError("an id that is no token")
    found = tokens.take(flat)
    if found.null_count:
        raise ValueError("an id that is no token")
    data, places = _joined(found)
    ends = places[np.concatenate([[0], np.cumsum(lengths)])]
    null = ids.is_null().to_numpy(zero_copy_only=False)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
    return pa.Array.from_buffers(pa.binary(), len(ids), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _joined(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data[places[0] : places[-1]]), places - places[0]


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, back: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(rank_encoder, ranks_path, pattern)
        tokens = once(Ranks, ranks_path).tokens
        for batch in batches:
            keys, texts = batch.columns
            for start, ids in encoder.batches(texts):
                columns = [keys.slice(start, len(ids)), ids]
                yield pa.RecordBatch.from_arrays([*columns, bytes_of(tokens, ids)] if back else columns, ["id", "ids", "decoded"] if back else ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, ids array<int>"
    return rows.mapInArrow(run, schema + ", decoded binary" if back else schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; null and empty texts have no ids. Ids and rows are kept as they are,
    nulls and repeats too; other columns are left out, whatever their names; an empty table gives none. No shuffle."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, False)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with a third column, ``decoded``: the bytes that the ids stand for, as ``decode`` gives them. Both are
    done in one pass, so that a task has one Python worker and one table of ranks."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, True)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows of ``encoded`` with the bytes that their ids stand for; a null id list gives null, an unknown id an error.
    A column that already has the name of the result gives way to it; an empty table gives an empty result."""
    rows = encoded.drop(out_col) if out_col != ids_col else encoded
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = once(Ranks, ranks_path).tokens
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, bytes_of(tokens, part.column(names.index(ids_col)))], [*names, out_col])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, `{out_col}` binary")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token counts and digests of encoded and decoded documents, in SQL functions."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

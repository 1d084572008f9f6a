"""Repeated passages by sorting suffixes to a limited depth.

Two suffixes share a passage of ``length`` bytes exactly if a radix sort that stops at that depth leaves them in one
group, so the sort works digit by digit, the most significant first, drops suffixes that are alone, and what is left at
the end are the repeated windows. Suffixes are dealt to the tasks that sort them by their anchor: the leftmost of the
least hashed grams of a window. Equal windows have equal anchors at equal places, so windows that share an anchor are
shipped as one record of text, and anchors that occur once in the corpus are dropped before any text moves.

Records of an anchor that occurs very often are split further by digits that reach deeper, first the bytes that all
windows of a narrow band have, then whole windows, so that no group has to fit a task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, fresh_dir, materialise, text_of

LENGTH = 400
#: Texts are cut into stretches of so many window starts; places within a stretch take 24 bits.
STRETCH = 1 << 20
#: Anchors with more records than this are split by deeper digits; a task sorts records of so many bytes at a time.
HOT, SORTED_BYTES = 20_000, 4 << 20
#: Width of the bands that records of frequent anchors are split into.
BAND = 32
#: A task remembers so many texts' digests, and so many bytes of records, to send repeated ones once.
KNOWN_TEXTS, KNOWN_BYTES = 100_000, 32 << 20
DIGEST = 16


def digest_of(data: bytes) -> bytes:
    """The first 16 bytes of SHA-256, by which equal texts are known."""
    return hashlib.sha256(data).digest()[:DIGEST]


class Anchors:
    """Finds the anchor of every window of a text."""

    def __init__(self, length: int):
        if length < 16:
            raise ValueError("repeated passages of at least 16 bytes can be sought")
        self.length, self.gram = length, max(8, length * 8 // 25)
        self.width = length - self.gram + 1
        factor = 0x9E37_79B9_7F4A_7C15
        self.up, self.down = (self._powers(f) for f in (factor, pow(factor, -1, 1 << 64)))

    def _powers(self, factor: int) -> np.ndarray:
        out = np.full(STRETCH + self.length, factor, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _hashes(self, c: np.ndarray) -> np.ndarray:
        """Of each gram, from sums of bytes times powers."""
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * self.down[: len(c)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.up[: len(c) - self.gram + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51_AFD7_ED55_8CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CE_B9FE_1A85_EC53)
        return h ^ (h >> np.uint64(32))

    def _least(self, x: np.ndarray) -> np.ndarray:
        """Least of each ``width`` neighbours."""
        w, n = self.width, len(x) - self.width + 1
        blocks = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(right[:n], left[w - 1 : w - 1 + n])

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first window, last window, place) of each anchor, with the windows that it stands for."""
        out = []
        for begin in range(0, len(text) - self.length + 1, STRETCH):
            h = self._hashes(np.frombuffer(text, np.uint8, min(STRETCH + self.length - 1, len(text) - begin), begin))
            at = (self._least(h & ~np.uint64(0xFF_FFFF) | np.arange(len(h), dtype=np.uint64)) & np.uint64(0xFF_FFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.concatenate([first[1:], [len(at)]]) - 1
            out.append((h[at[first]].view(np.int64), *((x + begin).astype(np.int32) for x in (first, last, at[first]))))
        if not out:
            return np.empty(0, np.int64), *(np.empty(0, np.int32),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def equal_suffixes(data: np.ndarray, place: np.ndarray, group: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes, given by their places in ``data``, agree to ``length`` bytes with another one of their group or
    stand for several themselves (``weight``). Most significant digits of 8 bytes come first; a suffix that has become
    alone is settled and leaves. ``data`` goes on for at least 8 bytes after the last window."""
    digits = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    settled = np.zeros(len(place), bool)
    own = np.argsort(group, kind="stable")
    group = group[own]
    for depth in range(0, length + 8, 8):
        fresh = np.concatenate([[True], group[1:] != group[:-1]])[: len(own)]
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(own)))
        alone = own[head[size == 1]]
        settled[alone] = weight[alone] > 1
        left = np.repeat(size > 1, size)
        own, group, size = own[left], group[left], size[size > 1]
        if not len(own) or depth >= length:
            break
        digit = digits[place[own] + min(depth, length - 8)].astype(np.uint64)
        head = np.cumsum(size) - size
        mixed = np.repeat(np.logical_or.reduceat(digit != np.repeat(digit[head], size), head), size)
        if mixed.any():
            part = np.flatnonzero(mixed)
            order = part[np.lexsort((digit[part], group[part]))]
            own[part], digit[part] = own[order], digit[order]
        group = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]))
    settled[own] = True
    return settled


# -- tasks

TEXTS = "digest binary, packed binary, n long"
INDEXED = "digest binary, n long, packed binary, key array<long>, first array<int>, last array<int>, at array<int>"
RECORDS = "grp long, key long, record binary, base int, at int, content binary, n long"
MARKS = "key long, record binary, first array<int>, last array<int>"


def _schema(ddl: str) -> pa.Schema:
    types = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, types[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by their digests; one that a task has sent is only counted from then on."""
    schema, z, seen = _schema(TEXTS), zstandard.ZstdCompressor(level=1), {}
    for batch in batches:
        out, size = [], 0
        for text in batch.column(0):
            data = text.as_buffer()
            d = digest_of(data)
            if d in seen:
                seen[d] += 1
                continue
            if len(seen) >= KNOWN_TEXTS:
                yield _emit([(k, None, n) for k, n in seen.items() if n], schema)
                seen.clear()
            seen[d] = 0
            out.append((d, z.compress(data), 1))
            size += len(out[-1][1])
            if size >= 4 << 20:
                yield _emit(out, schema)
                out, size = [], 0
        yield _emit(out, schema)
    yield _emit([(k, None, n) for k, n in seen.items() if n], schema)


def _index(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row per distinct text, with its anchors; rows come sorted by digest, those with a text first."""
    schema, unzip, anchors = _schema(INDEXED), zstandard.ZstdDecompressor(), Anchors(length)
    last, packed, n, out, size = None, None, 0, [], 0

    def row() -> tuple:
        return (last, n, packed, *anchors.find(unzip.decompress(packed)))

    for batch in batches:
        for d, z, k in zip(*(batch.column(c).to_pylist() for c in ("digest", "packed", "n")), strict=True):
            if d != last:
                if last is not None:
                    out.append(row())
                    size += len(packed) + 20 * len(out[-1][3])
                    if size >= 4 << 20:
                        yield _emit(out, schema)
                        out, size = [], 0
                last, packed, n = d, z, 0
            n += k
    if last is not None:
        out.append(row())
    yield _emit(out, schema)


def _wanted(batch: pa.RecordBatch, hot: bool) -> Iterator[tuple[bytes, int, list[tuple[int, int, int, bytes]]]]:
    """(digest, copies, [(key, first window, anchor within the record, record)]) of each text's anchors that occur elsewhere."""
    unzip = zstandard.ZstdDecompressor()
    # lists as views of their values, not as Python lists
    lists = {c: [np.asarray(x.values) if x.is_valid else np.empty(0, np.int64) for x in batch.column(c)] for c in ("key", "first", "last", "at", "wanted", "often")}
    for k, (d, n, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "packed")), strict=True)):
        ask = lists["often"][k] if hot else lists["wanted"][k]
        own = np.flatnonzero(np.isin(lists["key"][k], ask))
        if len(own):
            yield d, n, list(zip(*(lists[c][k][own].tolist() for c in ("key", "first", "last", "at")), strict=True)), unzip.decompress(packed)


def _record_digest(at: int, content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=DIGEST, salt=at.to_bytes(8, "little")).digest()


def _records(batches: Iterator[pa.RecordBatch], length: int, hot: bool) -> Iterator[pa.RecordBatch]:
    """Records of text; equal ones are counted as far as a task remembers them."""
    schema, known, size = _schema(RECORDS), {}, 0
    for batch in batches:
        for _, n, own, text in _wanted(batch, hot):
            for key, first, last, at in own:
                content = text[first : last + length]
                name = (key, _record_digest(at - first, content))
                if name in known:
                    known[name][2] += n
                    continue
                known[name] = [at - first, content, n]
                size += len(content)
                if size >= KNOWN_BYTES:
                    yield _emit([(k, k, d, 0, a, c, w) for (k, d), (a, c, w) in known.items()], schema)
                    known, size = {}, 0
    yield _emit([(k, k, d, 0, a, c, w) for (k, d), (a, c, w) in known.items()], schema)


def _places(batches: Iterator[pa.RecordBatch], length: int, hot: bool) -> Iterator[pa.RecordBatch]:
    """Where records stand: (digest of the text, key, digest of the record, first windows)."""
    for batch in batches:
        out: dict[tuple, list[int]] = {}
        for d, _, own, text in _wanted(batch, hot):
            for key, first, last, at in own:
                out.setdefault((d, key, _record_digest(at - first, text[first : last + length])), []).append(first)
        rows = [(*k, v) for k, v in out.items()]
        yield _emit(rows, _schema("digest binary, key long, record binary, begin array<int>"))


def _sort(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of each record; rows come sorted by group."""
    schema, now, group, whole, size = _schema(MARKS), None, {}, [], 0

    def settle() -> pa.RecordBatch:
        starts = np.array([len(r[4]) - length + 1 for _, r in whole])
        begin = np.cumsum([0, *(len(r[4]) for _, r in whole)])[:-1]
        data = np.frombuffer(b"".join(r[4] for _, r in whole) + bytes(8), np.uint8)
        owner = np.repeat(np.arange(len(whole)), starts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
        ahead = np.array([r[3] for _, r in whole])[owner] - offset
        named = np.array([g for g, _ in whole])[owner] * (length + 1) + ahead
        found = equal_suffixes(data, begin[owner] + offset, named, np.array([r[5] for _, r in whole])[owner], length)
        edge = np.diff(np.concatenate([[0], (found * (owner + 1)), [0]]))
        # a run ends where its record does, even if the next record begins with one
        low, high = np.flatnonzero((edge != 0) & np.append(found, False)), np.flatnonzero((edge != 0) & np.append(False, found)) - 1
        out: dict[int, tuple[list, list]] = {}
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            firsts, lasts = out.setdefault(int(owner[a]), ([], []))
            base = whole[owner[a]][1][2]
            firsts.append(int(offset[a]) + base)
            lasts.append(int(offset[b]) + base)
        return _emit([(whole[k][1][0], whole[k][1][1], *v) for k, v in out.items()], schema)

    number = 0
    for batch in batches:
        for grp, key, record, base, at, content, n in zip(*(batch.column(c).to_pylist() for c in ("grp", "key", "record", "base", "at", "content", "n")), strict=True):
            if grp != now:
                whole += [(number, r) for r in group.values()]
                number, now, group = number + 1, grp, {}
                if size >= SORTED_BYTES:
                    yield settle()
                    whole, size, number = [], 0, 0
            name = (key, record, base)
            if name in group:
                group[name][5] += n
            else:
                group[name] = [key, record, base, at, content, n]
                size += len(content)
    whole += [(number, r) for r in group.values()]
    if whole:
        yield settle()


def _bands(batches: Iterator[pa.RecordBatch], length: int, band: int) -> Iterator[pa.RecordBatch]:
    """Records split by the distance of windows from their anchor; the group is told by the bytes that all windows of a
    band have. Bands of one window are told by the whole window."""
    schema = _schema(RECORDS)
    for batch in batches:
        out, size = [], 0
        for key, record, base, at, content, n in zip(*(batch.column(c).to_pylist() for c in ("key", "record", "base", "at", "content", "n")), strict=True):
            starts = len(content) - length + 1
            for b in range(max(0, at - starts + 1) // band, at // band + 1):
                low, high = max(0, at - (b + 1) * band + 1), min(starts - 1, at - b * band)
                core = content[at - b * band : at - (b + 1) * band + 1 + length]
                grp = hashlib.blake2b(core, digest_size=8, salt=b.to_bytes(8, "little"), key=key.to_bytes(8, "little", signed=True)).digest()
                out.append((int.from_bytes(grp, "little", signed=True), key, record, base + low, at - low, content[low : high + length], n))
                size += high - low + length
                if size >= 4 << 20:
                    yield _emit(out, schema)
                    out, size = [], 0
        yield _emit(out, schema)


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans to remove and the bytes that stay, of each text with marks."""
    unzip, schema = zstandard.ZstdDecompressor(), _schema("digest binary, first array<int>, last array<int>, kept binary")
    for batch in batches:
        out = []
        for d, packed, marks in zip(*(batch.column(c).to_pylist() for c in ("digest", "packed", "marks")), strict=True):
            text = unzip.decompress(packed)
            depth = np.zeros(len(text) + 1, np.int32)
            for m in marks:
                begin = np.array(m["begin"])[:, None]
                np.add.at(depth, (begin + np.array(m["first"])).ravel(), 1)
                np.add.at(depth, (begin + np.array(m["last"]) + length).ravel(), -1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).astype(np.int32)
            out.append((d, edge[::2], edge[1::2], np.frombuffer(text, np.uint8)[~gone].tobytes()))
        yield _emit(out, schema)


# -- jobs


def repeated_spans(docs: DataFrame, length: int = LENGTH, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(digest, first, last, kept): for each distinct text with a passage of ``length`` bytes that also starts anywhere
    else in the corpus, the same text included, the maximal spans of bytes that such passages cover (``last`` is the byte
    after) and the bytes outside them. ``digest`` is the first half of the text's SHA-256.

    Texts are taken as UTF-8 bytes, null as empty; passages don't cross texts; texts shorter than ``length`` have none.
    Copies of a text are found by digest and counted: a text that occurs twice is repeated everywhere. An empty
    table gives no rows.

    Distinct texts are written once, dealt out by digest into buckets, so that nothing shuffles them again. Anchors
    (one in about ``length`` / 3 bytes) are counted; the records around those that occur again are sorted by the tasks that own
    their anchor. ``hot`` is the number of records from which an anchor's are split by deeper digits.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select(text_of(text_col).cast("binary").alias("text")).mapInArrow(_pack, TEXTS)
    ordered = packed.repartition(n, "digest").sortWithinPartitions("digest", F.col("packed").isNull())
    name = f"texts_{uuid.uuid4().hex}"
    indexed = ordered.mapInArrow(lambda batches: _index(batches, length), INDEXED)
    indexed.write.bucketBy(n, "digest").option("path", fresh_dir(spark, "texts")).option("compression", "zstd").format("parquet").saveAsTable(name)
    texts = spark.table(name)

    counts = texts.select("n", F.explode("key").alias("key")).groupBy("key").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("r")).where("w > 1")
    own = texts.select("digest", F.explode(F.array_distinct("key")).alias("key")).join(counts, "key")
    lists = own.groupBy("digest").agg(F.collect_list(F.when(F.col("r") <= hot, F.col("key"))).alias("wanted"), F.collect_list(F.when(F.col("r") > hot, F.col("key"))).alias("often"))
    asked = texts.join(materialise(lists, "anchors"), "digest")

    def records(often: bool) -> DataFrame:
        return asked.mapInArrow(lambda batches: _records(batches, length, often), RECORDS)

    def places(often: bool) -> DataFrame:
        return asked.mapInArrow(lambda batches: _places(batches, length, often), "digest binary, key long, record binary, begin array<int>")

    def sort(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(lambda batches: _sort(batches, length), MARKS)

    marked = sort(records(False)).join(places(False), ["key", "record"])
    if not asked.select("often").where(F.size("often") > 0).isEmpty():
        marked = marked.unionByName(_frequent(records(True), length, hot, sort).join(places(True), ["key", "record"]))
    marks = marked.groupBy("digest").agg(F.collect_list(F.struct("begin", "first", "last")).alias("marks"))
    return texts.select("digest", "packed").join(marks, "digest").mapInArrow(lambda batches: _cut_out(batches, length), "digest binary, first array<int>, last array<int>, kept binary")


def _frequent(records: DataFrame, length: int, hot: int, sort) -> DataFrame:
    """Marks of the records of anchors that occur very often."""
    distinct = materialise(records.groupBy("key", "record", "base", "at", "content").agg(F.sum("n").alias("n")), "frequent")

    def split(rows: DataFrame, band: int) -> tuple[DataFrame, DataFrame]:
        pieces = rows.mapInArrow(lambda batches: _bands(batches, length, band), RECORDS)
        counts = pieces.groupBy("grp").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("r")).where("w > 1")
        return pieces, counts

    pieces, counts = split(distinct, BAND)
    counts = materialise(counts, "bands")
    marks = sort(pieces.join(counts.where(F.col("r") <= hot), "grp"))
    if not counts.where(F.col("r") > hot).isEmpty():
        windows, again = split(pieces.join(counts.where(F.col("r") > hot).select("grp"), "grp", "left_semi"), 1)
        # what shares a whole window, byte for byte, is a group that needs no sort
        same = windows.groupBy("grp", "content").agg(F.sum("n").alias("w")).where("w > 1").select("grp", F.md5("content").alias("h"))
        found = windows.select("grp", F.md5("content").alias("h"), "key", "record", "base").join(same, ["grp", "h"])
        marks = marks.unionByName(found.select("key", "record", F.array("base").alias("first"), F.array("base").alias("last")))
    return marks


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every input row, as ``repeated_spans`` has it. Rows that repeat an
    id are judged each; null ids are allowed; other columns are ignored, whatever their names; an empty table gives no rows."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    size = F.aggregate(F.arrays_zip("first", "last"), F.lit(0).cast("long"), lambda a, z: a + z["last"] - z["first"])
    cut = repeated_spans(docs, length, text_col).select("digest", size.alias("n"), F.size("first").cast("long").alias("spans"), F.sha2("kept", 256).alias("kept"))
    joined = rows.join(cut, F.unhex(F.substring("sha", 1, 2 * DIGEST)) == F.col("digest"), "left")
    return joined.select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256")
    )


def drop_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the bytes that stay as their text (a character that a span cuts becomes a replacement
    character); null texts stay null, and other columns are kept, whatever their names."""
    at, kept = free_name(docs, "__digest"), free_name(docs, "__kept")
    cut = repeated_spans(docs, length, text_col).select(F.col("digest").alias(at), F.make_valid_utf8(F.col("kept").cast("string")).alias(kept))
    joined = docs.join(cut, F.unhex(F.substring(F.sha2(text_of(text_col).cast("binary"), 256), 1, 2 * DIGEST)) == F.col(at), "left")
    return joined.select(*[F.coalesce(F.col(kept), docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])

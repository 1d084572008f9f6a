"""Token ids in files: one zstandard frame per document, a shared dictionary, and an offset index.

A file is: 8 bytes of magic, the SHA-256 of the dictionary (32 bytes), the width of an id in bytes (1 byte), the
frames, then the index (for each document its id, flag for a null id, frame offset, frame length, number of ids) and a
footer (index offset, number of documents, crc32 of the index). The dictionary lies beside the files under its hash. A
reader that wants one document reads the footer, the index and that document's frame.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.bpe import Encoder, Pieces, buffers, lists_of, once
from quire.llm.common import fresh_dir, hash_sample, materialise, text_of
from quire.llm.files import RollingWriter, opened

MAGIC = b"QTOKENS1"
HEAD, FOOT = "<8s32sB", "<QQI"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u8")])
FILE_BYTES = 16 << 20
#: The dictionary is trained on at most so many documents of at most so many characters each, taken in hash order.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 20_000, 64 << 10
LEVEL = 3
FILES = pa.schema([("uri", pa.string()), ("worker", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


#: Characters whose classes no edition of Unicode and no regular expression library sees otherwise.
PLAIN = r"^[\t\n\r -~\x{A1}-\x{AC}\x{AE}-\x{24F}]*$"


class LibraryEncoder(Encoder):
    """The tokenizers library over chunks that weren't met before.

    With a byte-level pre-tokenizer and no normalizer, each piece of a plain chunk goes to the library's model; chunks
    with other characters go through the library as they are. Texts that hold one of the tokenizer's added tokens do so
    as a whole, and so do all texts for tokenizers of another kind.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        self.by_pieces = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not spec["normalizer"] and not spec["truncation"] and not spec["padding"]
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.model = self.tokenizer.model
        self.pieces = Pieces(pattern, self._model)
        super().__init__(self._chunks)

    def _model(self, pieces: pa.Array) -> pa.ListArray:
        data, offsets = buffers(pieces)
        text, ends = data.tobytes().decode("latin-1").translate(BYTE_CHARS), offsets.tolist()
        ids, counts, tokenize = [], [], self.model.tokenize
        for a, b in itertools.pairwise(ends):
            own = tokenize(text[a:b])
            counts.append(len(own))
            ids += [x.id for x in own]
        return lists_of(np.array(ids, np.int32), np.array(counts, np.int64))

    def _whole(self, texts: list[str]) -> pa.ListArray:
        own = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return lists_of(np.array(list(itertools.chain.from_iterable(own)), np.int32), np.array([len(x) for x in own], np.int64))

    def _chunks(self, chunks: pa.Array) -> pa.ListArray:
        return _in_turn(chunks, pc.match_substring_regex(chunks, pattern=PLAIN), self.pieces, lambda x: self._whole(x.to_pylist()))

    def batch(self, texts: pa.Array) -> pa.ListArray:
        texts = texts.fill_null("")
        apart = pa.array(np.full(len(texts), not self.by_pieces))
        for token in self.added:
            apart = pc.or_(apart, pc.match_substring(texts, pattern=token))
        return _in_turn(texts, apart, lambda x: self._whole(x.to_pylist()), super().batch)


def _in_turn(rows: pa.Array, which: pa.Array, yes, no) -> pa.ListArray:
    """``yes`` of the rows that are marked and ``no`` of the others, in the rows' order."""
    mark = which.to_numpy(zero_copy_only=False)
    if mark.all() or not mark.any():
        return (yes if mark.any() else no)(rows)
    back = np.empty(len(mark), np.int64)
    back[np.concatenate([np.flatnonzero(mark), np.flatnonzero(~mark)])] = np.arange(len(mark))
    return pa.concat_arrays([yes(rows.filter(which)), no(rows.filter(pc.invert(which)))]).take(pa.array(back))


def _byte_chars() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters for themselves,
    the other bytes, in order, by the characters from 256 on."""
    own = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174]
    return {i: i for i in own} | {i: 256 + k for k, i in enumerate(i for i in range(256) if i not in own)}


BYTE_CHARS = _byte_chars()


def two_bytes(path: str, end_id: int) -> bool:
    """Whether two bytes hold every id of the tokenizer and the end id."""
    from tokenizers import Tokenizer

    return max(end_id, *Tokenizer.from_file(path).get_vocab(True).values()) < 1 << 16


def train_dictionary(docs: DataFrame, path: str, pattern: str, text_col: str = "text", end_id: int = 0) -> bytes:
    """A zstandard dictionary from a bounded sample; empty when there is too little to train on. It only affects sizes."""
    texts = docs.select(text_of(text_col).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    picked = hash_sample(texts, F.xxhash64("text"), SAMPLE_DOCS).distinct()
    packed = picked.mapInArrow(_pack_sample(path, pattern, two_bytes(path, end_id)), "ids binary")
    samples = [bytes(r.ids) for r in packed.toLocalIterator()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _pack_sample(path: str, pattern: str, two: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(LibraryEncoder, path, pattern)
        for batch in batches:
            for _, ids in encoder.batches(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_packed(ids, two), pa.binary())], ["ids"])

    return run


def _packed(ids: pa.ListArray, two: bool) -> list[bytes]:
    """The ids of each list as little-endian integers."""
    flat = ids.flatten().to_numpy().astype("<u2" if two else "<u4").tobytes()
    ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]) * (2 if two else 4)
    return [flat[a:b] for a, b in itertools.pairwise(ends.tolist())]


def write_tokens(docs: DataFrame, root: str, path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every whole text, each followed by ``end_id``, in ascending order of id below ``root``; gives
    (uri, worker, seq, n_docs, n_tokens) of each file.

    Null texts count as empty and have the end id alone; null ids come first; rows that repeat an id stand in the order
    of their texts. Added tokens of the tokenizer that stand in a text get their one id, as in the library. An empty
    table gives no files; other columns are left out, whatever their names. The rows are dealt out by ranges of the id,
    so files follow each other in (worker, seq).
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, pattern, text_col, end_id)
    digest, two = hashlib.sha256(dictionary).digest(), two_bytes(path, end_id)
    out = RollingWriter(root, "", 1)
    with out.store.open_output_stream(f"{out.path}/{digest.hex()}.dict", compression=None) as f:
        f.write(dictionary)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_of(text_col).alias("__text"))
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "__id").sortWithinPartitions("__id", "__text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(LibraryEncoder, path, pattern)
        params = {"level": LEVEL} | ({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {})
        frames, end = zstandard.ZstdCompressor(**params), np.array([end_id], "<u2" if two else "<u4").tobytes()
        files, index, seq = RollingWriter(root, ".tokens", FILE_BYTES), [], 0

        def close() -> pa.RecordBatch:
            nonlocal index, seq
            table = np.array(index, INDEX).tobytes()
            files.write(table + struct.pack(FOOT, files.size, len(index), zlib.crc32(table)))
            uri, _ = files.close()
            done = pa.RecordBatch.from_pylist([{"uri": uri, "worker": TaskContext.get().partitionId(), "seq": seq, "n_docs": len(index), "n_tokens": sum(x[4] for x in index)}], FILES)
            index, seq = [], seq + 1
            return done

        for batch in batches:
            keys, nulls = batch.column(0).fill_null(0).to_pylist(), batch.column(0).is_null().to_pylist()
            for start, ids in encoder.batches(batch.column(1)):
                for k, packed in enumerate(_packed(ids, two), start):
                    if not index:
                        files.write(struct.pack(HEAD, MAGIC, digest, len(end)))
                    frame = frames.compress(packed + end)
                    index.append((keys[k], nulls[k], files.write(frame), len(frame), len(packed) // len(end) + 1))
                    if files.full():
                        yield close()
        if index:
            yield close()

    return dealt.mapInArrow(write, "uri string, worker int, seq int, n_docs long, n_tokens long")


class TokenFile:
    """Reads a file of this format; ``f`` needs read, seek and size."""

    def __init__(self, f, dictionaries: dict[bytes, bytes], load):
        self.f = f
        size = f.size()
        f.seek(0)
        magic, digest, self.width = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
        if magic != MAGIC:
            raise ValueError("not a token file")
        if digest not in dictionaries:
            dictionaries[digest] = load(digest)
            if hashlib.sha256(dictionaries[digest]).digest() != digest:
                raise ValueError("the dictionary isn't the one that the file names")
        d = dictionaries[digest]
        self.frames = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(d)} if d else {}))
        f.seek(size - struct.calcsize(FOOT))
        at, n, crc = struct.unpack(FOOT, f.read(struct.calcsize(FOOT)))
        f.seek(at)
        table = f.read(n * INDEX.itemsize)
        if zlib.crc32(table) != crc:
            raise ValueError("the index is damaged")
        self.index = np.frombuffer(table, INDEX)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from its own frame alone."""
        entry = self.index[k]
        self.f.seek(int(entry["offset"]))
        return np.frombuffer(self.frames.decompress(self.f.read(int(entry["length"]))), f"<u{self.width}").astype("<u4")


def file_starts(files: DataFrame) -> DataFrame:
    """``files`` with ``base``, the number of ids in all files before. Sums go by worker first; one row per worker is
    then summed in order, and workers are as many as partitions."""
    workers = files.groupBy("worker").agg(F.sum("n_tokens").alias("all"))
    before = F.sum("all").over(Window.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1))
    workers = workers.select("worker", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("worker").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return files.join(workers, "worker").withColumn("base", F.col("before") + F.coalesce(within, F.lit(0))).drop("before")


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: one task reads a file, one frame at a time.
    No files give no rows; columns of ``files`` beside uri, worker, seq and n_tokens are ignored; a null id stays null."""
    n = max(1, files.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionaries: dict[bytes, bytes] = {}
        for batch in batches:
            for uri, base in zip(batch["uri"], batch["base"], strict=True):

                def load(digest: bytes, uri=uri) -> bytes:
                    with opened(f"{uri.rpartition('/')[0]}/{digest.hex()}.dict") as d:
                        return d.read()

                with opened(uri) as f:
                    file = TokenFile(f, dictionaries, load)
                    n_tokens = file.index["n_tokens"].astype(np.int64)
                    crc, counted = [], []
                    for k in range(len(file.index)):
                        ids = file.ids(k)
                        crc.append(zlib.crc32(ids.tobytes()))
                        counted.append(len(ids))
                    if counted != n_tokens.tolist():
                        raise ValueError(f"{uri}: the index doesn't fit the frames")
                    yield pd.DataFrame({"doc_id": pd.array(file.index["doc_id"].astype(np.int64), "Int64").copy(), "start": base + np.cumsum(n_tokens) - n_tokens, "n_tokens": n_tokens, "ids_crc32": crc}).assign(doc_id=lambda x, m=file.index["null"] > 0: x["doc_id"].mask(m))

    return file_starts(files).select("uri", "base").repartition(n).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Write all documents, read the files back, describe each document: one row for each, repeats and null ids too; none
    for an empty table."""
    root = fresh_dir(docs.sparkSession, "tokens")
    return read_tokens(materialise(write_tokens(docs, root, path, pattern), "token-files"))

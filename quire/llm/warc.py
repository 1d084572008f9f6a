"""WARC archives: a writer with revisit records, and a reader that salvages damaged files."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh_dir, materialise, text_of
from quire.llm.files import RollingWriter, opened

ARCHIVE_BYTES = 16 << 20
MIN_REVISIT_BYTES = 1000
BLOCK, INFLATED = 1 << 20, 4 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION, VERSION_BYTES = re.compile(rb"WARC/\d\.\d\r\n"), 10

RECORD_SCHEMA = "uri string, kind string, page_id long, target string, payload_bytes long, payload_digest string, refers_to long, payload binary, offset long, length long, reason string"


# -- writing


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One uncompressed record. A revisit carries the HTTP head alone, whose Content-Length tells the payload's size."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress_member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compressed: bool = True) -> DataFrame:
    """Write a record per row into archives of about 16 MB below ``root``; gives (uri, bytes, records) of each archive.

    Of rows whose payloads of at least 1000 bytes are equal, the row with the largest id is written as response and
    the others as revisits that refer to it; rows that repeat that id, smaller payloads and rows without an id in a
    group of nothing else are responses. Null payloads count as empty; null urls give records without a target.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), (F.col(url_col) if url_col in pages.columns else F.lit(None)).cast("string").alias("__url"), text_of(payload_col).cast("binary").alias("__payload"))
    # small payloads, which match nothing, are dealt out by keys of their own
    long = F.length("__payload") >= MIN_REVISIT_BYTES
    rows = rows.withColumn("__key", F.when(long, F.sha2("__payload", 256)).otherwise(F.xxhash64("__id", "__url", "__payload").cast("string")))
    same = rows.where(long).groupBy("__key").agg(F.max("__id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    judged = rows.join(same, "__key", "left").select(
        "__id", "__url", "__payload", F.sha1("__payload").alias("__sha1"), F.when(F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first")), F.col("__first")).alias("__refers")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = RollingWriter(root, ".warc.gz" if compressed else ".warc", ARCHIVE_BYTES), 0
        for batch in batches:
            for i, url, payload, sha1, refers in zip(batch["__id"], batch["__url"], batch["__payload"], batch["__sha1"], batch["__refers"], strict=True):
                i, refers = (None if pd.isna(x) else int(x) for x in (i, refers))
                record = build_record(i, url, bytes(payload), sha1, "response" if refers is None else "revisit", refers)
                out.write(compress_member(record) if compressed else record)
                n += 1
                if out.full():
                    uri, size = out.close()
                    yield pd.DataFrame({"uri": [uri], "bytes": [size], "records": [n]})
                    n = 0
        if n:
            uri, size = out.close()
            yield pd.DataFrame({"uri": [uri], "bytes": [size], "records": [n]})

    return judged.mapInPandas(write, "uri string, bytes long, records long")


# -- reading


class _Reader:
    """Bytes of a file by position, read in blocks; one block or one record is held at a time."""

    def __init__(self, f):
        self.f = f
        f.seek(0, 2)
        self.size, self.start, self.block = f.tell(), 0, b""

    def at(self, pos: int, n: int) -> bytes:
        """``n`` bytes from ``pos`` on, fewer at the file's end."""
        if pos < self.start or pos + n > self.start + len(self.block) < self.size or pos > self.start + len(self.block):
            self.f.seek(pos)
            self.start, self.block = pos, self.f.read(max(n, BLOCK))
        return self.block[pos - self.start : pos - self.start + n]

    def find(self, pattern: re.Pattern, pos: int, longest: int) -> int:
        """Where the pattern, of at most ``longest`` bytes, next matches from ``pos`` on; the file's end if nowhere."""
        while pos < self.size:
            block = self.at(pos, max(BLOCK, 2 * longest))
            if m := pattern.search(block):
                return pos + m.start()
            pos += max(1, len(block) - longest + 1)
        return self.size


def parse_head(data: bytes) -> dict:
    """The fields of a header, which are ``data`` without the blank line; ValueError tells what is wrong."""
    head = {}
    for line in data.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", head.get("content-length", "")):
        raise ValueError("no content length")
    return head


def _checked(head: dict, block: bytes) -> bytes:
    said = head.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:].lower() != hashlib.sha1(block).hexdigest():
        raise ValueError("block digest differs")
    return block


def _record(r: _Reader, pos: int) -> tuple[dict, bytes, int]:
    """Fields, block and length of the record at ``pos``. The end that its Content-Length claims is looked up before
    the block is read, so a false length costs no more than that."""
    n = 4096
    while True:
        data = r.at(pos, n)
        if not VERSION.match(data):
            raise ValueError("no version line")
        end = data.find(b"\r\n\r\n")
        if end >= 0:
            break
        if len(data) < n or not all(b":" in x for x in data.split(b"\r\n")[1:-1]):
            raise ValueError("header does not end")
        n *= 2
    head = parse_head(data[:end])
    size, at = int(head["content-length"]), pos + end + 4
    if at + size + 4 > r.size:
        raise EOFError("record is cut off")
    if r.at(at + size, 4) != b"\r\n\r\n":
        raise ValueError("no end of record")
    return head, _checked(head, r.at(at, size)), end + 4 + size + 4


def _member(r: _Reader, pos: int) -> tuple[dict, bytes, int]:
    """Fields and block of the record in the gzip member at ``pos``, and the member's length. No more is inflated than
    the record's header asks for, and a step at most."""
    z, out, used, head, whole = zlib.decompressobj(31), bytearray(), 0, None, 0
    while not z.eof:
        piece = r.at(pos + used, BLOCK)
        new = z.decompress(piece, INFLATED)
        if not piece and not new:
            raise EOFError("member is cut off")
        used += len(piece) - len(z.unconsumed_tail) - len(z.unused_data)
        out += new
        if head is None:
            if (len(out) >= VERSION_BYTES or z.eof) and not VERSION.match(out):
                raise ValueError("no version line")
            end = out.find(b"\r\n\r\n", max(0, len(out) - len(new) - 3))
            if end >= 0:
                head = parse_head(bytes(out[:end]))
                start = end + 4
                whole = start + int(head["content-length"]) + 4
        if head is not None and len(out) > whole:
            raise ValueError("bytes after the record in its member")
    if head is None:
        raise ValueError("header does not end")
    if len(out) < whole:
        raise EOFError("record is cut off")
    if out[-4:] != b"\r\n\r\n":
        raise ValueError("no end of record")
    return head, _checked(head, bytes(out[start:-4])), used


def salvage(f) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of an archive, compressed or not: ("record", offset, length, (fields, block)) or
    ("gap", offset, length, reason). ``f`` needs read, seek and tell.

    A record counts only if its member inflates with the right checksum, its header is whole, its end is where
    Content-Length says and its block digest holds. After a failure the reader looks for the next gzip member or
    version line that can be read, goes on there, and reports the bytes between as one gap.
    """
    r, pos = _Reader(f), 0
    gap: tuple[int, str] | None = None
    start = re.compile(re.escape(MAGIC) + rb"|WARC/\d\.\d\r\n")
    while pos < r.size:
        try:
            head, block, used = (_member if r.at(pos, len(MAGIC)) == MAGIC else _record)(r, pos)
        except (ValueError, EOFError, zlib.error) as e:
            gap = gap or (pos, str(e))
            pos = r.find(start, pos + 1, VERSION_BYTES)
            continue
        if gap:
            yield "gap", gap[0], pos - gap[0], gap[1]
            gap = None
        yield "record", pos, used, (head, block)
        pos += used
    if gap:
        yield "gap", gap[0], pos - gap[0], gap[1]


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def _describe(uri: str, at: int, n: int, head: dict, block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head.get("warc-type", "")
    if kind == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        size, digest = int(m[1]) if m else None, head.get("warc-payload-digest", "").removeprefix("sha1:").lower()
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return uri, kind, _page(head.get("warc-record-id")), head.get("warc-target-uri"), size, digest, _page(head.get("warc-refers-to")), payload if kind != "revisit" else None, at, n, None


def read_archives(archives: DataFrame, payloads: bool = True, strict: bool = False) -> DataFrame:
    """The records of the archives named in column ``uri``, and rows of kind ``gap`` for quarantined byte ranges; if
    ``strict``, a gap is an error instead.

    Each archive is read in blocks by one task; at most one record is held at a time. Payload digests of responses are
    computed from the payload that was read. An empty list of archives gives no rows; an empty archive neither.
    """
    n = max(1, archives.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for uri in batch["uri"]:
                rows, size = [], 0
                with opened(uri) as f:
                    for kind, at, length, what in salvage(f):
                        if strict and kind == "gap":
                            raise ValueError(f"{uri}: {length} bytes at {at} can't be read: {what}")
                        row = _describe(uri, at, length, *what) if kind == "record" else (uri, "gap", None, None, None, None, None, None, at, length, what)
                        rows.append(row if payloads else (*row[:7], None, *row[8:]))
                        size += len(row[7] or b"") if payloads else 200
                        if size > 4 << 20:
                            yield _frame(rows, columns)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows, columns)

    return archives.select("uri").repartition(n).mapInPandas(read, RECORD_SCHEMA)


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=columns)
    return df.astype({k: "Int64" for k in ("page_id", "payload_bytes", "refers_to", "offset", "length")})


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back, and describe every record; a record that can't be read back is an
    error. One row comes back for each row of ``pages``, repeats and null ids too; null html is an empty payload, a null
    or missing url none; other columns are ignored, whatever their names; an empty table gives none."""
    spark = pages.sparkSession
    archives = materialise(write_archives(pages, fresh_dir(spark, "warc")), "warc-list")
    return read_archives(archives, payloads=False, strict=True).select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(t) AS d, max(page_id) OVER (PARTITION BY t) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
FROM q
"""

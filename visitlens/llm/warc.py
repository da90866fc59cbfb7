"""WARC archives of pages: written as one gzip member per record, read back one record after the other.

Pages become `response` records; a page whose payload an earlier page has too becomes a `revisit` of it. Archives go through
Spark's own file sink and its commit, so any store that Spark writes to will do and a lost executor leaves no half archive.
The reader inflates an archive slice by slice, frames every record by its content length and verifies its digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
import base64
import hashlib
import re
from urllib.parse import quote, unquote
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from visitlens.llm.common import written
from visitlens.operators.skew import join_per_key

ARCHIVE_BYTES = 64 << 20
LEAST_REVISITED_BYTES = 100
HEAVY_SHARE = 1e-4

SLICE = 1 << 16
INFLATED = 1 << 20
HEAD_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "archive string, start long, record_type string, record_id string, refers_to string, target_uri string, date string, "
    "row_id string, refers_to_row_id string, payload_bytes long, payload_digest string, payload binary, problem string")
_ARROW = pa.schema([
    ("archive", pa.string()), ("start", pa.int64()), *[(n, pa.string()) for n in (
        "record_type", "record_id", "refers_to", "target_uri", "date", "row_id", "refers_to_row_id")],
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])


# writing

def _member(data: list[bytes]) -> bytes:
    """One gzip member without its last byte, which is zero.

    The sink ends every row with a separator: that zero byte, the highest of the member's length. Where a record of 16 MB or
    more has another byte there, an empty member follows it.
    """
    def pack(pieces):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return b"".join([packer.compress(p) for p in pieces] + [packer.flush()])

    member = pack(data)
    if member[-1]:
        member += pack([])
    return member[:-1]


def _plain(value: str, extra: str = "") -> str:
    """`value` as one line of a header: controls and blanks (and `extra`) percent-encoded."""
    return re.sub(f"[\\x00-\\x20\\x7f-\\x9f{extra}]", lambda m: quote(m[0]), value)


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _record_id(row, url: str | None, digest: str) -> str:
    known = hashlib.sha256(repr((url if row is None else row, digest)).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=known[:16], version=5)}>"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return _member([f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "replace"), block, END])


def _page_record(row, url, payload: bytes, digest: str, revisits: bool, first, date: str) -> bytes:
    """A page as a response, or as a revisit of the page `first` with the same payload."""
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = answer if revisits else answer + payload
    return _record([
        ("WARC-Type", "revisit" if revisits else "response"),
        ("WARC-Record-ID", _record_id(row, url, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _plain(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", _digest(block)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if revisits else None),
        ("WARC-Refers-To", _record_id(first, None, digest) if revisits else None),
        ("X-Row-Id", None if row is None else _plain(str(row), "%")),
        ("X-Refers-To-Row-Id", _plain(str(first), "%") if revisits else None),
    ], block)


def _archive_head(date: str) -> bytes:
    block = b"software: visitlens\r\nformat: WARC File Format 1.1\r\n"
    return _record([
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, date)}>"), ("WARC-Date", date),
        ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", _digest(block))], block)


def repeated_payloads(pages: DataFrame, id_col: str, least_bytes: int) -> tuple[DataFrame, list[int], int, int]:
    """Payloads that stand in several rows (`digest`, `first`), tokens of the heavy ones, rows and payload bytes of all.

    `pages` has `digest` and `size`. Copies meet as one row per task and payload; at most 1 / `HEAVY_SHARE` tokens are heavy.
    """
    groups = written(pages.groupBy("digest", "size").agg(F.min(id_col).alias("first"), F.count("*").alias("n")))
    rows, total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0))).first()
    repeated = groups.filter((F.col("n") > 1) & (F.col("size") >= least_bytes) & F.col("first").isNotNull())
    heavy = repeated.filter(F.col("n") > HEAVY_SHARE * rows).select(F.xxhash64("digest")).collect()
    return repeated.select("digest", "first"), [r[0] for r in heavy], rows, total


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_revisited: int = LEAST_REVISITED_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None,
) -> str:
    """Write every row as a record into archives below `folder`, and return `folder`.

    Payloads are bytes, texts being UTF-8; null is an empty payload. Of rows with equal payloads of `least_revisited` bytes or
    more those with the smallest id are responses and the others revisit them; rows alike in id and payload are responses
    alike. A null id is larger than any other; rows of a payload that has no id at all are responses. A null url leaves its
    field out. An archive holds about `archive_bytes` of payload (records of mean size), at least one record. No rows make a
    folder without records. Other columns are not read.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).alias("row"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    repeated, heavy, n, total = repeated_payloads(rows, "row", least_revisited)
    each = max(1, int(archive_bytes * n / max(total, 1))) if n else 1
    each = min(each, max(1, archive_bytes >> 9))  # heads take some room too
    joined = join_per_key(rows, repeated, ["digest"], "left", hot=heavy)
    revisits = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("row"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, place = [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if place % each == 0:  # where the sink begins a new file
                    out.append(_archive_head(date))
                out.append(_page_record(*row, date))
                place += 1
                size += len(out[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    records = joined.select("row", "url", "payload", "digest", revisits.alias("revisits"), "first").mapInArrow(write, "record binary")
    # The bytes pass through the text sink as they are; every archive takes `each` pages and its head.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option(
        "compression", "none").option("maxRecordsPerFile", each + 1).text(folder)
    return folder


# reading

class _Check:
    """A declared digest (`algorithm:value`, hexadecimal or base 32) and the bytes seen so far."""

    def __init__(self, declared: str | None):
        name, _, self.value = (declared or "").partition(":")
        self.hash = hashlib.new(name.lower()) if name.lower() in hashlib.algorithms_guaranteed and "shake" not in name.lower() else None

    def update(self, data: bytes) -> None:
        if self.hash:
            self.hash.update(data)

    def fits(self) -> bool:
        if not self.hash:
            return True
        seen = self.hash.digest()
        return self.value.lower() == seen.hex() or self.value.upper().rstrip("=") == base64.b32encode(seen).decode().rstrip("=")


class _Reading:
    """One record while its bytes arrive."""

    def __init__(self, keep: bool):
        self.keep, self.head, self.fields, self.tail = keep, b"", None, b""
        self.answer, self.size, self.parts, self.http_length = None, 0, [], None

    def take(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            at = self.head.find(END)
            if at < 0:
                if len(self.head) > HEAD_BYTES:
                    raise ValueError("record head without end")
                return
            data = self._begin(self.head[:at], self.head[at + 4:])
        body, rest = data[:self.left], data[self.left:]
        self.left -= len(body)
        self.block.update(body)
        self._payload(body)
        self.tail += rest[:5]
        if len(self.tail) > 4:
            raise ValueError("more bytes than its content length")

    def _begin(self, head: bytes, rest: bytes) -> bytes:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        pairs = (line.partition(":") for line in lines[1:])
        self.fields = {name.strip().lower(): value.strip() for name, _, value in pairs}
        length = self.fields.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", length):
            raise ValueError("no content length")
        self.left = int(length)
        self.revisit = self.fields.get("warc-type") == "revisit"
        self.block = _Check(self.fields.get("warc-block-digest"))
        self.declared = _Check(None if self.revisit else self.fields.get("warc-payload-digest"))
        self.sha = hashlib.sha256()
        self.answer = b"" if self.fields.get("content-type", "").startswith("application/http") else None
        return rest

    def _payload(self, data: bytes) -> None:
        if self.answer is not None:
            self.answer += data
            at = self.answer.find(END)
            if at < 0:
                if len(self.answer) > HEAD_BYTES:
                    raise ValueError("answer head without end")
                return
            length = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", self.answer[:at])
            self.http_length = int(length[1]) if length else None
            data, self.answer = self.answer[at + 4:], None
        self.size += len(data)
        self.sha.update(data)
        self.declared.update(data)
        if self.keep:
            self.parts.append(data)

    def row(self, archive: str, start: int) -> tuple:
        if self.fields is None or self.left or self.tail != END:
            raise ValueError("fewer bytes than its content length")
        if not self.block.fits():
            raise ValueError("block digest differs")
        if not self.declared.fits():
            raise ValueError("payload digest differs")
        get, digest = self.fields.get, self.sha.hexdigest()
        if self.revisit:
            label, _, value = get("warc-payload-digest", "").partition(":")
            digest = value.lower() if label.lower() == "sha256" else None
        whole = [unquote(x) if x is not None else None for x in (get("x-row-id"), get("x-refers-to-row-id"))]
        return (
            archive, start, get("warc-type"), get("warc-record-id"), get("warc-refers-to"), get("warc-target-uri"), get("warc-date"),
            *whole, self.http_length if self.revisit else self.size, digest,
            b"".join(self.parts) if self.keep and not self.revisit else None, None)


def _one(data: memoryview, start: int, reading: _Reading) -> int:
    """Feed the member at `start` to `reading`, a slice at a time; returns where the next one begins."""
    inflate, at, feed = zlib.decompressobj(31), start, b""
    while not inflate.eof:
        if not feed:
            feed = bytes(data[at:at + SLICE])
            if not feed:
                raise ValueError("archive cut off")
            at += len(feed)
        out = inflate.decompress(feed, INFLATED)
        feed = inflate.unconsumed_tail
        if out:
            reading.take(out)
    return at - len(inflate.unused_data)


def archive_records(archive: str, content: bytes, keep: bool = True) -> Iterator[tuple]:
    """The records of one archive in order, as rows of `RECORD`.

    A damaged place gives one row with `problem` set; reading goes on at the next member that can be read.
    """
    data, start, sound = memoryview(content), 0, True
    while 0 <= start < len(content):
        reading = _Reading(keep)
        try:
            after = _one(data, start, reading)
            if reading.head:  # an empty member holds no record
                yield reading.row(archive, start)
            start, sound = after, True
        except (ValueError, zlib.error) as problem:
            if sound:
                yield (archive, start, *[None] * 10, str(problem))
            sound, start = False, content.find(MAGIC, start + 1)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives in `folder`, see `RECORD`; without `payloads` these are verified and let go.

    `payload_bytes` and `payload_digest` (hexadecimal SHA-256) are those of the payload, of a revisit those of the full payload
    it declares. `problem` says what is wrong with a record that cannot be read or fails its digests; its other columns are
    null. `row_id` and `refers_to_row_id` are the ids that `write_archives` was given. An empty folder gives no rows. An archive
    is read into one task's memory in its packed form, 2 GB at most; records are inflated a slice at a time.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for row in archive_records(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), payloads):
                    rows.append(row)
                    size += 500 + len(row[11] or b"")
                    if size > BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

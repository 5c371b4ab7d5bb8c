"""WARC archives with one Zstandard frame per record and a shared dictionary.

An archive begins with a skippable frame that holds the dictionary, itself compressed if that is smaller. Every record
is one frame that names its content size. The reader loads the dictionary, decodes frame after frame and checks each
record: version line, mandatory headers, dates, ids, content length, block and payload digests. The first record of an
archive says how many follow, so an archive that was cut between two frames is noticed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from datetime import datetime
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import arrow_map, open_output, scratch_path, spread_join, tuned

# Fixed values of the formats: the magic numbers of skippable and dictionary frames, the protocol's line ends and names.
SKIPPABLE = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "1970-01-01T00:00:00Z"
DATE_FORM = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.[0-9]{1,9})?Z")
ID_FORM = re.compile(r"<[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]+>")

#: Pages and bytes the dictionary is trained from, at most, its size, and bytes after which an archive is closed.
TRAIN_PAGES, TRAIN_BYTES, DICT_BYTES, ARCHIVE_BYTES = 400, 16 << 10, 64 << 10, 8 << 20


class BadRecord(ValueError):
    """A frame or record that breaks the format."""


def number(text: str) -> int:
    """A decimal number of ASCII digits; what an archive says is taken literally."""
    if not re.fullmatch("-?[0-9]{1,18}", text):
        raise BadRecord(f"{text[:40]!r} is no number")
    return int(text)


def digest(data: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary from the samples; empty if they are too few to train one."""
    if len(samples) < 8 or sum(map(len, samples)) < 8 * size:
        size = sum(map(len, samples)) // 16
    if len(samples) < 8 or size < 512:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


class Writer:
    """Writes records to one archive; ``size`` is its length so far."""

    def __init__(self, out, dictionary: bytes, level: int = 3):
        self.out, self.size = out, 0
        self.zstd = zstandard.ZstdCompressor(level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        if dictionary:
            packed = zstandard.ZstdCompressor(19).compress(dictionary)
            held = packed if len(packed) < len(dictionary) else dictionary
            self._put(SKIPPABLE.to_bytes(4, "little") + len(held).to_bytes(4, "little") + held)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def record(self, headers: list[tuple[str, str]], block: bytes) -> None:
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
        self._put(self.zstd.compress("\r\n".join(lines).encode() + block + CRLF + CRLF))


def frames(data: memoryview):
    """Decoded content of each frame of an archive."""
    at, dictionary = 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == SKIPPABLE:
        size = int.from_bytes(data[4:8], "little")
        raw = bytes(data[8 : 8 + size])
        if len(raw) != size:
            raise BadRecord("dictionary frame is cut short")
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    zstd = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if bytes(data[at : at + 4]) != FRAME_MAGIC:
            raise BadRecord(f"no frame at byte {at}")
        one = zstd.decompressobj()
        content, fed = [], at
        while not one.eof and fed < len(data):
            content.append(one.decompress(data[fed : fed + (1 << 16)]))
            fed = min(fed + (1 << 16), len(data))
        if not one.eof:
            raise BadRecord(f"frame at byte {at} is cut short")
        at = fed - len(one.unused_data)
        yield b"".join(content)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, checked."""
    head, gap, rest = record.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadRecord("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadRecord(f"broken header line {line[:60]!r}")
        headers[name.strip().lower().decode()] = value.strip().decode()
    for name in MANDATORY:
        if name.lower() not in headers:
            raise BadRecord(f"header {name} is missing")
    if not ID_FORM.fullmatch(headers["warc-record-id"]):
        raise BadRecord("record id is no URI in angle brackets")
    date = DATE_FORM.fullmatch(headers["warc-date"])
    try:
        datetime.fromisoformat(date[1] if date else "")
    except ValueError:
        raise BadRecord("date is no UTC time") from None
    n = number(headers["content-length"])
    if n < 0 or len(rest) != n + 4 or rest[n:] != CRLF + CRLF:
        raise BadRecord("block length differs from the content length")
    block = rest[:n]
    if (named := headers.get("warc-block-digest")) and named != f"sha1:{digest(block)}":
        raise BadRecord("block digest differs")
    return headers, block


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The entity in a response block, checked against its headers."""
    http, gap, body = block.partition(CRLF + CRLF)
    if not gap or not http.startswith(b"HTTP/"):
        raise BadRecord("response without an HTTP head")
    for line in http.split(CRLF)[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and number(value.strip().decode("latin-1")) != len(body):
            raise BadRecord("HTTP content length differs")
    if headers.get("warc-payload-digest") != f"sha1:{digest(body)}":
        raise BadRecord("payload digest differs")
    return body


def _record_id(page: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{url}')}>"


_FILES = pa.schema([("path", pa.string()), ("records", pa.int64())])


def _write(batches, folder, dictionary, archive_bytes):
    from pyspark import TaskContext

    part, file = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def close():
        nonlocal file, held, size
        path = f"{folder}/pages-{part:06d}-{file:06d}.warc.zst"

        def write(out):
            archive = Writer(out, dictionary.value)
            archive.record(
                [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, path)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
                b"records: %d\r\n" % len(held),
            )
            for page, url, payload, first, of in held:
                name = "null" if page is None else str(page)
                body_digest = f"sha1:{digest(payload)}"
                head = HTTP_HEAD % len(payload)
                block = head + payload if first else head
                uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                headers = [
                    ("WARC-Type", "response" if first else "revisit"), ("WARC-Record-ID", _record_id(page, url)), ("WARC-Date", DATE),
                    ("WARC-Target-URI", uri), ("X-Page-ID", name), ("WARC-Payload-Digest", body_digest),
                    ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("X-Payload-Length", str(len(payload))),
                    ("Content-Type", "application/http;msgtype=response"),
                ]
                if not first:
                    headers += [("WARC-Profile", IDENTICAL), ("X-Refers-To-Page-ID", "null" if of is None else str(of))]
                archive.record(headers, block)

        open_output(path, write)
        row = pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)]}, schema=_FILES)
        file, held, size = file + 1, [], 0
        return row

    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in ("page_id", "url", "first", "of"))
        for page, url, first, of, payload in zip(*columns, batch.column("html").cast(pa.binary()).to_pylist()):
            held.append((page, url, payload or b"", first, of))
            size += len(payload or b"") + 600
            # Compressed pages are a fraction of this, so an archive stays well below the bound.
            if size >= 4 * archive_bytes:
                yield close()
    if held:
        yield close()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page under ``folder``; returns ``path, records`` per archive.

    A null page is an empty payload. Of equal payloads of at least ``min_bytes`` bytes the page with the largest id is
    a response and the others are revisits of it; if that id repeats, each of its rows is a response. A null id is
    below all others. Line ends in a url are percent-encoded. Other columns are not read.
    """
    spark = tuned(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = rows.withColumn("sha", F.sha2(body, 256)).withColumn("long", F.length(body) >= min_bytes)
    groups = rows.where("long").groupBy("sha").agg(F.max("page_id").alias("of"), F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = spread_join(rows, groups.select("sha", "of", F.lit(True).alias("shared")), ["sha"], F.xxhash64("page_id"))
    first = ~(F.coalesce("shared", F.lit(False)) & F.col("long")) | F.col("page_id").eqNullSafe(F.col("of"))
    # Which pages are sampled follows from their hashes, so the archives of a table are the same in every run.
    full = pages.where("length(html) > 0").select(F.substring("html", 1, TRAIN_BYTES).alias("cut"), F.xxhash64("page_id", "url").alias("order"))
    classes = max(1, full.count() // TRAIN_PAGES)
    cut = full.where(F.pmod("order", F.lit(classes)) == 0).orderBy("order", "cut").limit(2 * TRAIN_PAGES).collect()
    samples = sorted(r["cut"].encode()[:TRAIN_BYTES] for r in cut)
    dictionary = spark.sparkContext.broadcast(train_dictionary(samples))
    write = partial(_write, folder=folder, dictionary=dictionary, archive_bytes=archive_bytes)
    return arrow_map(rows.select("page_id", "url", "html", first.alias("first"), "of"), write, "path string, records long")


_PAGES = pa.schema(
    [("path", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())]
)


def _page(record: bytes) -> dict:
    headers, block = parse(record)
    told = lambda name: None if headers.get(name, "null") == "null" else number(headers[name])
    kind = headers["warc-type"]
    if kind == "warcinfo":
        fields = dict(line.split(b":", 1) for line in block.split(CRLF) if b":" in line)
        return {"record_type": kind, "records": number(fields.get(b"records", b"").strip().decode("latin-1"))}
    row = {"page_id": told("x-page-id"), "url": headers.get("warc-target-uri"), "record_type": kind, "refers_to": told("x-refers-to-page-id")}
    named = headers.get("warc-payload-digest", "")
    if kind == "response":
        body = payload_of(headers, block)
        if (length := told("x-payload-length")) is not None and length != len(body):
            raise BadRecord("payload length differs")
        return row | {"payload": body, "payload_bytes": len(body), "payload_digest": named.removeprefix("sha1:")}
    return row | {"payload": None, "payload_bytes": told("x-payload-length"), "payload_digest": named.removeprefix("sha1:")}


def _read(batches, payloads):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows, size, place, records = [], 0, 0, None
            found = frames(memoryview(content.as_buffer()))
            while True:
                row = dict.fromkeys(_PAGES.names) | {"path": path, "place": place}
                try:
                    record = next(found)
                    size += len(record)
                    read = _page(record)
                    if read["record_type"] == "warcinfo":
                        records = read["records"]
                        continue
                    row |= read
                except StopIteration:
                    break
                except (BadRecord, zstandard.ZstdError, UnicodeDecodeError) as wrong:
                    row["error"] = str(wrong)
                if not payloads:
                    row["payload"] = None
                rows.append(row)
                place += 1
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PAGES)
                    rows, size = [], 0
            if records is not None and records != place:
                rows.append(dict.fromkeys(_PAGES.names) | {"path": path, "place": place, "error": f"{place} of {records} records"})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_PAGES)


def read_archives(spark, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``folder``; ``error`` says what a record breaks, else it is null.

    After a broken frame the rest of its archive cannot be found and is missing; a broken record in a whole frame
    costs only itself. An archive that holds another number of records than it says ends with a row that says so.
    """
    files = tuned(spark).read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    schema = (
        "path string, place long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
        "payload binary, error string"
    )
    return arrow_map(files.select("path", "content"), partial(_read, payloads=payloads), schema)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, read back from archives of all pages."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder, min_bytes).write.parquet(f"{folder}-list")
    if not spark.read.schema("path string, records long").parquet(f"{folder}-list").limit(1).count():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    rows = read_archives(spark, folder, payloads=False)
    checked = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("bad record: "), "error")))
    return rows.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")

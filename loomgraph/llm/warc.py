"""WARC archives and revisit resolution.

An archive file is a sequence of gzip members, one to a record, of at least ``FILE_BYTES`` bytes of records but for the
last, so that what a task holds is bounded by bytes; a longer record has a file of its own. Files are made in the workers
and written by Spark's text writer, one row to a file, so they go to any store that Spark writes to; the zero byte that
the writer puts at a file's end is padding to readers of gzip. Payloads are bytes, of any encoding.

Resolution shuffles headers only: of all records, digest and id go to the digest's group, which names the record that
stays a response. What others become goes back to their files, as a list of places with the record that each refers to,
and the deduplicated archives are written with fresh headers. Beyond ``BROADCAST_REVISITS`` revisits, that list meets the
compressed files in a join by path, whose keys are never hot.

Defined cases: a null payload is an empty one; all records with the page_id that stays are responses, so rows that
repeat a page_id stay whole; records without page_id neither win against others nor refer, unless no record of their
payload has one: then all are responses; control characters in a url are written as %XX; an empty table gives an
archive without records and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, forget, lean, scratch_path, ship, written

#: Bytes of records in a file.
FILE_BYTES = 8_000_000
#: Revisits that may be broadcast (some 60 bytes each); beyond that compressed files are shuffled.
BROADCAST_REVISITS = 300_000
#: WARC-Date of records whose fetch time is not known.
DATE = "2026-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, target: str | None = None, length: int | None = None) -> bytes:
    """One record; with refers_to a revisit, whose block is the HTTP header alone."""
    length = len(payload) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}".encode() + _END
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {refers_to}"]
        head += [f"WARC-Refers-To-Target-URI: {_clean(target)}"] if target is not None else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and payload of each record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin, size = stop + 4, int(head["content-length"])
        block = data[begin : begin + size]
        at = begin + size + 4
        if len(block) < size or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"a record is cut short at byte {begin}")
        yield head, block[block.index(b"\r\n\r\n") + 4 :]


def members(content: bytes) -> Iterator[bytes]:
    """What each gzip member of a file holds."""
    data, at = memoryview(content), 0
    while at < len(data):
        if data[at] == 0:  # padding
            at += 1
            continue
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError(f"a file is cut short at byte {at}")
            chunk = data[at : at + 16_384]
            out.append(member.decompress(chunk))
            at += len(chunk) - len(member.unused_data)
        yield b"".join(out)


def _files(records: Iterator[bytes], most: int) -> Iterator[bytes]:
    """Records as files of some ``most`` bytes."""
    held, size = [], 0
    for r in records:
        held.append(gzip.compress(r, 1, mtime=0))
        size += len(r)
        if size >= most:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _write(rows: DataFrame, records: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], path: str) -> None:
    most = FILE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in _files(records(batches), most):
            yield pa.RecordBatch.from_pydict({"value": pa.array([file], pa.binary())})

    # a string of Spark holds any bytes, and the text writer writes them as they are
    files = rows.mapInArrow(lean(run), "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def write_archives(pages: DataFrame, path: str) -> None:
    """A response record for each row of ``pages`` (page_id, url, html); html is a string or bytes."""
    ship(pages.sparkSession)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for i, url, html in zip(*batch.columns):
                payload = html.as_py() or b""
                yield record(i.as_py(), url.as_py(), payload, payload_digest(payload))

    _write(pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("binary")), records, path)


HEADERS = "path string, place int, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def _row(head: dict[str, str], payload: bytes, verify: bool) -> tuple:
    """page_id, url, record_type, payload_digest, payload_bytes and refers_to of a record."""
    digest, length = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
    if verify and head["warc-type"] == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"record {head['warc-record-id']} does not fit its digest")
    number = lambda k: int(head[k]) if k in head else None
    return number("x-page-id"), head.get("warc-target-uri"), head["warc-type"], digest, length, number("x-refers-to-page-id")


def _load(spark: SparkSession, path: str, *columns: Column | str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(*columns)


def read_archives(spark: SparkSession, path: str, payloads: bool = False, verify: bool = True) -> DataFrame:
    """``path, place, page_id, url, record_type, payload_digest, payload_bytes, refers_to`` and, if asked for, ``payload``
    (binary) of every record; place is its number in the file.

    To verify, a response whose payload does not fit its digest and length ends the job with an error.
    """
    ship(spark)
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["path", "place", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                found = (r for m in members(content.as_py()) for r in parse(m))
                rows, size = [], 0
                for place, (head, payload) in enumerate(found):
                    rows.append((name.as_py(), place, *_row(head, payload, verify), *([payload] if payloads else [])))
                    size += len(payload) if payloads else 0
                    if size >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names[: 8 + payloads])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names[: 8 + payloads])

    return _load(spark, path, "path", "content").mapInArrow(lean(run), HEADERS + ", payload binary" * payloads)


def resolve_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``payload_digest, winner, target``: of each payload of at least ``least_bytes`` with several records, the page_id that stays."""
    headers = records.where(F.col("payload_bytes") >= least_bytes).select("payload_digest", "page_id", "url")
    by = headers.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("winner"), F.max_by("url", "page_id").alias("target"))
    return by.where("n > 1 and winner is not null").drop("n")


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """Write the archives below ``source`` anew below ``target``, with revisits in place of repeated payloads."""
    headers = written(read_archives(spark, source, verify=False).select("path", "place", "page_id", "url", "payload_digest", "payload_bytes"), "headers")
    # a digest that many records have meets its one winner in a join that Spark can split
    losers = headers.join(resolve_revisits(headers, least_bytes), "payload_digest").where("page_id is null or page_id <> winner")
    lists = written(losers.groupBy("path").agg(F.collect_list(F.struct("place", "winner", "target")).alias("revisits")), "revisits")
    few = (lists.agg(F.sum(F.size("revisits"))).first()[0] or 0) <= BROADCAST_REVISITS
    both = _load(spark, source, "path", "content").join(F.broadcast(lists) if few else lists, "path", "left").select("content", "revisits")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for content, revisits in zip(*batch.columns):
                to = {r["place"]: (r["winner"], r["target"]) for r in revisits.as_py() or []}
                found = (r for m in members(content.as_py()) for r in parse(m))
                for place, (head, payload) in enumerate(found):
                    page, url, _, digest, length, _ = _row(head, payload, True)
                    yield record(page, url, payload, digest, *to.get(place, (None, None)), length)

    _write(both, records, target)
    forget(headers, lists)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, deduplicate and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row."""
    spark = pages.sparkSession
    raw, lean_ = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_archives(pages, raw)
    deduplicate(spark, raw, lean_, least_bytes)
    drop_scratch(spark, raw)
    return read_archives(spark, lean_).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
